"""Ledgers in buckets of customers: the same results as without, and rows move once."""

import random
import re
from decimal import Decimal

import duckdb
import pytest

from passbook.operators import behaviour, partials, profile, recurring, tables
from passbook.operators.scratch import laid
from passbook.plans import ledger as plan
from passbook.plans import queries

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"Exchange (\w+\([^)]*\))", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("together", [None, 3])
@pytest.mark.parametrize("batch", [2, 10_000])
def test_clusters_over_batches(spark, together, batch):
    """A cluster goes on over batches, and stretches that are passed over hold none."""
    rng, old = random.Random(batch), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = [(c, m, d) for c in (1, 2, None) for m in ("a", "b") for d in ("debit", "credit")]
    rows = [(*rng.choice(keys), Decimal(rng.choice([-300, -290, 50, 90, 140, 5000, 5400, 5800, rng.randrange(1, 90_000), rng.randrange(1, 90_000)])) / 100, rng.choice([1, 1, 2]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "customer_id long, merchant string, direction string, amount decimal(18,2), n long, id long")
    df = df if together else df.where("customer_id IS NOT NULL")  # a join finds no null keys
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.id: r.cluster for r in recurring.clustered_rows(df, 3, together).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, last, total, count, members = {}, None, 0, 0, []
    for *key, amount, n, i in sorted(rows, key=lambda r: (str(r[:3]), r[3])):
        mean = float(total) / count if count else 0.0
        if key == last and abs(float(amount) - mean) <= max(0.1 * abs(mean), 1.0):
            total, count = total + amount * n, count + n
        else:
            last, total, count, members = key, amount * n, n, []
        members.append((i, amount))
        if count >= 3:
            want |= {j: members[0][1] for j, _ in members}
    assert got == {i: c for i, c in want.items() if together or rows[i][0] is not None}


def test_a_large_customer_is_spread(spark, monkeypatch):
    """Where a customer is too large for a bucket there are none, and the rows are those of the SQL."""
    assert plan.together(spark, SF) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(plan, "MOST", 10)
    assert plan.together(spark, SF) is None
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("recurring_clusters", "recurring_items", "all_frequencies", "balance_stats", "feature_table"):
        df = queries.QUERIES[name](spark, SF)
        got = sorted(map(repr, map(tuple, df.collect())))
        assert got == sorted(map(repr, con.execute(f"select {', '.join(df.columns)} from ({queries.SQL[name]})").fetchall())), name


def test_rows_of_a_customer_move_once(spark):
    """After the shuffle by customer sums, counts of names and clusters need no other one; a ledger is not read twice for its sizes."""
    rows = laid(plan.entries(spark, SF, 4), "entries", "customer_id", 4)
    assert not exchanges(behaviour.all_frequencies(rows)) and not exchanges(behaviour.totals(rows))
    assert not exchanges(recurring.clustered_rows(recurring.payment_rows(rows), 3, 4))
    amounts = partials.partials(rows.withColumns({"balance": rows.debit, "seq": rows.credit.cast("long")}), ("amounts",))
    kept = {"amounts": laid(amounts["amounts"], "amounts", "customer_id", 4)}
    assert not exchanges(partials.merged(kept, amounts)["amounts"])
    moved = [e for e in exchanges(queries.all_frequencies(spark, SF)) if "customer_id" in e]
    assert len(moved) == 1 and "kind" not in moved[0]
    assert "description" not in profile.narrow(plan.ledger(spark, SF, 4), 4).columns


def test_joins_of_the_ledger_hold_no_lines(spark, monkeypatch):
    """Orders and parts are hashed, lines pass by unsorted, and the number of tasks grows with the lines."""
    plain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    count = lambda df: df.groupBy("customer_id", "merchant", "category").count()
    want = sorted(map(repr, count(plan.entries(spark, SF)).collect()))
    monkeypatch.setattr(plan, "SENT", 0)
    for most, tasks in ((plan.JOIN_ROWS, 4), (100_000, 20)):  # 4 is the number of the session
        monkeypatch.setattr(plan, "JOIN_ROWS", most)
        df = plan.entries(spark, SF, 8)
        found = plain(df)
        assert found.count("ShuffledHashJoin") == 2 and "Sort" not in found
        for key in ("l_orderkey", "l_partkey"):
            assert re.search(rf"hashpartitioning\({key}#\w+, {tasks}\)", found)
        assert sorted(map(repr, count(df).collect())) == want
    assert "ShuffledHashJoin" in plain(plan.entries(spark, SF))  # queries that name no buckets have the same joins


def test_a_large_part_is_spread(spark, monkeypatch, tmp_path):
    """One part in most rows would land in one task of the hash join."""
    monkeypatch.setattr(plan, "MOST", 2500)
    for name in ("lineitem", "orders"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.withColumn("l_partkey", df.l_partkey * 0 + 1) if name == "lineitem" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    assert plan.together(spark, SF) is not None and plan.together(spark, str(tmp_path)) is None


def test_the_fold_reads_buckets(spark):
    """What goes to the fold is read bucket by bucket (else by size of files, so that a task grows with the input), sorted once, without amounts that can be in no cluster."""
    rows = laid(recurring.payment_rows(plan.entries(spark, SF, 7)), "payments", "customer_id", 7)
    df = recurring.clustered_rows(rows, 3, 7)
    found = df._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in found and "disabled by query planner" not in found and found.count("Sort [") == 1
    assert df.rdd.getNumPartitions() == 7
    assert recurring._in_reach(rows, 3).count() < rows.count() / 2
    assert sorted(map(repr, recurring._folded(rows.coalesce(1), 3).collect())) == sorted(map(repr, df.collect()))


def test_a_line_is_matched_once(spark):
    """Filters and uses of what a line is cut into repeat no pattern, and odd lines are read as before."""
    lines = ["01/02/2024 UPI/x 1.00 0.00 5.50", "1-2-24\ta  b\t-1,000.00 7.00", "01/02/2024  1.00", "01/02/2024 salary 9.00", "01/02/2024 debit credit 1.00", "01/02/2024 x 1.00\r", "x 1.00", "", "01/02/2024 $1 \\ 2.0 3.00"]
    df = tables.text_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "path long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(tables._LINE) == 1 and plan.count(tables._AMOUNTS) == 1
    assert sorted(map(tuple, df.collect())) == [
        (1, 0, "01/02/2024", "UPI/x", "1.00", "0.00", "5.50"), (1, 1, "1-2-24", "a  b", "-1,000.00", "", "7.00"), (1, 3, "01/02/2024", "salary", "", "9.00", ""), (1, 5, "01/02/2024", "x", "1.00", "", ""),
        (1, 8, "01/02/2024", "$1 \\ 2.0", "3.00", "", ""),
    ]


def test_small_values_of_a_line_cross_shuffles_as_one_number(spark, monkeypatch, tmp_path):
    """A shuffle pays for each column. Unknown and odd values come back as they went, and rows are those of the SQL."""
    odd = {
        "lineitem": "l_linenumber = CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 7 = 1 THEN -2147483648 WHEN l_orderkey % 7 = 2 THEN 2147483647 ELSE l_linenumber END, l_returnflag = CASE WHEN l_orderkey % 5 > 0 THEN l_returnflag END",
        "part": "p_type = CASE WHEN p_partkey % 3 > 0 THEN p_type END, p_size = CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN -p_size ELSE p_size END",
        "orders": "",
    }
    con = duckdb.connect()
    for t, changes in odd.items():
        con.execute(f"create table {t} as select * from '{SF}/{t}.parquet'")
        if changes:
            con.execute(f"update {t} set {changes}")
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    columns = "customer_id, date, description, merchant, debit, credit, category, payment_mode, seq, balance"
    want = sorted(map(repr, con.execute(f"with {plan.LEDGER_SQL} select {columns} from ledger").fetchall()))
    for parts in (3, None):
        monkeypatch.setattr(plan, "together", lambda *_: parts)
        df = plan.ledger(spark, str(tmp_path)).select(*columns.split(", "))
        assert sorted(map(repr, map(tuple, df.collect()))) == want
    below = plan.entries(spark, SF, 3)._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning(customer_id")[2]
    assert below and not re.search(r"AS (is_credit|type|size|l_linenumber)#", below) and "l_linenumber#" not in below.partition("AS line#")[0].rpartition("Project [")[0]


def test_joins_of_sums_move_no_buckets(spark):
    """What lies in buckets stays where the session's tasks are more and nothing is broadcast; what is joined with it goes to them."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        moved = {name: [re.sub(r"#\w+", "", e) for e in exchanges(queries.QUERIES[name](spark, SF))] for name in ("customers_without_rows", "feature_increments", "profile_table")}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, found in moved.items():  # the other ones are of the recurring items
        assert [e for e in found if "cluster" not in e] == ["hashpartitioning(customer_id, 4)"], name
