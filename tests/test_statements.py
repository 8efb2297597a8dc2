"""Statements from files to profiles, on small fixtures with known results."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from passbook.functions import similarity, text
from passbook.operators import behaviour, canonical, columns, profile, recurring, store, synthetic, tables
from passbook.sources import statements

LEDGER = "customer_id string, date timestamp_ntz, seq long, merchant string, description string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), category string, payment_mode string"


@pytest.fixture
def history(spark):
    out, balance, seq = [], Decimal(50000), 0
    for m in range(6):
        for day, what, who, debit, credit, category, mode in (
            (1, "NEFT-SALARY-ACME CORP", "Acme Corp", None, 60000, "Salary", "NEFT"), (3, "UPI-RENT-LANDLORD", "Landlord", 18000 + 3 * m, None, "Rent", "UPI"),
            (5, "UPI-NETFLIX SUBSCRIPTION", "Netflix", 499, None, "Subscription", "UPI"), (7, "UPI-SPOTIFY SUBSCRIPTION", "Spotify", 119, None, "Subscription", "UPI"),
            (11, "POS-SWIGGY ORDER", "Swiggy", 1000 + 50 * m, None, "Food", "POS"), (16, "ATM-CASH WITHDRAWAL", None, 2500 + 25 * m, None, "ATM", "ATM"),
        ):
            seq += 1
            balance += (credit or 0) - (debit or 0)
            out.append(("c", datetime(2025, m + 1, day), seq, who, what, debit and Decimal(debit), credit and Decimal(credit), balance, category, mode))
    return spark.createDataFrame(out, LEDGER)


def test_known_history(history):
    s = behaviour.summary(history).first()
    assert (s.n_transactions, float(s.incoming_total), float(s.outgoing_total), s.days_covered) == (36, 360000.0, 133878.0, 166)
    assert s.salary_detected and s.salary_amount == 60000 and round(s.savings_ratio, 4) == 0.6281 and s.merchant_loyalty == 0.2
    items = {(r.category, r.merchant): r for r in recurring.recurring(history).collect()}
    pay = items["Salary", "acme corp"]
    assert (pay.cadence, pay.median_amount, pay.occurrences, round(pay.confidence, 4)) == ("monthly", 60000.0, 6, 0.9812)
    assert ("Subscription", "netflix") in items and ("Subscription", "spotify") in items
    swiggy = items["Subscription", "swiggy"]
    assert (swiggy.occurrences, round(swiggy.confidence, 4)) == (4, 0.8105)
    p = profile.profiles(history).first()
    assert p.income == 60000 and p.preferred_merchants == ["Acme Corp", "Landlord", "Netflix", "Spotify", "Swiggy"] and p.preferred_payment_modes == ["UPI", "ATM", "NEFT", "POS"]
    f = profile.feature_table(history)
    assert f.columns == profile.FEATURES and len(f.columns) == 44 and round(f.first().online_spend_ratio, 4) == round(24 / 36, 4)


def test_empty_history(history):
    none = history.where("false")
    assert behaviour.summary(none).count() == 0 and profile.feature_table(none).columns == profile.FEATURES and recurring.recurring(none).count() == 0


def test_folder_to_transactions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Txn Date,Description,Debit,Credit,Balance\n15/01/2025,UPI-SWIGGY,250.00,,4750.00\n16/01/2025,NEFT-SALARY,,\"50,000.00\",54750.00\n17/01/2025,ATM-WITHDRAWAL,2000.00,,52750.00\nnever,X,1,,1\n")
    (tmp_path / "b.csv").write_text("Transaction Date,Narration,Amount,Balance\n10/01/2025,UPI-TEA,-45.00,955.00\n11/01/2025,NEFT-REFUND,1200.00,2155.00\n")
    (tmp_path / "c.csv").write_text("Date,Amount\n")
    (tmp_path / "d.txt").write_text("not read")
    assert [r.file_type for r in statements.inventory(spark, str(tmp_path)).collect()] == ["csv"] * 3
    cells, errors = statements.cells(spark, str(tmp_path))
    assert [r.error for r in errors.collect()] == ["csv: No rows"]
    mapping = columns.column_mapping(cells)
    found = {(r.path[-5:], r.field): (r.source_column, r.confidence) for r in mapping.collect()}
    assert found["a.csv", "date"] == ("Txn Date", 1.0) and found["a.csv", "debit"][0] == "Debit" and found["b.csv", "amount"][0] == "Amount" and ("b.csv", "debit") not in found
    ok, bad = canonical.normalised(cells, mapping)
    rows = {r.description: r for r in ok.collect()}
    assert rows["UPI-SWIGGY"].debit == Decimal("250.00") and rows["UPI-SWIGGY"].credit is None and rows["UPI-SWIGGY"].payment_mode == "UPI"
    assert rows["NEFT-SALARY"].credit == Decimal("50000.00") and rows["UPI-TEA"].debit == Decimal("45.00") and rows["NEFT-REFUND"].credit == Decimal("1200.00")
    assert [r.reason for r in bad.collect()] == ["no date"]
    done = canonical.with_categories(canonical.with_merchants(ok))
    assert {r.merchant: r.category for r in done.collect()}["Swiggy"] == "Food"


@pytest.mark.parametrize(
    "description, merchant",
    [("UPI/DR/501763002832/ZEPTO/HDFC", "Zepto"), ("NETFLIX INDIA", "Netflix"), ("SWIGGY*ORDER", "Swiggy"), ("POS/ZOMATO/12345678", "Zomato"), ("AMZN", "Amazon"), ("AMAZON PAY", "Amazon"), ("", None), (None, None), ("999999 500000123", None)],
)
def test_merchants(spark, description, merchant):
    df = spark.createDataFrame([(description,)], "d string").select(text.merchant_of(F.col("d")).alias("m"))
    assert df.first().m.merchant == merchant


def test_dates_and_amounts(spark):
    df = spark.createDataFrame([("2025-01-10", "1,200.50"), ("15/01/2025", "₹45"), ("x", "-"), (None, None), ("31/12/25", "abc")], "d string, a string")
    got = df.select(text.statement_date(F.col("d")).alias("d"), text.amount(F.col("a")).alias("a"), text.bad_amount(F.col("a")).alias("b")).collect()
    assert [r.d for r in got] == [datetime(2025, 1, 10), datetime(2025, 1, 15), None, None, datetime(2025, 12, 31)]
    assert [r.a for r in got] == [Decimal("1200.50"), Decimal("45.00"), None, None, None] and [r.b for r in got] == [False, False, False, False, True]


def test_text_lines_and_tables(spark):
    page = "Statement\nDate Description\n15/01/2025 UPI-SWIGGY 250.00 4750.00\n16/01/2025 NEFT-SALARY 50000.00 54750.00"
    got = [(r.debit, r.credit, r.balance) for r in tables.text_lines(spark.createDataFrame([("p", page)], "path string, text string")).orderBy("line_no").collect()]
    assert got == [("250.00", "", "4750.00"), ("", "50000.00", "54750.00")]
    tokens = spark.createDataFrame([("p", 1, 10.0, 5.0, "a"), ("p", 1, 2.0, 9.0, "b"), ("p", 1, 1.0, 40.0, "c")], "path string, page int, x double, y double, text string")
    assert [r.cells for r in tables.token_rows(tokens).orderBy("row").collect()] == [["b", "a"], ["c"]]
    heads = spark.createDataFrame([("p", i, h) for i, h in enumerate(["Date", "", "", "Balance"])], "path string, pos int, header string")
    assert [r.unique for r in columns.unique_headers(heads).orderBy("pos").collect()] == ["Date", "col", "col_1", "Balance"]


def test_store_and_similarity(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (3, "d", 0), (2, "e", 0)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in store.upserted(old, new, ["k"], "t").collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert similarity.token_sort("date txn", "txn date") == 100 and similarity.token_set("amazon india", "amazon") == 100 and similarity.indel("", "") == 100
    queue = spark.createDataFrame([("Zepto",), ("X",)], "merchant string")
    got = store.drained(queue, lambda ms: [("{}", m == "Zepto", None if m == "Zepto" else "500") for m in ms]).collect()
    assert {r.merchant: r.success for r in got} == {"Zepto": True, "X": False}
    e = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, v array<double>")
    assert {r.id: r.distance for r in synthetic.nearest(e, e.where("id = 0")).collect()} == {0: 0.0, 1: 5.0}


def test_stream_matches_batch(spark, tmp_path):
    from passbook.streaming import statements as st

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = st.event_stream(spark, str(tmp_path / "in"), events.schema)
    q = st.upsert_stream(stream.select("user_id", "event_type", "event_id"), str(tmp_path / "t"), str(tmp_path / "c"), ["user_id"], "event_id")
    assert q.awaitTermination(120) is not False
    got = {(r.user_id, r.event_id) for r in st.latest(spark, str(tmp_path / "t"), "user_id long, event_type string, event_id long").collect()}
    assert got == {(r.user_id, r.e) for r in events.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}


def test_repeated_headers(spark, tmp_path):
    """A header that occurs twice: the column of the mapping counts, not the largest cell under that name."""
    (tmp_path / "a.csv").write_text("Date,Description,Amount,Amount\n15/01/2025,UPI-TEA,5.00,9.00\n16/01/2025,NEFT-REFUND,7.00,1.00\n")
    cells, errors = statements.cells(spark, str(tmp_path))
    ok, bad = canonical.normalised(cells, columns.column_mapping(cells))
    assert sorted((r.description, float(r.credit), r.debit) for r in ok.collect()) == [("NEFT-REFUND", 7.0, None), ("UPI-TEA", 5.0, None)] and errors.count() == bad.count() == 0


def test_contract(spark):
    df = spark.createDataFrame([("x", "Netflix", 1)], "transaction_id string, merchant string, other int")
    assert canonical.contract(df).columns == canonical.CONTRACT and canonical.contract(df).first().merchant == "Netflix"


def test_tier2(spark, tmp_path):
    """Obvious phrases get their category, rules go first, blank texts get none; the model is saved and read again."""
    from passbook.operators import tier2

    model = tier2.load_or_fit(spark, str(tmp_path / "m"))
    again = tier2.load_or_fit(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([(1, None, "petrols stations"), (2, "Netflix", None), (3, None, None), (4, "hospitl clinc", "")], "k int, merchant string, description string")
    one, two = ({r.k: (r.category, round(r.category_confidence, 6)) for r in canonical.with_categories(df, m).collect()} for m in (model, again))
    assert one == two and one[1][0] == "Fuel" and one[2] == ("Entertainment", 0.95) and one[3] == ("Others", 0.1) and one[4][0] == "Healthcare"


def test_amount_clusters(spark):
    """The streaming fold equals the rule step by step, for dense amounts, ties and several keys."""
    import random

    rnd = random.Random(6)
    rows = [(c, m, "debit", Decimal(rnd.randint(1, 4000)) / 10) for c in (1, 2, None) for m in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "customer_id int, merchant string, direction string, amount decimal(18,2)")
    got = {(r.customer_id, r.merchant, r.amount): r.cluster for r in recurring.amount_clusters(df).collect()}
    want = {}
    for c in (1, 2, None):
        for m in ("a", "b"):
            total, n, first = Decimal(0), 0, None
            for a in sorted(x for k, l, _, x in rows if (k, l) == (c, m)):
                mean = float(total) / n if n else 0.0
                if first is None or abs(float(a) - mean) > max(0.1 * abs(mean), 1.0):
                    total, n, first = Decimal(0), 0, a
                total, n = total + a, n + 1
                want[c, m, a] = first
    assert got == want


def test_nearest_is_exact(spark):
    """Cells, blocks and radii lose no neighbour; null vectors, repeated ids and empty tables have a result."""
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, (150, 3)), np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(6, 0.1, (100, 3))])
    queries = spark.createDataFrame([(i % 140, v.tolist()) for i, v in enumerate(a)] + [(999, None)], "id long, v array<double>")
    rows = spark.createDataFrame([(v.tolist(),) for v in b], "v array<double>")
    want = sorted((i % 140, round(float(np.sqrt(((b - v) ** 2).sum(1)).min()), 9)) for i, v in enumerate(a))
    assert sorted((r.id, round(r.distance, 9)) for r in synthetic.nearest(queries, rows, block=16, pivots=7).collect()) == want
    assert all(r.distance is None for r in synthetic.nearest(queries, rows.where("false")).collect()) and synthetic.nearest(queries.where("false"), rows).count() == 0


def test_fidelity_and_copula(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("customer_id"), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0 + F.col("id") % 7).alias("b"))
    made = synthetic.copula_samples(df, 400)
    same, other = synthetic.fidelity(df, df, ["a", "b"]), synthetic.fidelity(df, made, ["a", "b"])
    assert same == {"a": 1.0, "b": 1.0, "correlation": 1.0} and min(other.values()) > 0.85 and made.count() == 400
    assert synthetic.privacy_check(df, df, ["a", "b"]).first().passed is False


def test_stored_tables(spark, tmp_path):
    """The registry has a name once, SQL over CSV, a bounded read, a cache of categories asked once a key."""
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, b int")
    none = spark.createDataFrame([], "name string, path string, n_rows long, columns array<string>")
    one = store.registered(none, df, "t", str(tmp_path / "t"))
    two = store.registered(one, df.limit(2), "t", str(tmp_path / "t2"))
    assert [(r.name, r.n_rows, r["columns"]) for r in two.collect()] == [("t", 2, ["a", "b"])]
    df.coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    got = store.sql_over_csv(spark, "SELECT sum(a) AS s, avg(b) AS m FROM {t}", t=str(tmp_path / "csv")).first()
    assert (got.s, got.m) == (6, 20.0) and statements.csv_table(spark, str(tmp_path / "csv"), most=2).count() == 2
    asked = spark.sparkContext.accumulator(0)

    def ask(texts):
        asked.add(len(texts))
        return [("Travel", 0.7) for _ in texts]

    rows = spark.createDataFrame([("Uber ", "x"), ("uber", "X"), ("Ola", None), (None, None)], "merchant string, description string")
    cache = store.category_keys(rows.limit(1).where("merchant = 'Ola'")).select("key", F.lit("Food").alias("category"), F.lit(1.0).alias("confidence"))
    assert {r.category for r in store.cached_categories(rows, cache, ask).collect()} == {"Travel"} and asked.value == 3


def test_workbook(spark, tmp_path):
    """The first sheet of a workbook, with shared and inline strings and skipped cells."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si><si><r><t>Am</t></r><r><t>ount</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>15/01/2025</t></is></c><c r="C2"><v>5.5</v></c></row></sheetData></worksheet>')
    cells, errors = statements.cells(spark, str(tmp_path))
    assert sorted((r.row, r.pos, r.header, r.value) for r in cells.collect()) == [(0, 0, "Date", "15/01/2025"), (0, 1, "", ""), (0, 2, "Amount", "5.5")] and errors.count() == 0


def test_upsert_in_buckets(spark, tmp_path):
    """Several micro-batches touch some buckets each; untouched ones stay as they are, and old versions go."""
    from passbook.streaming import statements as st

    schema = "k long, v long"
    for n in range(4):
        spark.createDataFrame([(k, n * 100 + k) for k in range(n, 40, n + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = st.event_stream(spark, str(tmp_path / "in"), schema)
        assert st.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], "v", buckets=8).awaitTermination(120) is not False
    want = {k: max(n * 100 + k for n in range(4) if k in range(n, 40, n + 1)) for k in range(40)}
    assert {r.k: r.v for r in st.latest(spark, str(tmp_path / "t"), schema).collect()} == want


def test_grid_settings_and_mapping(spark, tmp_path):
    """Made datasets are registered and served; settings are read from a file; the mapping as a row a file."""
    df = spark.range(60).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") * 1.5).alias("a"))
    none = spark.createDataFrame([], "name string, path string, n_rows long, columns array<string>")
    grid = synthetic.grid(df, none, str(tmp_path / "g"), sizes=(5, 12))
    assert {r.name: r.n_rows for r in grid.collect()} == {"copula-5": 5, "copula-12": 12} and store.served(grid, "copula-12", limit=3).count() == 3
    with pytest.raises(ValueError, match="no dataset"):
        store.served(grid, "copula-7")
    (tmp_path / "s.json").write_text('{"columns": {"date": ["when"]}, "banks": {"Own": ["own bank"]}}')
    given = statements.settings(spark, str(tmp_path / "s.json"))
    cells = spark.createDataFrame([("p", 0, 0, "When", "x")], "path string, row long, pos int, header string, value string")
    row = columns.mapped(columns.column_mapping(cells, given["columns"])).first()
    assert row.date == "When" and row.date_confidence == 1.0 and row.debit is None and row.debit_confidence == 0.0
    assert spark.createDataFrame([("at Own Bank",)], "t string").select(text.bank_of(F.col("t"), given["banks"]).alias("b")).first().b == "Own"
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError):
        statements.settings(spark, str(tmp_path / "bad.json"))


def test_customers_without_transactions(spark, history):
    known = spark.createDataFrame([("c",), ("d",)], "customer_id string")
    got = {r.customer_id: (r.n_transactions, r.merchant_loyalty) for r in behaviour.with_customers(behaviour.summary(history), known).collect()}
    assert got == {"c": (36, 0.2), "d": (0, 0.0)}


def test_tokens_and_cut_tables(spark):
    """Rows of a table over two pages: the header's repeat goes, short rows are padded, long ones joined."""
    rows = [("p", 1, 0, ["Date", "Text", "Sum"]), ("p", 1, 1, ["1", "a"]), ("p", 2, 0, ["date", "TEXT", "x"]), ("p", 2, 1, ["2", "b", "c", "d"])]
    got = tables.joined_tables(spark.createDataFrame(rows, "path string, page int, row int, cells array<string>")).orderBy("page").collect()
    assert [r.cells for r in got] == [["1", "a", ""], ["2", "b", "c d"]]


def test_cells_of_odd_files(spark, tmp_path):
    """Quotes, line breaks in cells, marks of order, bad bytes, rows of other lengths, blank rows, empty files; each equals the csv module."""
    import csv
    import io

    files = {
        "a.csv": b'\xef\xbb\xbfDate, Text \n1,"a ""b"", c"\n\n2,"x\ny"\n , \n3,NA\n', "b.csv": b"Date,Text\n1\n2,x,more\n3,\xff\n", "c.csv": b"", "d.csv": b"A\n", "e.csv": b"A\n1\n\n2\n", "f.csv": b"A,A\n,\n0,\n",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    cells, errors = statements.cells(spark, str(tmp_path))
    got = {(r.path[-5:], r.row, r.pos): (r.header, r.value) for r in cells.collect()}
    want = {}
    for name, raw in files.items():
        head, *rows = [r for r in csv.reader(io.StringIO(raw.decode("utf-8-sig", "replace"))) if any(x.strip() for x in r)] or [[]]
        rows = [r if len(r) <= len(head) else [*r[: len(head) - 1], " ".join(r[len(head) - 1 :])] for r in rows]  # nothing beyond the header is lost
        want |= {(name, i, j): (h.strip(), r[j] if j < len(r) else "") for i, r in enumerate(rows) for j, h in enumerate(head)}
    assert got == want and sorted(r.path[-5:] for r in errors.collect()) == ["d.csv"]  # Spark reads no file of no bytes


def test_cells_of_a_file_are_moved_once(spark):
    """numbering brings a file's rows together; tests of its columns and its rows shuffle none of them again."""
    from pyspark.sql import Window

    rows = spark.range(100).withColumn("path", (F.col("id") % 9).cast("string"))
    rows = rows.withColumn("row", (F.row_number().over(Window.partitionBy("path").orderBy("id")) - 1).cast("long"))
    cells = rows.select("path", "row", F.lit(0).alias("pos"), F.lit("Sum").alias("header"), F.col("id").cast("string").alias("value"))
    assert columns.column_tests(cells)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    mapping = columns.column_layouts(cells)
    assert {c.field for r in mapping.collect() for c in r["columns"]} == {"balance"} and mapping.count() == 9
    moved = canonical.normalised(cells, mapping, signed=columns.signed_amount_columns(cells))[1]._jdf.queryExecution().executedPlan().toString()
    assert moved.count("row_number") >= 1 and "hashpartitioning(path#" in moved and "row#" not in "".join(x for x in moved.splitlines() if "Exchange" in x)


def test_equal_layouts_share_a_mapping(spark):
    """a layout is assigned once, whatever the number of its files; a header of its own, null or repeated, is another layout."""
    cells = [(f"f{i}", r, p, h, v) for i in range(40) for r in range(4) for p, (h, v) in enumerate([("Date", "01/02/2024"), ("Debit", "5.00"), ("x" if i % 2 else None, "z"), ("Debit", "7.00")])]
    df = spark.createDataFrame(cells, "path string, row long, pos int, header string, value string")
    got = columns.column_layouts(df).select("path", F.to_json("columns").alias("c")).collect()
    assert len(got) == 40 and len({r.c for r in got}) == 2
    long = {(r.path, r.pos): r.field for r in columns.column_mapping(df).collect()}
    assert len(long) == 160 and {f for (_, p), f in long.items() if p == 0} == {"date"} and {f for (_, p), f in long.items() if p == 1} == {"debit"}


def test_each_description_is_looked_at_once(spark, monkeypatch):
    """merchants are found for distinct descriptions, in as many tasks as their shuffle has, and rows keep their number."""
    sizes = {}
    keep = canonical.written
    monkeypatch.setattr(canonical, "written", lambda df, label: sizes.setdefault(label, keep(df, label)))
    df = spark.createDataFrame([(i, ["UPI/DR/000000001/Swigy", None, "", "Corner Shop"][i % 4]) for i in range(400)], "id int, description string").coalesce(1)
    got = canonical.with_merchants(df).collect()
    assert sizes["merchants"].count() == 3 and len(got) == 400
    assert {(r.id % 4, r.merchant, r.merchant_confidence) for r in got} == {(0, "Swiggy", 0.909), (1, None, 0.0), (2, None, 0.0), (3, "Corner Shop", 0.4)}
