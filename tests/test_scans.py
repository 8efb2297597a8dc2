"""Segmented scans, exact quantiles, mergeable sums and the tables they keep, against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passbook.operators import behaviour, partials, profile, quantiles, recurring, scan
from passbook.streaming import statements

WORDS = ["netflix", "house rent", "Acme", None, "", "sip groww"]


def ledger_rows(n=900, seed=5, customers=7):
    """Transactions of which one customer has more than a third."""
    rng, rows, balance, seq = random.Random(seed), [], {}, {}
    for _ in range(n):
        c = 0 if rng.random() < 0.4 else rng.randrange(1, customers)
        when = dt.datetime(2023, 1, 1) + dt.timedelta(days=30 * rng.randrange(20) + rng.randrange(2), seconds=rng.choice([0, 0, 40_000]))
        rows.append([c, when, rng.choice(WORDS), rng.choice(["to shop", "LIC premium", None]), rng.choice([99, 99, 100, 4999, 5200, rng.randrange(1, 900000)]), rng.random() < 0.3, rng.choice(["Food", "Salary", "EMI", None]), rng.choice(["UPI", "ATM", None])])
    out = []
    for c, when, merchant, text, cents, credit, category, mode in sorted(rows, key=lambda r: (r[0], r[1])):
        balance[c], seq[c] = balance.get(c, 0) + (cents if credit else -cents), seq.get(c, 0) + 1
        money = lambda x: f"{x / 100:.2f}"
        out.append((c, when, seq[c], merchant, text, None if credit else money(cents), money(cents) if credit else None, None if rng.random() < 0.1 else money(balance[c]), category, mode))
    return out


@pytest.fixture(scope="module")
def ledger(spark):
    raw = spark.createDataFrame(ledger_rows(), "customer_id long, date timestamp_ntz, seq long, merchant string, description string, debit string, credit string, balance string, category string, payment_mode string")
    return raw.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit", "credit", "balance")})


@pytest.mark.parametrize("levels, most", [(1, 0), (2, 0), (3, 0), (2, 400), (2, 10**6)])
def test_scan(spark, levels, most):
    rng = random.Random(levels)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(200)]), i, rng.choice([None, rng.randrange(-50, 50)]), rng.choice([None, f"v{i}"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t int, id int, x long, v string")
    slices = [F.floor(F.col("t") / 50), F.floor(F.col("t") / 10), F.col("t")][:levels]
    out = scan.scanned(df, ["k"], ["t", "id"], slices, number="nr", sums={"run": F.col("x")}, before={"was": "v"}, most=most)
    got, want, state = {r.id: (r.nr, r.run, r.was) for r in out.collect()}, {}, {}
    for k, _, i, x, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        nr, run, was = state.get(k, (0, None, None))
        run = run if x is None else (run or 0) + x
        want[i] = (nr + 1, run, was)
        state[k] = (nr + 1, run, v if v is not None else was)
    assert got == want and out.columns == [*df.columns, "nr", "run", "was"]
    assert scan.scanned(df.limit(0), ["k"], ["t"], slices, number="nr").count() == 0


def test_scan_spreads_a_hot_key(spark):
    """No task of the scan sees more rows than a slice has, though one key has all of them."""
    df = spark.range(20_000).select(F.when(F.col("id") >= 0, 1).otherwise(2).alias("k"), F.col("id").alias("t"))
    out = scan.scanned(df, ["k"], ["t"], [F.floor(F.col("t") / 4000), F.floor(F.col("t") / 200)], number="nr", most=1000)
    sizes = [r.n for r in out.repartition(1).groupBy(F.floor(F.col("t") / 200)).agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert max(sizes) == 200 and out.where("nr <> t + 1").count() == 0
    rows_window = [line for line in plan.split("\n") if "hashpartitioning" in line and "_slice1" in line]
    assert rows_window and "SinglePartition" not in plan


@pytest.mark.parametrize("most", [None, 0])
def test_quantiles(spark, most):
    rng = random.Random(9)
    rows = [(k, rng.choice([rng.randrange(-10**6, 10**6), rng.randrange(5), 10**13 + rng.randrange(9)])) for k in ("a", "b", None, "hot", "hot") for _ in range(rng.randrange(1, 400))] + [("one", 7)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: (r.low, r.mid, r.up) for r in quantiles.quantiles(quantiles.counted(df, ["k"], "v"), ["k"], "v", {"low": 0.0, "mid": 0.5, "up": 0.75}, most=most).collect()}
    for k in {k for k, _ in rows}:
        assert np.allclose(got[k], np.quantile([v for q, v in rows if q == k], [0, 0.5, 0.75]), rtol=1e-12), k
    money = quantiles.quantiles(quantiles.counted(df.select("k", (F.col("v") % 1000 / 100).cast("decimal(18,2)").alias("v")), ["k"], "v"), ["k"], "v", {"m": 0.5}, most=most).where("k = 'one'").first()
    assert money.m == 0.07 and quantiles.quantiles(quantiles.counted(df.limit(0), ["k"], "v"), ["k"], "v", {"m": 0.5}, most=most).count() == 0


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def test_merged_in_any_parts(ledger):
    """Sums of any division of the ledger, merged in any order, are the sums of all of it."""
    whole = partials.partials(ledger)
    part = F.pmod(F.xxhash64("customer_id", "seq"), F.lit(4))
    sets = [partials.partials(ledger.where(part == k)) for k in (2, 0, 3, 1)]
    both = partials.merged(partials.merged(*sets[:3]), sets[3], partials.partials(ledger.limit(0)))
    for name in whole:
        assert plain(both[name].select(*whole[name].columns).collect()) == plain(whole[name].collect()), name


def test_features_and_profiles_by_batches(spark, ledger, tmp_path):
    """Tables that took in a stream are those of the whole ledger; buckets that a batch does not touch stay as they are."""
    source, path = str(tmp_path / "in"), str(tmp_path / "kept")
    batches = [ledger.where("seq % 3 = 0 AND customer_id <> 6"), ledger.where("seq % 3 = 1 AND customer_id IN (0, 1)"), ledger.where("NOT (seq % 3 = 0 AND customer_id <> 6) AND NOT (seq % 3 = 1 AND customer_id IN (0, 1))")]
    written = []
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 1).parquet(source)
        statements.feature_stream(stream, path, str(tmp_path / "cp"), buckets=8).awaitTermination()
        written.append(statements._versions(spark, f"{path}/features"))
    assert [sum(v != w.get(b) for b, v in now.items()) for w, now in zip([{}, *written], written)][1] <= 2
    want = {"features": profile.feature_table(ledger), "profiles": profile.profiles(ledger)}
    for name, df in want.items():
        got = statements.latest(spark, f"{path}/{name}", df.schema)
        assert plain(got.collect()) == plain(df.collect()), name


def test_daily_trend(ledger):
    days = {}
    for r in ledger.where("balance IS NOT NULL").collect():
        days.setdefault(r.customer_id, []).append((r.date, float(r.balance)))
    got = {r.customer_id: r.balance_daily_trend for r in behaviour.daily_trend(ledger).collect()}
    for c, rows in days.items():
        first = min(d for d, _ in rows)
        x, y = [(d - first).days for d, _ in rows], [v for _, v in rows]
        assert abs(got[c] - np.polyfit(x, y, 1)[0]) < 1e-6 * max(1, abs(got[c]))


def test_recurring_of_a_hot_merchant(spark):
    """A merchant with nearly all rows: gaps and medians are those of plain Python."""
    rng = random.Random(3)
    days = sorted(rng.sample(range(0, 3000, 7), 300))
    rows = [(1, dt.datetime(2015, 1, 1) + dt.timedelta(days=d), k, "Gym", None, f"{rng.choice([10, 10, 10.5]):.2f}", None, None, None, None) for k, d in enumerate(days)]
    df = spark.createDataFrame(rows, "customer_id long, date timestamp_ntz, seq long, merchant string, description string, debit string, credit string, balance string, category string, payment_mode string")
    df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit", "credit", "balance")})
    (r,) = recurring.recurring(df).collect()
    gaps = np.diff(days)
    assert r.cadence == ("weekly" if 4 <= np.median(gaps) <= 10 else "monthly") and r.occurrences == 300
    assert abs(r.regularity - (1 - min(gaps.std() / np.median(gaps), 1))) < 1e-9 and r.median_amount == np.median([float(x[5]) for x in rows])
