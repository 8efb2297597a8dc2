"""Dates in many forms, as-of and interval joins, similar names, ragged files, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from passbook.functions import rules, similarity, text
from passbook.operators import asof, canonical, names, synthetic
from passbook.sources import statements

D = dt.datetime
DATES = {
    "15/01/2025": D(2025, 1, 15), "1-2-25": D(2025, 2, 1), "03.04.1999": D(1999, 4, 3), "5 6 2020": D(2020, 6, 5), "01/25/2024": D(2024, 1, 25), "13/13/2024": None, "31/02/2024": None, "29/02/2024": D(2024, 2, 29),
    "31/12/75": D(1975, 12, 31), "31/12/74": D(2074, 12, 31), "2025-01-10": D(2025, 1, 10), "2025/1/9": D(2025, 1, 9), "2025.03.04": D(2025, 3, 4), "20250304": D(2025, 3, 4), "2025-02-03T04:05:06Z": D(2025, 2, 3, 4, 5, 6),
    "2025-02-03 04:05:06.789+05:30": D(2025, 2, 3, 4, 5, 6), "15 Jan 2025": D(2025, 1, 15), "15-JAN-25": D(2025, 1, 15), "1st March, 2024": D(2024, 3, 1), "22nd of June 2024": None, "15january2025": D(2025, 1, 15), "Jan 15, 2025": D(2025, 1, 15),
    "September 3rd 2021 7:08 pm": D(2021, 9, 3, 19, 8), "Sept 3 2021, 12:00 AM": D(2021, 9, 3), "Mon, 6 Jan 2025 23:59": D(2025, 1, 6, 23, 59), "Wednesday 5/2/2025 9:30": D(2025, 2, 5, 9, 30), "15/01/2025 25:00": None,
    " 15/01/2025 ": D(2025, 1, 15), "": None, None: None, "nan": None, "12.50": None, "1,200.50": None, "Janitor 5 2020": None, "99999": None, "0/0/2020": None, "x" * 5000: None,
}


def test_dates(spark):
    df = spark.createDataFrame([(s,) for s in DATES], "s string").select("s", text.statement_date(F.col("s")).alias("d"), text.statement_date(F.col("s"), compat=True).alias("c"))
    got = {r.s: (r.d, r.c) for r in df.collect()}
    assert {s: d for s, (d, _) in got.items()} == DATES
    assert got["2025-01-10"][1] == D(2025, 10, 1) and got["2025/1/9"][1] == D(2025, 9, 1) and got["15/01/2025"][1] == D(2025, 1, 15)


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Date,Text,Sum\n1/1/2025,a\n2/1/2025,b,3,4,5\n3/1/2025,c,6\n")
    cells, errors = statements.cells(spark, str(tmp_path))
    assert errors.count() == 0
    assert {(r.row, r.pos): r.value for r in cells.collect() if r.pos > 0} == {(0, 1): "a", (0, 2): "", (1, 1): "b", (1, 2): "3 4 5", (2, 1): "c", (2, 2): "6"}


@pytest.mark.parametrize("most", [0, 10**6])
def test_asof(spark, most):
    rng = random.Random(most)
    when = lambda: None if rng.random() < 0.02 else D(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 70, 30))
    right = [(rng.choice("aaab"), when(), rng.choice([None, *range(9)])) for _ in range(300)]
    left = [(rng.choice(["a", "b", "c", None]), when(), i, "old") for i in range(400)]
    l, r = spark.createDataFrame(left, "k string, t timestamp_ntz, id int, v string"), spark.createDataFrame(right, "k string, t timestamp_ntz, v int")
    got = {x.id: x.v for x in asof.asof(l, r, ["k"], "t", ["v"], most=most).collect()}

    def want(k, t):
        before = [(u, -1 if v is None else v) for q, u, v in right if q == k and t is not None and u is not None and u <= t]
        v = max(before)[1] if before else -1
        return None if v < 0 else v

    assert got == {i: want(k, t) for k, t, i, _ in left}


@pytest.mark.parametrize("unit, pieces", [("day", 1), ("month", 3)])
def test_intervals(spark, unit, pieces):
    rng = random.Random(pieces)
    points = [(rng.choice("aab"), D(2024, 1, 1) + dt.timedelta(hours=rng.randrange(2000)), i) for i in range(300)]
    spans = [(rng.choice("ab"), s := D(2024, 1, 1) + dt.timedelta(hours=rng.randrange(2000)), s + dt.timedelta(hours=rng.choice([-5, 0, 1, 24, 300])), i) for i in range(60)] + [("a", None, D(2024, 2, 1), 98), (None, D(2024, 1, 1), D(2024, 2, 1), 99)]
    p, s = spark.createDataFrame(points, "k string, t timestamp_ntz, id int"), spark.createDataFrame(spans, "k string, s timestamp_ntz, e timestamp_ntz, span int")
    got = sorted((r.id, r.span) for r in asof.in_intervals(p, s, ["k"], "t", "s", "e", unit=unit, pieces=pieces).collect())
    assert got == sorted((i, j) for k, t, i in points for q, a, b, j in spans if q == k and a and a <= t < b)


def misspelt(rng, name):
    for _ in range(rng.choice([0, 1, 1, 2])):
        i = rng.randrange(len(name) + 1)
        name = rng.choice([name[:i] + name[i + 1 :], name[:i] + rng.choice("abxyz ") + name[i:], name[:i] + rng.choice("qz") + name[i + 1 :]])
    return " ".join(rng.sample(words := name.split(), len(words)))


@pytest.mark.parametrize("least", [85, 88, 95])
def test_similar_names(spark, least):
    """The filtered join gives what comparing all pairs gives."""
    rng = random.Random(least)
    known = [*rules.MERCHANTS, "Ola", "A", "Bo", "State Bank of India", "India State Transport", "aaaa bbbb aaaa"]
    texts = list({misspelt(rng, rng.choice(known)) for _ in range(500)} | {"", " ", "zzz", "India", "Bank", "a" * 500}) + [None]
    df, named = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(list(enumerate(known)), "place int, name string")
    got = {r.text: (r.name, r.score) for r in names.similar_names(df, named, least).collect()}
    want = {}
    for t in filter(None, texts):
        score, place = max((similarity.token_set(t, n), -i) for i, n in enumerate(known))
        if score >= least:
            want[t] = (known[-place], score)
    assert got == want and len(want) > 50
    with pytest.raises(ValueError):
        names.similar_names(df, named, 50)


def test_ingest_is_strict_when_asked(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,Particulars,Value\n01/02/2025,UPI/Netflixx,-499\n02/02/2025,NEFT SALARY,5000\nnever,x,1\n")
    cells, _ = statements.cells(spark, str(tmp_path))
    ok, bad = canonical.ingested(cells, strict=True)
    assert {(r.merchant, float(r.debit or 0), float(r.credit or 0)) for r in ok.collect()} >= {("Netflix", 499.0, 0.0)} and bad.count() == 1
    for nothing in (cells.limit(0), cells.withColumn("value", F.lit("x"))):
        with pytest.raises(ValueError):
            canonical.ingested(nothing, strict=True)


@pytest.mark.parametrize("most", [0, 10**6])
def test_distances(spark, most):
    """The exact statistic, whether or not the column is cut in slices."""
    rng = random.Random(most)
    a, b = [(rng.choice([None, rng.random(), rng.randrange(5)]),) for _ in range(800)], [(rng.choice([rng.random() ** 2, 3.0]),) for _ in range(300)]
    frame = lambda rows: spark.createDataFrame([(None if v is None else float(v), 1.0) for (v,) in rows], "v double, same double")
    got = {r.column: r.statistic for r in synthetic.distances(frame(a), frame(b), ["v", "same"], most=most).collect()}
    x, y = [v for (v,) in a if v is not None], [v for (v,) in b]
    want = max(abs(sum(i <= v for i in x) / len(x) - sum(i <= v for i in y) / len(y)) for v in {*x, *y})
    assert abs(got["v"] - want) < 1e-12 and got["same"] == 0.0


def test_copula_of_categories(spark):
    """Made rows have the shares of each value and go along with the numbers as the real ones do."""
    rng = random.Random(1)
    rows = [(f"c{i}", x := rng.gauss(0, 1), (None if x < -0.5 else "mid" if x < 1 else "top"), rng.choice("aab")) for i in range(4000)]
    real = spark.createDataFrame(rows, "customer_id string, x double, size string, kind string")
    made = synthetic.copula_samples(real, 10_000)
    assert made.columns == ["customer_id", "x", "size", "kind"]
    for c in ("size", "kind"):
        shares = [{r[c]: r["count"] / n for r in df.groupBy(c).count().collect()} for df, n in ((real, 4000), (made, 10_000))]
        assert shares[0].keys() == shares[1].keys() and all(abs(shares[0][v] - shares[1][v]) < 0.02 for v in shares[0])
    mean = {r["size"]: r.m for r in made.groupBy("size").agg(F.avg("x").alias("m")).collect()}
    assert mean[None] < mean["mid"] - 0.5 < mean["top"] - 1  # values are in order, null first
    assert synthetic.contingency(real, made, "size", "kind").first().similarity > 0.95
    for bad in (real.limit(0), real.select("customer_id"), real.select("customer_id", F.col("customer_id").alias("other"))):
        with pytest.raises(ValueError):
            synthetic.copula_samples(bad, 10)
