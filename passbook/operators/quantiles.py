"""Exact quantiles of each key from counted values, by range refinement: no group of rows is ever collected.

Input is how often each value occurs (a mergeable count, combined before its shuffle). Where no key has more than
``MOST`` different values one window over a key's values finds those at the wanted ranks. Else the values are counted in
ranges of ``1 << SHIFTS[0]``, only the ranges that hold a wanted rank are counted in finer ones, and so on down to single
values; a task sees the ranges of one range, whatever share of the rows a key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 1 << 18
#: Bits of a value below each range; a range holds at most 4096 of the next ones.
SHIFTS = (36, 24, 12, 0)


def counted(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, n): how often each value occurs; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))


def _ends(total, p: float):
    """Ranks (from 0) of the two values between which the quantile lies."""
    at = F.lit(p) * (total - 1)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def quantiles(counts: DataFrame, key: list[str], value: str, wanted: dict[str, float], *, most: int | None = MOST) -> DataFrame:
    """(key, a double for each name of ``wanted``): the quantile, interpolated between neighbours, of ``counts`` (key, value, n).

    ``value`` is whole, or a decimal of two places. A key without values has no row; null keys are one key. ``most`` is None where
    few different values are sure (days, cents of a narrow range).
    """
    scale = 100 if dict(counts.dtypes)[value].startswith("decimal") else 1
    c = counts.select(*key, (F.col(value) * scale).cast("long").alias("_v"), F.col("n").cast("long").alias("_m"))
    widest = lambda: c.groupBy(*key).agg(F.count(F.lit(1)).alias("_k")).agg(F.max("_k")).first()[0] or 0
    pick = _in_one if most is None or widest() <= most else _refined
    found = pick(c, key, wanted)
    double = lambda s: F.col(s).cast("double") / scale
    return found.select(*key, *[(double(f"{n}_lo") + (double(f"{n}_hi") - double(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in wanted])


def _in_one(c: DataFrame, key: list[str], wanted: dict[str, float]) -> DataFrame:
    w = Window.partitionBy(*key)
    upto = F.sum("_m").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = c.select(*key, "_v", (upto - F.col("_m")).alias("_first"), upto.alias("_next"), F.sum("_m").over(w).alias("_total"))
    holds = lambda rank: F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_next")), F.col("_v")))
    out = []
    for name, p in wanted.items():
        low, high, part = _ends(F.col("_total"), p)
        out += [holds(low).alias(f"{name}_lo"), holds(high).alias(f"{name}_hi"), F.max(part).alias(f"{name}_part")]
    return rows.groupBy(*key).agg(*out)


def _refined(c: DataFrame, key: list[str], wanted: dict[str, float]) -> DataFrame:
    ends = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("side"), _ends(F.col("_total"), p)[i].alias("rank"), _ends(F.col("_total"), p)[2].alias("part")) for n, p in wanted.items() for i, s in enumerate(("lo", "hi"))])
    # A wanted rank: its key, which end of which quantile, and the rank within the range found so far.
    ranks = c.groupBy(*key).agg(F.sum("_m").alias("_total")).select(*key, F.explode(ends).alias("e")).select(*key, "e.*")
    above: list[str] = []
    rename = lambda df, cols: df.withColumnsRenamed({k: f"_r{k}" for k in cols})
    same = lambda cols: [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in cols]
    for shift in SHIFTS:
        inside = c
        if above:
            inside = c.withColumn("_above", F.shiftright("_v", before)).join(rename(ranks.select(*key, "_above").distinct(), [*key, "_above"]), same([*key, "_above"]), "left_semi")
        bins = inside.groupBy(*key, *above, F.shiftright("_v", shift).alias("_bin")).agg(F.sum("_m").alias("_m"))
        upto = F.sum("_m").over(Window.partitionBy(*key, *above).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.select(*key, *above, "_bin", (upto - F.col("_m")).alias("_first"), upto.alias("_next"))
        hit = ranks.join(rename(bins, [*key, *above]), [*same([*key, *above]), F.col("rank") >= F.col("_first"), F.col("rank") < F.col("_next")])
        ranks = hit.select(*key, "name", "side", "part", (F.col("rank") - F.col("_first")).alias("rank"), F.col("_bin").alias("_above"))
        above, before = ["_above"], shift
    at = lambda n, s, c: F.max(F.when((F.col("name") == n) & (F.col("side") == s), F.col(c)))
    return ranks.groupBy(*key).agg(*[a for n in wanted for a in (at(n, "lo", "_above").alias(f"{n}_lo"), at(n, "hi", "_above").alias(f"{n}_hi"), at(n, "lo", "part").alias(f"{n}_part"))])
