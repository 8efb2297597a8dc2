"""As-of and interval joins: the last row of another table at or before a time, and rows whose time lies in an interval.

Both are made of one sorted scan or an equality join on time buckets; no row meets all rows of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import MOST, scanned


def asof(left: DataFrame, right: DataFrame, key: list[str], time: str, values: list[str], *, most: int = MOST) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same key whose ``time`` is not after the left row's; null if there is none.

    The two are put together and each row takes what the last right row before it had, by a segmented scan: a key with any
    share of the rows is spread over tasks. Of right rows of one time that with the largest values counts. Left rows without
    a time have none. ``values`` replace columns of that name.
    """
    cols = [c for c in left.columns if c not in values]
    seen = right.where(F.col(time).isNotNull()).select(*key, time, F.struct(*values).alias("_seen"), F.lit(0).alias("_side"))
    both = left.select(*cols, F.lit(1).alias("_side")).unionByName(seen, allowMissingColumns=True)
    slices = [F.date_trunc("month", time), F.date_trunc("day", time), F.date_trunc("minute", time)]
    found = scanned(both, key, [time, "_side", "_seen"], slices, before={"_was": "_seen"}, most=most).where("_side = 1")
    return found.select(*cols, *[F.col(f"_was.{v}").alias(v) for v in values])


def in_intervals(points: DataFrame, intervals: DataFrame, key: list[str], time: str, start: str, end: str, *, unit: str = "day", pieces: int = 1) -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` of its key for which start <= time < end; other columns must differ.

    Intervals are laid out over the buckets (``unit``: hour, day, week or month) that they touch, points have one bucket, so rows meet on (key,
    bucket) and long intervals do not make pairs of their own. ``pieces`` deals a bucket's points over as many tasks, each with all its
    intervals. Empty or reversed intervals and nulls match nothing.
    """
    bucket = lambda c: F.date_trunc(unit, c)
    names = [f"_k{i}" for i in range(len(key))]
    last = F.col(end) - F.expr("INTERVAL 1 MICROSECOND")
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(last), F.expr(f"INTERVAL 1 {unit}"))))
    spread = spread.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).withColumnsRenamed(dict(zip(key, names)))
    dealt = points.withColumn("_bucket", bucket(F.col(time))).withColumn("_piece", F.pmod(F.xxhash64(*points.columns), F.lit(pieces)).cast("int"))
    met = dealt.join(spread, [*[F.col(k) == F.col(n) for k, n in zip(key, names)], dealt["_bucket"] == spread["_bucket"], dealt["_piece"] == spread["_piece"], F.col(start) <= F.col(time), F.col(time) < F.col(end)])
    return met.drop(*names, "_bucket", "_piece")
