"""Columns that depend on the order of a key's rows, by a segmented prefix scan: no key has to fit one task.

Rows of a key with more than ``MOST`` rows are cut in slices by a coarser form of their order (months, days ...). Each slice
is summed up where its rows are; the sums of the slices are scanned in order, coarsest first; and what came before a slice
enters it as one more row, its first. Then one window within (key, slice) gives every row its place. Whatever share of the
rows a key has, a task sees one slice of it, or one row for each slice. Other keys are one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Rows of a key up to which it is one slice.
MOST = 1_000_000


def _summed(rows: DataFrame, by: list[str], sums: list[str], lasts: list[str], order: list[str]) -> DataFrame:
    """Sums and last values (in ``order``, nulls passed over) of the groups ``by``."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))
    return rows.groupBy(*by).agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums], *[last(c).alias(c) for c in lasts])


def _running(rows: DataFrame, by: list[str], order: list[Column | str], sums: list[str], lasts: list[str], until: int) -> DataFrame:
    """Sums over the rows of a group up to this one (``until`` 0) or the one before (-1); last values always before this row."""
    w = Window.partitionBy(*by).orderBy(F.desc("_carry"), *order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, until), w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({c: F.sum(c).over(upto).cast(rows.schema[c].dataType) for c in sums} | {c: F.last(c, ignorenulls=True).over(before) for c in lasts}).where("_carry = 0").drop("_carry")


def _carries(totals: DataFrame, key: list[str], marks: list[str], sums: list[str], lasts: list[str]) -> DataFrame:
    """What precedes each slice of ``totals`` (a row a slice) within its key."""
    *above, own = marks
    rows = totals.withColumn("_carry", F.lit(0))
    if above:
        upper = _carries(_summed(totals, [*key, *above], sums, lasts, [own]), key, above, sums, lasts)
        rows = rows.unionByName(upper.withColumn("_carry", F.lit(1)), allowMissingColumns=True)
    return _running(rows, [*key, *above], [own], sums, lasts, -1)


def scanned(df: DataFrame, key: list[str], order: list[str], slices: list[Column], *, number: str | None = None, sums: dict[str, Column] | None = None, before: dict[str, str] | None = None, most: int = MOST, small: bool = False) -> DataFrame:
    """``df`` with the row's number within its key (``number``), running sums (name -> summed column) and the last value of
    other columns before the row (name -> column, nulls passed over).

    ``slices`` are columns that never fall along ``order``, coarse ones first. Null sums count as nothing; nulls of ``order`` come
    first; among rows equal in ``order`` the sequence is arbitrary. Names that begin with ``_`` are taken. ``small`` says that no
    key has over ``most`` rows; else they are counted.
    """
    sums, before = sums or {}, before or {}
    marks, adds, lasts = [f"_slice{i}" for i in range(len(slices))], ["_n", *[f"_sum{i}" for i in range(len(sums))]], [f"_last{i}" for i in range(len(before))]
    large = None if small else written(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]), "large")  # rows / ``most`` at most
    if large is None or large.isEmpty():
        marks = []
    else:
        df = df.join(large.withColumn("_large", F.lit(True)), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], "left").drop(*large.columns)
        slices = [F.when(F.col("_large"), s) for s in slices]
    work = df.withColumns(dict(zip(marks, slices)) | {"_n": F.lit(1).cast("long")} | dict(zip(adds[1:], sums.values())) | {c: F.col(v) for c, v in zip(lasts, before.values())})
    both = work.withColumn("_carry", F.lit(0))
    if marks:
        carries = _carries(_summed(work.where("_large"), [*key, *marks], adds, lasts, order), key, marks, adds, lasts)
        both = both.unionByName(carries.withColumn("_carry", F.lit(1)), allowMissingColumns=True)
    out = _running(both, [*key, *marks], order, adds, lasts, 0)
    names = dict(zip(adds[1:], sums)) | dict(zip(lasts, before)) | ({"_n": number} if number else {})
    return out.drop(*marks, "_large", *([] if number else ["_n"])).withColumnsRenamed(names)
