"""Recurring payments: rows of one merchant and direction whose amounts stay in a band and whose dates keep a cadence.

Amounts are clustered in ascending order: an amount joins the current cluster if it is within 10 % (1.0 at least) of
the cluster's running mean. Equal amounts always fall together, so rows are counted by amount first; the fold then reads
the distinct amounts of a key in order, as a stream that holds three numbers, however many there are. It passes over
stretches between sure breaks that hold too few payments. Rows without merchant or without an amount take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import double, variance
from .partials import KINDS, PAYMENT, combined, payment_rows
from .quantiles import quantiles
from .scan import scanned
from .scratch import laid, written

BAND, LEAST_BAND, LEAST_ROWS = 0.10, 1.0, 3
# Cadences by median gap in days.
CADENCES = {"weekly": (4, 10), "monthly": (22, 38), "quarterly": (71, 111)}
LARGE_RENT = 5000
KEY = PAYMENT


def amount_clusters(rows: DataFrame, least: int = 1) -> DataFrame:
    """(key, amount, n, cluster) of the amounts in clusters of at least ``least`` payments; cluster is the smallest amount of it.

    Where ``rows`` have n, each stands for so many payments. The first amounts of a cluster wait until it is large enough.
    """
    counted = rows.groupBy(*KEY, "amount").agg((F.sum("n") if "n" in rows.columns else F.count(F.lit(1))).alias("n"))
    return _folded(counted.repartition(*KEY), least)


def clustered_rows(rows: DataFrame, least: int, together: int | None) -> DataFrame:
    """``rows`` (key, amount, n, more) in clusters of at least ``least`` payments, with their cluster.

    In ``together`` buckets of customers the rows themselves are folded (equal amounts still fall together) and none moves;
    else their distinct amounts are, and rows look theirs up.
    """
    if together is None:
        return rows.join(amount_clusters(rows, least).drop("n"), [*KEY, "amount"])
    # Spark leaves this shuffle out where the rows lie so already.
    return _folded(_in_reach(rows.repartition(together, "customer_id"), least), least)


def _with_cents(rows: DataFrame) -> DataFrame:
    return rows if "cents" in rows.columns else rows.withColumn("cents", (F.col("amount") * 100).cast("decimal(20,0)").cast("long"))


def _in_reach(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (key, amount, n, more) but for those whose stretch between sure breaks has under ``least`` payments; order and place stay.

    Each n is 1 or more, so a stretch with less is within ``least`` - 1 rows on either side. The window also tells Spark that
    buckets count: what only a Python function reads is taken from files in pieces of any size, which may cut a key in two.
    """
    w, cents = Window.partitionBy(*KEY).orderBy("cents"), F.col("cents")
    rows = _with_cents(rows)
    apart = lambda a, b: F.coalesce((a > 0) & (b - a > F.greatest(a * BAND, F.lit(100 * LEAST_BAND)) * (1 + 1e-9)), F.lit(True))
    rows = rows.withColumn("_new", apart(F.lag("cents").over(w), cents))
    total = F.col("n")
    for side, shift in ((F.lag, 0), (F.lead, 1)):
        near = F.lit(True)
        for k in range(1, least):
            # The break between a row and the one before it is marked on the later one.
            near = near & ~(side("_new", k - 1 + shift).over(w) if k - 1 + shift else F.col("_new"))
            total = total + F.when(F.coalesce(near, F.lit(False)), F.coalesce(side("n", k).over(w), F.lit(0))).otherwise(0)
    return rows.withColumn("_near", total).where(F.col("_near") >= least).drop("_new", "_near")


def _folded(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (key, amount, n, more), of which a key is in one partition, with cluster; those of smaller clusters are left out."""
    more = [c for c in rows.columns if c not in (*KEY, "amount", "n", "cents")]
    columns = [*KEY, "cents", "n", *more]
    ordered = _with_cents(rows).select(*columns).sortWithinPartitions(*KEY, "cents")

    # All that the fold calls is within this function, so that it travels with it.
    def same(column: pa.Array) -> np.ndarray:
        """Whether each value but the first is that before it; nulls are equal."""
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

    def apart(before, cents):
        """Whether ``cents`` is in no cluster with ``before``, the next smaller amount: a cluster's mean is not above its largest amount."""
        return (before > 0) & (cents - before > np.maximum(BAND * before, 100 * LEAST_BAND) * (1 + 1e-9))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, total, count, first, mean, waiting = None, 0, 0, 0, 0.0, []
        for b in batches:
            if not b.num_rows:
                continue
            cents, n = b.column("cents").to_numpy(), b.column("n").to_numpy()
            row = lambda i: tuple(b.column(c)[i].as_py() for c in columns)
            new = np.ones(len(cents), bool)
            new[1:] = ~np.logical_and.reduce([same(b.column(k)) for k in KEY]) | apart(cents[:-1], cents[1:])
            new[0] = before is None or before[: len(KEY)] != row(0)[: len(KEY)] or apart(before[len(KEY)], cents[0])
            before = row(len(cents) - 1)
            # Between two sure breaks with too few payments no cluster can be; the first and last stretch may go on in other batches.
            starts = np.union1d([0], np.flatnonzero(new))
            looked = np.add.reduceat(n, starts) >= least
            looked[[0, -1]] = True
            at = np.flatnonzero(np.repeat(looked, np.diff(np.append(starts, len(cents)))))
            old, taken, firsts = [], [], []
            for i, fresh, amount, m in zip(at.tolist(), new[at].tolist(), cents[at].tolist(), n[at].tolist()):
                if not fresh and abs(amount / 100 - mean) <= max(BAND * abs(mean), LEAST_BAND):
                    total, count = total + amount * m, count + m
                else:
                    total, count, first, waiting = amount * m, m, amount, []
                mean = total / 100 / count
                waiting.append(i)
                if count >= least:
                    for w in waiting:
                        if isinstance(w, int):
                            taken.append(w)
                            firsts.append(first)
                        else:
                            old.append((*w, first))
                    waiting = []
            waiting = [row(w) if isinstance(w, int) else w for w in waiting]
            names, kinds = [*columns, "first"], [*[b.schema.field(c).type for c in columns], pa.int64()]
            if old:  # rows of the batches before
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*old), kinds)], names=names)
            found = b.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[found.column(c) for c in names[:-1]], pa.array(firsts, pa.int64())], names=names)

    money = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    found = ordered.mapInArrow(fold, T.StructType([*ordered.schema.fields, T.StructField("first", T.LongType())]))
    return found.select(*KEY, money("cents").alias("amount"), "n", *more, money("first").alias("cluster"))


def clustered(ledger: DataFrame, together: int | None = None) -> DataFrame:
    """Payments (key, amount, date) with their cluster and its number of rows (occurrences), in clusters of at least three."""
    rows = payment_rows(ledger).select(*KEY, "amount", "n", "date")
    # Without buckets rows are asked for twice.
    found = clustered_rows(rows if together else written(rows, "payments"), LEAST_ROWS, together)
    return found.withColumn("occurrences", F.sum("n").over(Window.partitionBy(*KEY, "cluster"))).drop("n")


def _kind(direction: Column, cadence: Column, amount: Column, has: dict[str, Column]) -> Column:
    ordered = F.when((direction == "credit") & has["Loan Repayment"], "Loan Repayment").when(direction == "credit", "Salary")
    for kind in KINDS:
        ordered = ordered.when(has[kind], kind)
    return ordered.when((cadence == "monthly") & (amount >= LARGE_RENT), "Rent").otherwise("Subscription")


def ranked(found: DataFrame) -> DataFrame:
    """``recurring`` with rank: the surest first, then those of more occurrences, then by key and cluster."""
    order = Window.partitionBy("customer_id").orderBy(F.desc("confidence"), F.desc("occurrences"), "merchant", "direction", "cluster")
    return found.withColumn("rank", F.row_number().over(order))


def recurring(ledger: DataFrame, together: int | None = None) -> DataFrame:
    """(key, cluster, category, cadence, median_amount, amount_tolerance, occurrences, regularity, confidence)."""
    payments = combined(payment_rows(ledger), "payments")
    return recurring_of(payments if together else written(payments, "payments"), together)


def recurring_of(payments: DataFrame, together: int | None = None) -> DataFrame:
    """``recurring`` from the table ``payments`` of ``partials``, which lies in ``together`` buckets of customers if given.

    Gaps come from a segmented scan over the times of a cluster, and both medians from counted values, so a merchant with a
    large share of all rows is spread over tasks.
    """
    rows = laid(clustered_rows(payments, LEAST_ROWS, together), "recurring", "customer_id", together)
    group = [*KEY, "cluster"]
    times = rows.groupBy(*group, "date").agg(F.lit(1).alias("one"))
    times = scanned(times, group, ["date"], [F.date_trunc("year", "date")], before={"before": "date"}, small=together is not None)
    gaps = times.select(*group, F.expr("timestampdiff(DAY, before, date)").alias("gap")).where("gap > 0").groupBy(*group, "gap").agg(F.count(F.lit(1)).alias("n"))
    g = F.col("gap").cast("decimal(12,0)")
    spread = gaps.groupBy(*group).agg(F.sum("n").alias("n"), F.sum((g * F.col("n")).cast("decimal(24,0)")).alias("s"), F.sum((g * g * F.col("n")).cast("decimal(38,0)")).alias("ss"))
    spread = spread.join(quantiles(gaps, group, "gap", {"median_gap": 0.5}, most=None), group)
    df = rows.groupBy(*group).agg(F.sum("n").alias("occurrences"), F.bit_or("kinds").alias("kinds"))
    df = df.join(quantiles(rows.groupBy(*group, "amount").agg(F.sum("n").alias("n")), group, "amount", {"median_amount": 0.5}), group).join(spread, group)
    m = F.col("median_gap")
    cadence = F.lit(None).cast("string")
    for name, (low, high) in CADENCES.items():
        cadence = F.when((m >= low) & (m <= high), name).otherwise(cadence)
    df = df.withColumn("cadence", cadence).where(F.col("cadence").isNotNull())
    regularity = 1.0 - F.least(F.sqrt(variance(F.col("n"), F.col("s"), F.col("ss"))) / m, F.lit(1.0))
    df = df.withColumn("regularity", regularity)
    confidence = 0.5 * F.col("regularity") + 0.5 * F.least(double(F.col("occurrences")) / 6.0, F.lit(1.0))
    category = _kind(F.col("direction"), F.col("cadence"), F.col("median_amount"), {k: F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0 for i, k in enumerate(KINDS)})
    return df.select(*KEY, double(F.col("cluster")).alias("cluster"), category.alias("category"), "cadence", "median_amount", F.greatest(F.lit(BAND) * F.col("median_amount"), F.lit(LEAST_BAND)).alias("amount_tolerance"), "occurrences", "regularity", confidence.alias("confidence"))
