"""Streams: windows over events, transactions that are upserted into a table, and feature rows and profiles kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import profile
from ..operators.partials import PARTS, combined, partials
from ..operators.store import upserted


#: Parts of an upserted table by the hash of its key; a micro-batch rewrites those that it touches.
BUCKETS = 64


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): rows and value by type; also runs on a batch DataFrame."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if events.isStreaming else ts
    return ts.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n): events of a user less than ``gap`` apart."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if events.isStreaming else ts
    df = ts.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return df.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def _in_windows(events: DataFrame, length: str, slide: str) -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.select("*", F.window("ts", length, slide).alias("w"))


def _window_sums(rows: DataFrame) -> DataFrame:
    value = F.coalesce(F.col("value").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return rows.groupBy("event_type", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("decimal(28,2)").alias("total"))


def sliding(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """(event_type, window_start, window_end, n, total): rows and value by type in overlapping windows. A row without ts is in none."""
    return _window_sums(_in_windows(events, length, slide))


#: Columns of the table that ``sliding_stream`` keeps.
SLIDING = "event_type string, window_start timestamp, window_end timestamp, n bigint, total decimal(28,2)"


def sliding_stream(stream: DataFrame, path: str, checkpoint: str, *, length: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep ``sliding`` of a stream under ``path``/windows (read it with ``latest``) and lose no late row.

    The watermark of a batch is the newest ts of the batches before it less ``late``. A window that ends at or before it is
    closed and does not change; a row that belongs to closed windows goes to ``path``/late once for each of these, with
    ``missed_start`` and ``missed_end``, and still counts in those of its windows that are open. So windows and late rows
    together are those of the whole input. A batch merges its sums into the buckets (by window) it touches; one that is run again starts from the
    versions before it. Rows without ts are late for nothing and in no window.
    """
    spark = stream.sparkSession
    spot = F.pmod(F.xxhash64("window_start"), F.lit(buckets)).cast("int")

    def take(batch: DataFrame, number: int) -> None:
        before = [v for v in _listed(spark, f"{path}/clock", "batch") if v < number]
        clock = spark.read.schema("newest timestamp").parquet(f"{path}/clock/batch={before[-1]}") if before else spark.createDataFrame([(None,)], "newest timestamp")
        newest = clock.first()[0]
        mark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        rows = _in_windows(batch, length, slide).withColumn("closed", F.coalesce(F.col("w.end") <= mark, F.lit(False)))
        new = _window_sums(rows.where("NOT closed")).withColumn("bucket", spot)
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # ``buckets`` at most
        if touched:
            old = _read(spark, f"{path}/windows", {b: v for b, v in _versions(spark, f"{path}/windows", before=number).items() if b in touched}, SLIDING)
            sums = old.unionByName(new.drop("bucket")).groupBy("event_type", "window_start", "window_end").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"))
            sums.withColumn("bucket", spot).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/windows/version={number}")
            _drop_older(spark, f"{path}/windows", touched, number)
        behind = rows.where("closed").select(*batch.columns, F.col("w.start").alias("missed_start"), F.col("w.end").alias("missed_end"))
        behind.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        top = batch.agg(F.greatest(F.max(F.col("ts").cast("timestamp")), F.lit(newest).cast("timestamp")).alias("newest"))
        top.write.mode("overwrite").parquet(f"{path}/clock/batch={number}")
        for v in before[:-1]:
            place, fs = _folder(spark, f"{path}/clock/batch={v}")
            fs.delete(place, True)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to ``path`` until the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str, *, buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert each micro-batch into the table at ``path``: the buckets it touches get a new version, the newest counts.

    A batch that is run again writes the same versions again from the ones before it, so each row takes effect once;
    versions that no batch can be run from any more are removed.
    """
    spark = stream.sparkSession
    spot = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("bucket", spot)
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # ``buckets`` at most
        if not touched:
            return
        old = _read(spark, path, {b: v for b, v in _versions(spark, path, before=number).items() if b in touched}, batch.schema)
        upserted(old, batch, key, order).withColumn("bucket", spot).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        _drop_older(spark, path, touched, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Tables that ``feature_stream`` keeps up to date, and how they are worked out from mergeable sums.
KEPT = {"features": profile.features_of, "profiles": profile.profiles_of}


def feature_stream(stream: DataFrame, path: str, checkpoint: str, *, tables: tuple[str, ...] = tuple(KEPT), buckets: int = BUCKETS) -> StreamingQuery:
    """Feature rows and profiles that take in each micro-batch of new transactions; the old ones are never read again.

    Under ``path`` are the mergeable sums of all transactions so far (see ``partials``) and the ``tables`` made of them, in
    ``buckets`` by customer; a batch merges its own sums into those of the buckets it touches and makes only their rows
    anew. Each transaction has to come once; a batch that is run again starts from the versions before it. Read the tables
    with ``latest``.
    """
    spark = stream.sparkSession
    spot = F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int")

    def put(df: DataFrame, name: str, number: int) -> None:
        df.withColumn("bucket", spot).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/version={number}")

    def take(batch: DataFrame, number: int) -> None:
        touched = {r.bucket for r in batch.select(spot.alias("bucket")).distinct().collect()}  # ``buckets`` at most
        if not touched:
            return
        of = lambda name, before: {b: v for b, v in _versions(spark, f"{path}/{name}", before=before).items() if b in touched}
        now = {}
        for name, new in partials(batch).items():
            old = _read(spark, f"{path}/{name}", of(name, number), new.schema)
            put(combined(old.unionByName(new), name), name, number)
            now[name] = _read(spark, f"{path}/{name}", of(name, number + 1), new.schema)
        for name in tables:
            put(KEPT[name](now), name, number)
        for name in (*PARTS, *tables):
            _drop_older(spark, f"{path}/{name}", touched, number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str, name: str) -> list[int]:
    place, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> its newest version (under ``before``)."""
    found: dict[int, int] = {}
    for v in _listed(spark, path, "version"):
        if before is None or v < before:
            found |= dict.fromkeys(_listed(spark, f"{path}/version={v}", "bucket"), v)
    return found


def _drop_older(spark: SparkSession, path: str, touched: set[int], number: int) -> None:
    """Of each touched bucket only version ``number`` and the one before it stay."""
    last = _versions(spark, path, before=number)
    for v in _listed(spark, path, "version"):
        for b in touched.intersection(_listed(spark, f"{path}/version={v}", "bucket")):
            if v < last.get(b, number):
                place, fs = _folder(spark, f"{path}/version={v}/bucket={b}")
                fs.delete(place, True)


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema) -> DataFrame:
    paths = [f"{path}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table written by ``upsert_stream``, each bucket in its newest version; empty if there is none."""
    return _read(spark, path, _versions(spark, path), schema)
