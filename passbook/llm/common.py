"""Helpers shared by the training-data operators: scratch space, row packing, file bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint folder of the session.

    Where neither is set a local session (tests) gets a temporary one; a cluster is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-passbook-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Rows in a batch between Spark and Python: documents are long, and a batch is in memory on both sides.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Let no batch hold more than ``BATCH_ROWS`` rows; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_root(spark)}/passbook-{label}-{uuid.uuid4().hex}"


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """Scratch files last as long as the driver: what was read from them may still be asked for."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    _gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` written once in the shared folder and read back in buckets of ``key``: a join or cogroup on it moves nothing.

    The catalog knows the files as an external table only until they are read back; no name stays in it.
    """
    spark = df.sparkSession
    name = f"passbook_{label}_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/{name}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key)
    writer.option("path", path).option("compression", "zstd").saveAsTable(name)
    _gone_at_exit(spark, path)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def packed(df: DataFrame, keep: list[str] | None = None, **columns) -> DataFrame:
    """Input columns packed in one struct ``row`` (so that no name can clash) beside the named working columns."""
    bounded_batches(df.sparkSession)
    cols = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    row = F.struct(*cols) if cols else F.struct(F.lit(None).cast("int").alias("_"))
    return df.select(row.alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, **columns) -> DataFrame:
    """The packed columns again, with results added; a result replaces an input column of the same name."""
    old = [f.name for f in df.schema["row"].dataType.fields if f.name not in columns and f.name != "_"]
    return df.select(*[F.col("row").getField(c).alias(c) for c in old], *[c.alias(n) for n, c in columns.items()])


def with_row(df: DataFrame, ddl: str) -> T.StructType:
    """Schema of the packed ``row`` of ``df`` followed by the columns of ``ddl``."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
