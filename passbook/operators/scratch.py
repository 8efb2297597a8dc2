"""Tables that are written once in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the checkpoint folder of the session; a local session without either gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-passbook-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: it is worked out once and lost executors cost nothing. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/passbook-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def laid(df: DataFrame, label: str, key: str, parts: int | None) -> DataFrame:
    """``df`` ``written`` in ``parts`` buckets of ``key``: groups, windows and joins by it then move no rows. Without ``parts`` it is written as it comes.

    The catalog knows the files as an external table only until they are read back.
    """
    if parts is None:
        return written(df, label)
    spark = df.sparkSession
    name = f"passbook_{label}_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/{name}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    _gone_at_exit(spark, path)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
