"""Stored tables: upserts by key, queues and caches, and the queries that serve them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the largest ``order`` for each key; of equal ones the new table's. One aggregate, no sort."""
    cols = old.columns
    both = old.select(F.struct(*cols).alias("r"), F.lit(0).alias("fresh")).unionByName(new.select(F.struct(*cols).alias("r"), F.lit(1).alias("fresh")))
    best = both.groupBy(*[F.col(f"r.{k}").alias(f"_{k}") for k in key]).agg(F.max_by("r", F.struct(F.col(f"r.{order}"), F.col("fresh"))).alias("r"))
    return best.select("r.*")


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def enrichment(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(merchant, payload, source): the payload of a successful entry of the cache, else source ``queued``."""
    good = cache.where("success").select("merchant", "payload", F.lit("cache").alias("hit"))
    return wanted.join(good, "merchant", "left").select("merchant", "payload", F.coalesce("hit", F.lit("queued")).alias("source"))


def queue_additions(wanted: DataFrame, cache: DataFrame, queue: DataFrame) -> DataFrame:
    """Merchants to look up: no successful entry in the cache and not queued yet."""
    return wanted.select("merchant").distinct().join(cache.where("success"), "merchant", "left_anti").join(queue, "merchant", "left_anti")


def drained(queue: DataFrame, fetch, schema: str = "payload string, success boolean, error string") -> DataFrame:
    """(merchant, payload, success, error): ``fetch(list of merchants)`` gives a tuple for each; runs where the rows are."""

    def run(batches):
        import pandas as pd

        for df in batches:
            got = pd.DataFrame(fetch(df["merchant"].tolist()), columns=["payload", "success", "error"])
            yield pd.concat([df[["merchant"]].reset_index(drop=True), got], axis=1)

    return queue.select("merchant").mapInPandas(run, f"merchant string, {schema}")


def after_drain(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue without what succeeded; attempts and last_error of the others go on."""
    r = results.select("merchant", "success", "error")
    df = queue.join(r, "merchant", "left").where(~F.coalesce("success", F.lit(False)))
    tried = F.col("success").isNotNull()
    return df.select("merchant", "queued_at", (F.coalesce("attempts", F.lit(0)) + tried.cast("int")).alias("attempts"), F.coalesce("error", "last_error").alias("last_error"))


def category_keys(df: DataFrame) -> DataFrame:
    """``df`` with key: a hash of merchant and description, whatever their case and outer blanks."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return df.withColumn("key", F.sha2(F.concat(plain("merchant"), F.lit("\n"), plain("description")), 256))


def cached_categories(df: DataFrame, cache: DataFrame, ask) -> DataFrame:
    """``df`` with category and category_confidence: from ``cache`` (key, category, confidence), else from ``ask``.

    ``ask(list of texts)`` gives (category, confidence) for each; a key that the cache lacks is asked once.
    """
    keyed = category_keys(df)
    kept = cache.groupBy("key").agg(F.max_by(F.struct("category", "confidence"), "confidence").alias("known"))
    text = F.trim(F.concat_ws(" ", "merchant", "description"))
    unknown = keyed.join(kept, "key", "left_anti").groupBy("key").agg(F.min(text).alias("text"))

    def run(batches):
        import pandas as pd

        for b in batches:
            got = pd.DataFrame(ask(b["text"].tolist()), columns=["category", "confidence"])
            yield pd.concat([b[["key"]].reset_index(drop=True), got], axis=1)

    asked = unknown.mapInPandas(run, "key string, category string, confidence double").select("key", F.struct("category", "confidence").alias("known"))
    out = keyed.join(kept.unionByName(asked), "key", "left")
    return out.withColumn("category", F.col("known.category")).withColumn("category_confidence", F.col("known.confidence")).drop("known", "key")


def registered(datasets: DataFrame, df: DataFrame, name: str, path: str) -> DataFrame:
    """The registry (name, path, n_rows, columns) with ``df`` written to ``path`` under ``name``; a name is there once."""
    save(df, path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
    new = rows.select(F.lit(name).alias("name"), F.lit(path).alias("path"), "n_rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
    return datasets.where(F.col("name") != name).unionByName(new)


def served(datasets: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows, which is the feature, of a registered dataset; ValueError if there is none of that name."""
    found = datasets.where(F.col("name") == name).select("path").limit(1).collect()
    if not found:
        raise ValueError(f"no dataset {name}")
    return datasets.sparkSession.read.parquet(found[0]["path"]).limit(limit)


def transactions(df: DataFrame, *, customer_id=None, category: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, ties by transaction_id; a page of ``limit`` rows, which is the feature."""
    if customer_id is not None:
        df = df.where(F.col("customer_id") == customer_id)
    if category is not None:
        df = df.where(F.col("category") == category)
    return df.orderBy(F.desc("date"), "transaction_id").offset(offset).limit(limit)


def table_summary(df: DataFrame) -> DataFrame:
    """(column, n_rows, mean): mean of each numeric column, null for others; one pass."""
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).cast("double").alias(f"m{i}") for i, c in enumerate(df.columns) if c in numeric])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col(f"m{i}") if c in numeric else F.lit(None).cast("double")).alias("mean")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def sql_over_csv(spark: SparkSession, statement: str, **paths: str) -> DataFrame:
    """``statement`` over CSV files as views of the given names."""
    return spark.sql(statement, **{n: spark.read.csv(p, header=True, inferSchema=True) for n, p in paths.items()})
