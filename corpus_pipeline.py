"""From raw documents to token ids: each stage is one operator, written as Parquet and read again by the next.

All stages but the last return the columns of documents. ``ORACLE_SQL`` is None, as SQL can't express the learned
score; ``tests/llm/test_pipeline.py`` holds what each stage keeps and changes against plain Python over its own input.

Nulls: a null text is empty to every stage and stays null in what it keeps; a null id is never learned from and never
a copy. Ties and repeated rows: of near copies the smallest id stays, rows that share that id all stay; other stages
judge each row by itself. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import bpe, common, decontaminate, near_copies, quality, secrets

ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the classifier is fitted on labels of these documents."""
    model = quality.trained(docs, common.table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles alike to 0.8 or more."""
    return near_copies.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by the name of its kind; n_chars follows."""
    return secrets.redacted(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), of texts whose ids decode to the text again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encoded(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    return ids.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", hide_secrets),
    ("byte-level BPE", to_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
    return docs
