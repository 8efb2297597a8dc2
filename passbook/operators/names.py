"""Most similar name for each text, by a filtered set join: letters are only compared for pairs that can reach the threshold.

Similarity is that of ``token_set``: over sets of words, 200 * common subsequence / both lengths. Two texts that reach the
threshold either share a word, or, their words sorted and joined, are so alike that their lengths are close and only a
bounded number of letters is inserted or deleted. Each of these touches two pairs of neighbouring letters, which bounds the pairs
in common from below. So texts meet names on words and on the rarest pairs of letters of each (a prefix as long as that
bound allows), then lengths and the number of common pairs have to fit, and what is left is compared letter by letter.

Nulls and blank texts have no name. Of equally similar names the first by ``place`` counts. Repeated texts count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import token_set

LOWEST = 85


def _most(both: Column, least: float) -> Column:
    """Letters that may be inserted or deleted between texts of ``both`` letters in all."""
    return F.floor(both * (100 - least) / 100 + 1e-9)


def _prepared(df: DataFrame, text: str, least: float) -> DataFrame:
    """Distinct words, the sorted text, its length, its pairs of letters (numbered where they repeat) and how many a partner shares at least."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")))
    df = df.withColumn("words", words).where(F.size("words") > 0).withColumn("line", F.array_join("words", " ")).withColumn("size", F.length("line"))
    pairs = F.when(F.col("size") > 1, F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.substring("line", i, F.lit(2)))).otherwise(F.array("line"))
    df = df.withColumn("pairs", pairs)
    numbered = F.transform("pairs", lambda p, i: F.concat_ws("#", p, F.size(F.filter(F.slice("pairs", F.lit(1), i), lambda q: q == p))))
    longest = F.ceil(F.col("size") * (200 - least) / least)
    shared = F.array_min(F.transform(F.sequence(F.col("size"), longest.cast("int")), lambda n: n - 1 - 2 * _most(F.col("size") + n, least)))
    return df.withColumn("pairs", numbered).withColumn("shared", F.greatest(shared, F.lit(1)))


def _keys(df: DataFrame, rarity: DataFrame) -> DataFrame:
    """(id, key): the words, and of the pairs of letters as many of the rarest as leave fewer than ``shared`` out."""
    pairs = df.select("id", "shared", F.size("pairs").alias("n"), F.explode("pairs").alias("key")).join(rarity, "key", "left")
    first = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key"))).alias("all"), F.first(F.greatest(F.col("n") - F.col("shared") + 1, F.lit(1))).cast("int").alias("many"))
    first = first.select("id", F.explode(F.slice("all", F.lit(1), F.col("many"))).alias("k")).select("id", F.concat(F.lit("p:"), F.col("k.key")).alias("key"))
    return first.unionByName(df.select("id", F.explode("words").alias("w")).select("id", F.concat(F.lit("w:"), F.col("w")).alias("key")))


def candidates(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(text, name, place): pairs that pass the filters; all pairs of similarity ``least`` are among them.

    ValueError if ``least`` is under ``LOWEST``: pairs without a word or a pair of letters in common could then be alike enough.
    """
    if least < LOWEST:
        raise ValueError(f"the filters are exact from a similarity of {LOWEST} on")
    a = _prepared(texts.select("text").distinct().withColumn("id", F.col("text")), "text", least)
    b = _prepared(names.select("name", "place").withColumn("id", F.col("name")), "name", least)
    rarity = b.select(F.explode("pairs").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    met = _keys(a, rarity).join(_keys(b, rarity).withColumnRenamed("id", "other"), "key").select("id", "other").distinct()
    pick = lambda df, s: df.select(*[F.col(c).alias(f"{c}{s}") for c in ("id", "words", "size", "pairs")], *[c for c in ("place",) if c in df.columns])
    both = met.join(pick(a, "_a"), F.col("id") == F.col("id_a")).join(pick(b, "_b"), F.col("other") == F.col("id_b"))
    long, short, total = F.greatest("size_a", "size_b"), F.least("size_a", "size_b"), F.col("size_a") + F.col("size_b")
    close = (200 * short >= least * total) & (F.size(F.array_intersect("pairs_a", "pairs_b")) >= long - 1 - 2 * _most(total, least))
    return both.where(F.arrays_overlap("words_a", "words_b") | close).select(F.col("id").alias("text"), F.col("other").alias("name"), "place")


def similar_names(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(text, name, score) of the distinct texts of ``texts`` (text) that have a name of ``names`` (name, place) alike to ``least`` or more."""

    @F.pandas_udf("double")
    def score(a, b):
        import pandas as pd

        return pd.Series([token_set(x, y) for x, y in zip(a, b)], dtype="float64")

    found = candidates(texts, names, least).withColumn("score", score("text", "name")).where(F.col("score") >= least)
    best = F.max_by(F.struct("name", "score"), F.struct("score", -F.col("place")))
    return found.groupBy("text").agg(best.alias("b")).select("text", "b.name", "b.score")
