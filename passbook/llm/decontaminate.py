"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of ``window`` consecutive words (an item of fewer words is one window). A window is
a set of word-pair shingles with offsets. Containment of a whole window needs every shingle, so the necessary
prefix is one shingle: the rarest, by counts over all documents. All words of the documents are read once: those pairs
that the benchmark has at all are written with their words and counted, and the prefixes chosen from these counts.
Documents meet windows on the prefix alone; the place of the match gives the only possible start, which length and
position bounds check, and then every pair of the window has to stand at its place, word by word. Windows have a
number; their words come in only there, and the items of a window only after that.

Nulls: a null text has no words; a null item has no windows. Ties in rarity go to the first offset. Repeated
documents are each judged; repeated items share their windows and are each reported. Very long texts have a row for
each pair that the benchmark has, nothing else. Extra columns pass through; an input column named like a result is
replaced. Empty tables give zero hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of at most ``ROW_BYTES`` bytes each (hashes and numbers) that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS, ROW_BYTES = 500_000, 32


def normal_text(text: Column) -> Column:
    """Words in lower case (A-Z only), one space between."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))


def words_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def shingles(words: Column) -> Column:
    """(pos, h, word, next) of each word pair in order; the last word has no next one. Hashes only choose candidates: words decide."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("word"), b.alias("next")))
    return F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), F.xxhash64(p["word"], p["next"]).alias("h"), p["word"].alias("word"), p["next"].alias("next")))


def windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words) of each distinct window, and (wid, item) of the items (as strings) that hold it."""
    w = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(normal_text(F.col(f"`{text_col}`"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = written(w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words")), "cut")
    found = written(cut.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return found, written(cut.join(found, "words").select("wid", "item").distinct(), "owners")


def _sent(df: DataFrame) -> DataFrame:
    """To every task, if it is small for certain: ``df`` is written, and its rows are hashes and numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with n_words, n_hit, items (array), spans of hit words and contaminated."""
    win, owners = windows(benchmark, item_col, item_text_col, window)
    # Windows of one word are no pairs: they are known by the word, followed by nothing.
    parts = win.select("wid", F.size("words").alias("len"), F.explode(shingles(F.col("words"))).alias("s")).select("wid", "len", F.col("s.pos").alias("offset"), "s.h", "s.word", "s.next")
    parts = written(parts.where("next IS NOT NULL OR len = 1"), "shingles")
    wanted = _sent(written(parts.select("h").distinct(), "wanted"))
    single = parts.where("len = 1").limit(1).count() > 0

    norm = normal_text(F.col(f"`{text_col}`"))
    base = packed(docs, keep, norm=norm).withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(F.size(F.split("norm", " "))).cast("long"))
    base = written(base.withColumn("rid", F.monotonically_increasing_id()), "words")

    # Every pair of the documents that some window has, with its words.
    pairs = base.select("rid", "n_words", F.explode(shingles(words_of(F.col("norm")))).alias("s")).select("rid", "n_words", "s.*")
    if single:
        pairs = pairs.unionByName(pairs.where("next IS NOT NULL").withColumn("next", F.lit(None).cast("string")).withColumn("h", F.xxhash64("word", "next")))
    hits = written(pairs.join(wanted, "h"), "hits")
    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))

    # A whole window needs all its shingles, so the rarest one is a necessary prefix; a shingle never seen rules it out.
    rank = F.min_by(F.struct("h", "offset", "len"), F.struct("n", "offset")).alias("p")
    prefix = parts.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy("wid").agg(rank, F.min("n").alias("least"))
    prefix = written(prefix.where(F.col("least") > 0).select("wid", "p.h", "p.offset", "p.len"), "prefix")

    cand = hits.select("rid", "n_words", "pos", "h").join(_sent(prefix), "h").withColumn("start", F.col("pos") - F.col("offset"))
    cand = cand.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).select("rid", "wid", "start", "len").distinct()

    # Every pair of a candidate's window has to be a hit at its place, with the window's own words.
    need = cand.join(parts.select("wid", "offset", "h", "word", "next"), "wid").withColumn("pos", F.col("start") + F.col("offset"))
    same = need.alias("need").join(hits.alias("hit"), (F.col("need.rid") == F.col("hit.rid")) & (F.col("need.pos") == F.col("hit.pos")) & (F.col("need.h") == F.col("hit.h")) & (F.col("need.word") == F.col("hit.word")) & F.col("need.next").eqNullSafe(F.col("hit.next")))
    whole = same.groupBy("need.rid", "need.wid", "need.start", "need.len").agg(F.count(F.lit(1)).alias("n"))
    whole = written(whole.where(F.col("n") == F.greatest(F.col("len") - 1, F.lit(1))).select("rid", "wid", "start", "len"), "whole")

    spans = whole.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"))
    items = whole.select("rid", "wid").distinct().join(owners, "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.select("rid", "row", "n_words").join(spans.join(items, "rid"), "rid", "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast(out.schema["spans"].dataType))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    out = out.withColumn("n_hit", covered)
    return unpacked(out, n_words=F.col("n_words"), n_hit=F.col("n_hit"), items=F.col("items"), hit_spans=F.col("spans"), contaminated=F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    marked = contamination(docs.select(F.struct("*").alias("doc"), F.col(f"`{options.pop('text_col', 'text')}`").alias("text")), benchmark, keep=["doc"], **options)
    return marked.where(~F.col("contaminated")).select("doc.*")
