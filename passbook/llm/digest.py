"""Improbable-feature digests: rare byte windows of a text in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy; how often each entropy (in thousandths) occurs over all documents
gives its rank, rarest first. A window is selected if it is the rarest (leftmost of equals) in at least ``POPULAR``
of the runs of ``RUN`` neighbouring windows that hold it. The SHA-1 of a selected window sets five bits of a Bloom
filter of ``BITS`` bits; after ``PER_FILTER`` features a new filter is chained. Two digests are compared filter by
filter: the bits in common, less those expected by chance, over the most there could be; a filter of the shorter
chain takes its best match, and the mean is the likeness.

Windows of (nearly) no entropy are never selected. A text without a selected window has itself as its one feature;
the empty text has none. Likeness of two texts of which one has no feature is 1 if neither has, else 0.
Nulls: a null text is empty. Equal texts have equal digests; repeated rows are each digested. Ties in rarity go to the
lower level, of equally rare windows to the leftmost. Very long texts take a chain of more filters. Extra columns pass
through ``fingerprinted`` (one named ``fingerprint`` is replaced) and are not read by ``with_next``. An empty table gives
no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, RUN, POPULAR = 64, 64, 16
GROUP = 1 << 18
#: Texts held at once while neighbours are compared.
STEP = 256
BITS, PER_FILTER, HASHES = 2048, 160, 5
LEVELS, LEAST = 1001, 100

#: c * log2(c) in 2^-20, for counts up to WINDOW: integers, so that sums are exact in any order.
_CLOG = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_CLOG)
_FULL = int(_CLOG[WINDOW])


def _level(clog: np.ndarray) -> np.ndarray:
    """Entropy in thousandths of its most, from the sum of c log c."""
    return ((_FULL - clog) * (LEVELS - 1) // _FULL).astype(np.int16)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy level of each window of ``WINDOW`` bytes of ``data`` (uint8).

    From one window to the next the sum of c log c changes by the count of the byte that comes among those before it
    and the count of the byte that leaves among those behind it: bytes compared with themselves at each distance.
    """
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int16)
    before, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        behind[:-d] += same
    first = int(_CLOG[np.bincount(data[:WINDOW], minlength=256)].sum())
    clog = np.empty(n - WINDOW + 1, np.int64)
    clog[0] = first
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[behind[: n - WINDOW]], out=clog[1:])
    clog[1:] += first
    return _level(clog)


def selected(levels: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the improbable windows, in order."""
    n = len(levels)
    if n == 0:
        return np.empty(0, np.int64)
    # Rank, then place: 10 and 21 bits are enough for all but the longest texts.
    kind, shift = (np.int32, 21) if n < 1 << 21 else (np.int64, 32)
    never = np.iinfo(kind).max
    key = (rank.astype(kind) << shift)[levels]
    key += np.arange(n, dtype=kind)
    key[key < 0] = never
    run = min(RUN, n)
    # Minima of all runs, from minima of runs half as long.
    least, size = key, 1
    while size < run:
        step = min(size, run - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    popular = np.bincount(least[least < never] & ((1 << shift) - 1))
    return np.flatnonzero(popular >= min(POPULAR, n - run + 1))


def filters(text: bytes, levels: np.ndarray, rank: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of features, chain of filters as rows of bytes)."""
    at = selected(levels, rank).tolist()
    sha1 = hashlib.sha1
    digests = list(dict.fromkeys(sha1(text[i : i + WINDOW]).digest() for i in at)) if at else [sha1(text).digest()] if text else []
    if not digests:
        return 0, np.zeros((0, BITS // 8), np.uint8)
    words = np.frombuffer(b"".join(digests), ">u4").astype(np.int64) % BITS  # HASHES of 32 bits
    bits = np.zeros(-(-len(digests) // PER_FILTER) * BITS, bool)
    for k in range(0, len(digests), PER_FILTER):
        bits[words[k * HASHES : (k + PER_FILTER) * HASHES] + k // PER_FILTER * BITS] = True
    return len(digests), np.packbits(bits).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 for two chains of filters."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    x, y = ([int.from_bytes(row.tobytes()) for row in c] for c in (a, b))
    ny = [v.bit_count() for v in y]
    total = 0.0
    for row in x:
        n, best = row.bit_count(), 0.0
        for v, m in zip(y, ny):
            most, chance = min(n, m), n * m / BITS
            if most > chance:
                best = max(best, ((row & v).bit_count() - chance) / (most - chance))
        total += min(1.0, best)
    return total / len(x)


def encoded(n: int, chain: np.ndarray) -> str:
    return f"{n}:{base64.b64encode(chain.tobytes()).decode()}"


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy level, rarest first, by its count over all windows of all documents; -1 for levels under ``LEAST``.

    Each task sends its counts of at most ``LEVELS`` levels; the driver gets that many rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            for _, levels in grouped_levels([t for t in b.column("text").to_pylist() if t]):
                total += np.bincount(levels, minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["level", "n"])

    df = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(count, "level int, n long")
    counts = np.zeros(LEVELS, np.int64)
    for level, n in df.groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[level] = n
    rank = np.full(LEVELS, -1, np.int64)
    order = np.lexsort((np.arange(LEVELS), counts))
    rank[order] = np.arange(LEVELS)
    rank[:LEAST] = -1
    return rank


def _levels(text: bytes) -> np.ndarray:
    return entropies(np.frombuffer(text, np.uint8))


def grouped_levels(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text with its entropy levels; short texts are measured together, about ``GROUP`` bytes at a time."""
    group: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size >= GROUP or k == len(texts) - 1:
            levels, at = _levels(b"".join(group)), 0
            for x in group:
                yield x, levels[at : at + max(0, len(x) - WINDOW + 1)]
                at += len(x)
            group, size = [], 0


def digest(text: bytes, rank: np.ndarray) -> tuple[int, np.ndarray]:
    return filters(text, _levels(text), rank)


def fingerprinted(docs: DataFrame, *, text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """``docs`` with ``fingerprint`` (number of features, colon, filters in base 64)."""
    from .common import packed, unpacked, with_row

    rank = rarity(docs, text_col) if rank is None else rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [encoded(*filters(t, levels, rank)) for t, levels in grouped_levels(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "fingerprint"])

    df = packed(docs, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    return unpacked(df.mapInArrow(run, with_row(df, "fingerprint string")), fingerprint=F.col("fingerprint"))


def compared(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns."""

    @F.pandas_udf("double")
    def score(x, y):
        import pandas as pd

        return pd.Series([None if p is None or q is None else likeness(decoded(p), decoded(q)) for p, q in zip(x, y)])

    return score(a, b)


# Neighbours: each text beside the edit that takes its end from the next document --------------------------------


class _Text:
    """A text with what its digest takes."""

    def __init__(self, raw: bytes, levels: np.ndarray, rank: np.ndarray):
        self.text, self.raw, self.levels = raw.decode(), raw, levels
        self.n, self.chain = filters(raw, levels, rank)


def edit(text: str, following: str) -> tuple[str, str]:
    """Two parts: ``text`` without its last half, and as much of the start of ``following`` (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half], following[:half]


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = "part int, first boolean, text binary"


def edited(pairs: list[tuple[_Text, _Text]], rank: np.ndarray) -> Iterator[tuple]:
    """n_chars, SHA-256 of the edit, both fingerprints, both likenesses, for each text with the one that follows.

    The levels of an edit are those of the two texts it begins and ends with; only windows over the joint are new.
    """
    over = WINDOW - 1
    parts = [tuple(x.encode() for x in edit(mine.text, following.text)) for mine, following in pairs]
    joints = grouped_levels([head[-over:] + tail[:over] for head, tail in parts])
    for (mine, following), (head, tail), (_, joint) in zip(pairs, parts, joints):
        raw = head + tail
        if raw == mine.raw:
            n, chain = mine.n, mine.chain
        else:
            n, chain = filters(raw, np.concatenate([mine.levels[: max(0, len(head) - over)], joint, following.levels[: max(0, len(tail) - over)]]), rank)
        yield len(mine.text), hashlib.sha256(raw).hexdigest(), encoded(mine.n, mine.chain), encoded(n, chain), likeness(mine.chain, chain), likeness(mine.chain, following.chain)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """A row for each document: its digest, that of its edit with the next document by descending id, and likenesses.

    One range shuffle sorts the documents; a task reads its range in order and needs one text of look-ahead. The texts
    at the ends of the ranges (two for each task) are written beside the rows and joined to the next range afterwards.
    Rows that share an id follow each other by text. A null id comes last.
    """
    from pyspark.sql import Window as W

    from .common import written

    rank = rarity(docs, text_col) if rank is None else rank
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    by = [F.col("id").desc_nulls_last(), F.col("text")]
    ordered = df.repartitionByRange(by[0]).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    names = [x.split()[0] for x in f"{_OUT}, {_EDGE}".split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = (None,) * 5
        ids: list = []  # of the texts that wait for the next one
        texts: list[_Text] = []
        part = None
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                piece = b.slice(at, STEP)
                new = [_Text(*found, rank) for found in grouped_levels(piece.column("text").to_pylist())]
                rows = [] if texts else [(None, None, *blank, piece.column("part")[0].as_py(), True, new[0].raw)]
                ids, texts, part = ids + piece.column("id").to_pylist(), texts + new, piece.column("part")[0].as_py()
                rows += [(i, *done, None, None, None) for i, done in zip(ids, edited(list(zip(texts, texts[1:])), rank))]
                ids, texts = ids[-1:], texts[-1:]
                yield batch(rows)
        if texts:
            yield batch([(ids[0], None, *blank, part, False, texts[0].raw)])

    out = written(ordered.mapInArrow(run, f"{_OUT}, {_EDGE}"), "digests")
    first = out.where(F.col("first")).select("part", F.col("text").alias("following"))
    last = out.where(~F.col("first")).select("id", "text", "part")
    # Which range comes next: part numbers only. After the last comes the first.
    order = first.select("part").withColumn("next", F.coalesce(F.lead("part").over(W.orderBy("part")), F.first("part").over(W.orderBy("part"))))
    pairs = last.join(order, "part").join(first.withColumnRenamed("part", "next"), "next").select("id", "text", "following")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [tuple(_Text(x, _levels(x), rank) for x in two) for two in zip(b.column("text").to_pylist(), b.column("following").to_pylist())]
            rows = [(i, *done, None, None, None) for i, done in zip(b.column("id").to_pylist(), edited(pairs, rank))]
            yield batch(rows)

    inner = [x.split()[0] for x in _OUT.split(", ")]
    joined = pairs.mapInArrow(ends, f"{_OUT}, {_EDGE}")
    return out.where(F.col("first").isNull()).select(*inner).unionByName(joined.select(*inner))
