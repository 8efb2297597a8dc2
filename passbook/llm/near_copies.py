"""Near copies by Jaccard similarity of word shingles, found over wide SimHash fingerprints with a pigeonring filter.

Texts whose sets of five-word shingles are alike to 0.8 differ in about 15 of 100 bits of a SimHash fingerprint. No
split of 64 bits makes such fingerprints meet on equal segments, so here fingerprints have ``WIDE`` bits and texts meet
on ``BANDS`` bands of least shingle hashes instead: texts alike to 0.8 meet with a chance of 1 - (1 - 0.8^4)^20, over
0.9999. Of texts that meet, a pair has to have a pigeonring chain of segments within proportional budgets, then at most
``MOST`` differing bits, and at last exact shingle sets alike to the threshold. Texts of at most ``SHORT`` shingles, whose
bits are few and coarse, go from meeting to the exact sets.

Texts equal in their words (ASCII case apart) are one node. Nodes that meet are handled in units of at most two blocks,
in two passes. Out of the first comes a least spanning forest by differing bits of each unit; its links that are alike to
the threshold make the first components. In the second, nodes that have a near partner of another component, which could
be alike by the sizes of their sets, come to their units with their shingle sets, and every such pair is checked there,
in the first band on which it meets, unless links checked before connect it. So no pair is passed over, none leaves its
unit but for links that hold, and a group of copies costs about its size in links, not its square.

Nulls: a null text has no words, as an empty one; both are copies of each other. Texts of fewer words than a shingle
are one shingle. A null id stays its own row without a component. Of an id with several rows all go if every one is a
later copy, else all stay. Extra columns pass through. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bucketed, written
from .graph import components
from .simhash import BLOCK, SEED, in_blocks, units

SHINGLE, LEAST = 5, 0.8
WIDE, MOST, SEGMENTS = 256, 68, 8
BANDS, ROWS = 20, 4
#: Links of one text that are checked in one place; nodes of a block that come with their sets; common hashes counted at once.
HUB, SET_BLOCK, COUNTED = 1024, 512, 1 << 21
#: Shingles of a text whose pairs need no fingerprint: they go to the exact check as they meet.
SHORT = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes handled at once.
_STEP = 1 << 12
_FACTORS = np.random.default_rng(1).integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def node_of(words: list[bytes]) -> bytes:
    """Names a text by its words, in 16 bytes."""
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words), SEED)


def shingles(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words (of all words, if fewer)."""
    import xxhash

    line, width = b" ".join(words), min(width, len(words))
    if not words:
        return np.zeros(1, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, len(starts)))


def sketch(found: np.ndarray) -> tuple[bytes, list[int]]:
    """The wide fingerprint (a bit is 1 if set in over half the hashes) and the keys of the bands."""
    counts = np.zeros(WIDE, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in (found[i : i + _STEP] for i in range(0, len(found), _STEP)):
        lanes = _mixed(part[:, None] + np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        counts += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        least = np.minimum(least, (part * _FACTORS).min(1))
    key = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key + column)
    return np.packbits(2 * counts > len(found), bitorder="little").tobytes(), key.view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketched(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, node, fp, bands, lows: the low halves of the bands' keys, size of the shingle set): one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, bands, lows, counts = [], [], [], [], []
            for t in b.column("text"):
                words = words_of(t.as_py() or b"")
                fp, keys = sketch(found := shingles(words))
                nodes.append(node_of(words)), fps.append(fp), bands.append(keys), lows.append(np.array(keys).astype("<u4").tobytes()), counts.append(len(found))
            cols = [b.column("id"), pa.array(nodes, pa.binary()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(lows, pa.binary()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "fp", "bands", "lows", "shingles"])

    bounded_batches(docs.sparkSession)
    return _plain(docs, id_col, text_col).mapInArrow(run, "id long, node binary, fp binary, bands array<long>, lows binary, shingles long")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def near(parts: np.ndarray, most: int = MOST) -> np.ndarray:
    """Rows of differing bits by segment that have a chain within budget, and then at most ``most`` bits in all."""
    segments = parts.shape[1]
    ring = np.concatenate([parts, parts[:, :-1]], axis=1).astype(np.int16)
    alive, total = np.ones(parts.shape, bool), np.zeros(parts.shape, np.int16)
    for length in range(1, segments + 1):
        total += ring[:, length - 1 : length - 1 + segments]
        alive &= total * segments <= length * most
    rows = np.flatnonzero(alive.any(axis=1))
    return rows[parts[rows].sum(1, dtype=np.int64) <= most]


def spanning(fps: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Places of the links of a least spanning forest of the pairs that are near; ``fps`` has ``SEGMENTS`` words a row."""
    n, far = len(fps), 1 << 20
    best, parent, links = np.full(n, far), np.zeros(n, np.int64), []
    waiting, at = np.ones(n, bool), 0
    for _ in range(n - 1):
        waiting[at] = False
        parts = np.bitwise_count(fps ^ fps[at])
        rows = near(parts, most)
        distance = parts[rows].sum(1, dtype=np.int64)
        rows = rows[better := distance <= best[rows]]
        best[rows], parent[rows] = distance[better], at
        at = int(np.argmin(np.where(waiting, best, far + 1)))
        if best[at] < far:
            links.append((int(parent[at]), at))
    return links


def meetings(nodes: DataFrame) -> DataFrame:
    """(key, node, fp, shingles, size): nodes beside each band in which they meet others, and how many meet there."""
    keys = nodes.select("node", "fp", "shingles", F.posexplode("bands").alias("n", "bits")).select(F.struct("n", "bits").alias("key"), "node", "fp", "shingles")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(keys.join(sizes, "key"), "meetings")


def _fps(unit: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(unit.column("fp").to_pylist()), np.uint32).reshape(-1, SEGMENTS)


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    pairs = [(min(p), max(p)) for p in pairs]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def candidates(met: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(a, b): of the nodes of each unit of ``met`` a least spanning forest of the pairs that are near by fingerprint."""
    rows = in_blocks(met, ["node", "fp"], block).select("key.n", "key.bits", "x", "y", "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            names = unit.column("node").to_pylist()
            yield _links([(names[i], names[j]) for i, j in spanning(_fps(unit))])

    return rows.mapInArrow(run, "a binary, b binary").distinct()


class _Unit:
    """Nodes of a unit of work and which pairs of them are left to check."""

    def __init__(self, unit: pa.Table, least: float):
        self.names, self.fps, self.least = unit.column("node").to_pylist(), _fps(unit), least
        self.root = unit.column("root").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        self.count, self.band = unit.column("shingles").to_numpy(), unit.column("n")[0].as_py()
        self.lows = np.frombuffer(b"".join(unit.column("lows").to_pylist()), "<u4").reshape(-1, BANDS)
        # Of two blocks the pairs across, of one block (or a small bucket) all.
        self.split = int((unit.column("side").to_numpy() == 0).sum())

    def partners(self, i: int) -> np.ndarray:
        """Places of later nodes that are near, of another component, could be alike by size and meet here first."""
        at = self.split if self.split < len(self.names) else i + 1
        sizes = np.minimum(self.count[at:], self.count[i]) >= (self.least - 1e-9) * np.maximum(self.count[at:], self.count[i])
        rows = np.flatnonzero((self.root[at:] != self.root[i]) & sizes) + at
        rows = rows[(self.lows[rows] == self.lows[i]).argmax(1) == self.band] if len(rows) else rows
        if len(rows) and self.count[i] > SHORT:  # bits of small sets say little: all their pairs are checked
            small = self.count[rows] <= SHORT
            small[near(np.bitwise_count(self.fps[rows] ^ self.fps[i]))] = True
            rows = rows[small]
        return rows


_KEY, _WITH = ["n", "bits", "x", "y", "side"], ["node", "fp", "lows", "shingles", "root"]
_UNIT = "n int, bits long, x int, y int, side int, node binary, fp binary, lows binary, shingles long, root binary"


def open_nodes(met: DataFrame, nodes: DataFrame, linked: DataFrame, *, least: float = LEAST, block: int = SET_BLOCK) -> DataFrame:
    """Nodes, unit by unit, that have a pair left to check there; ``linked`` is (node, component). A row for each node of a unit at most."""
    info = nodes.select("node", "lows").join(linked, "node", "left").select("node", "lows", F.coalesce("component", "node").alias("root"))
    met = met.join(info, "node")
    mixed = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rows = in_blocks(met.join(mixed, "key", "left_semi"), _WITH, block).select("key.n", "key.bits", "x", "y", "side", *_WITH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            u = _Unit(unit, least)
            wanted = np.zeros(len(u.names), bool)
            for i in range(u.split):
                rows = u.partners(i)
                wanted[rows] = True
                wanted[i] |= len(rows) > 0
            yield from unit.select([*_KEY, *_WITH]).filter(pa.array(wanted)).combine_chunks().to_batches()

    return rows.mapInArrow(run, _UNIT)


def _common(sets: list[np.ndarray]):
    """A function of i: how many hashes each of ``sets`` has in common with the i-th."""
    size = np.array(list(map(len, sets)))
    owner, (_, number) = np.repeat(np.arange(len(sets)), size), np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    owner, held = owner[order], np.bincount(number)
    start, first = np.cumsum(held) - held, np.cumsum(size) - size

    def common(i: int) -> np.ndarray:
        out, own = np.zeros(len(sets), np.int64), number[first[i] : first[i] + size[i]]
        cut = np.flatnonzero(np.diff(np.cumsum(held[own]) // COUNTED, prepend=0))
        for part in np.split(own, cut):
            n = held[part]
            ends = np.cumsum(n)
            out += np.bincount(owner[np.repeat(start[part] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], minlength=len(sets))
        return out

    return common


def checked(nodes: DataFrame, texts: DataFrame, *, least: float = LEAST) -> DataFrame:
    """(a, b): links alike to ``least`` that span the components of each unit of ``open_nodes``, by exact sets within the unit."""

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(words_of(t.as_py() or b"")).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*_KEY, *_WITH)], sets], names=[*_KEY, *_WITH, "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            u = _Unit(unit, least)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in unit.column("set")]
            size, common, found = np.array(list(map(len, sets))), _common(sets), []
            for i in range(u.split):
                rows = u.partners(i)
                if len(rows):
                    both = common(i)[rows]
                    for j in rows[both / (size[i] + size[rows] - both) >= least].tolist():
                        if u.root[i] != u.root[j]:
                            u.root[u.root == u.root[j]] = u.root[i]
                            found.append((u.names[i], u.names[j]))
            yield _links(found)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.join(texts, "node").select(*_KEY, *_WITH, "text").mapInArrow(with_sets, f"{_UNIT}, set binary")
    rows = rows.repartition(parts, "n", "bits", "x", "y").sortWithinPartitions("n", "bits", "x", "y", "side", "node")
    return rows.mapInArrow(run, "a binary, b binary").distinct()


def texts_of(docs: DataFrame, nodes: DataFrame, met: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes that meet others, in buckets by node; the text of a node is one of its first id."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [node_of(words_of(t.as_py() or b"")) == n.as_py() for t, n in zip(b.column("text"), b.column("node"))]
            yield b.filter(pa.array(keep, pa.bool_()))

    first = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "first")
    texts = _plain(docs, id_col, text_col).join(first, F.col("id") == F.col("first")).select("node", "text")
    return bucketed(texts.mapInArrow(own, "node binary, text binary").groupBy("node").agg(F.first("text").alias("text")), "node", "texts")


def verified(links: DataFrame, texts: DataFrame, *, least: float = LEAST) -> DataFrame:
    """The links (written, distinct) whose exact shingle sets are alike to ``least``.

    A link takes the text of its end of fewer links to the other end, so of n links none sends one text more than about
    the root of 2n times; the links of a hub are split in parts of about ``HUB``, each with a copy of the hub's text.
    """

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] | None = None
        for b in batches:
            keep = []
            for name, x, y in zip(b.column("b"), b.column("text_a"), b.column("text_b")):
                if last is None or last[0] != name.as_py():
                    last = name.as_py(), shingles(words_of(y.as_py() or b""))
                keep.append(similarity(shingles(words_of(x.as_py() or b"")), last[1]) >= least)
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    both = links.join(degree.toDF("a", "of_a"), "a").join(degree.toDF("b", "of_b"), "b")
    low = F.col("of_a") <= F.col("of_b")
    parts = F.ceil(F.greatest("of_a", "of_b") / HUB).cast("int")
    led = both.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"), parts.alias("parts"))
    sent = led.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).join(texts.toDF("a", "text_a"), "a")
    hubs = led.select("b", "parts").distinct().join(texts.toDF("b", "text_b"), "b")
    hubs = hubs.select("b", "text_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return sent.join(hubs, ["b", "part"]).select("a", "b", "text_a", "text_b").mapInArrow(exact, "a binary, b binary")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(id, component): component is the smallest id that links of similarity ``least`` (0.8 or more) reach."""
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    rows = written(sketched(docs, id_col=id_col, text_col=text_col), "sketches")
    nodes = rows.groupBy("node").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("fp", "bands", "lows", "shingles")])
    nodes = written(nodes, "nodes")
    met = meetings(nodes.where("first IS NOT NULL"))
    texts = texts_of(docs, nodes, met, id_col=id_col, text_col=text_col)
    check = lambda links: written(verified(written(links, "candidates"), texts, least=least), "links")
    first = check(candidates(met, block=block))
    left = written(open_nodes(met, nodes, components(first), least=least, block=min(block, SET_BLOCK)), "open")
    more = written(checked(left, texts, least=least), "links")
    linked = components(first.unionByName(more)).withColumnRenamed("component", "root")
    named = nodes.select("node", "first").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    component = named.groupBy("root").agg(F.min("first").alias("component"))
    names = named.join(component, "root").select("node", "component")
    return rows.select("id", "node").join(names, "node").select("id", "component")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Of each group of near copies the document of the smallest id; documents without an id stay."""
    found = groups(docs, id_col=id_col, text_col=text_col, least=least)
    losers = found.where("id IS NOT NULL").groupBy("id").agg(F.bool_and(F.col("id") != F.col("component")).alias("late")).where("late").select(F.col("id").alias("late_id"))
    return docs.join(losers, docs[f"`{id_col}`"].cast("long") == losers["late_id"], "left_anti")
