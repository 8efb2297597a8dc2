"""SimHash near-duplicates with a pigeonring filter before the full Hamming check.

Fingerprints: the text, ``A-Z`` in lower case, is cut into words at ASCII white space; every ``shingle`` consecutive
words (all, if fewer) are hashed by XXH64 with seed 42; a bit of the fingerprint is 1 if it is set in over half of
the hashes, repeats included.

Links: the 64 bits form a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most t bits, some segment
begins a chain in which every prefix of length l differs in at most l * t / SEGMENTS bits (pigeonring). Such a chain
begins with segments that are equal or leave at least ``SEGMENTS - t`` segments equal in all, so fingerprints meet on
combinations of that many equal segments; what meets has to have such a chain, and only then are all bits compared.
Fingerprints that meet are compared within blocks of at most ``BLOCK``; a larger bucket is cut into blocks and each
pair of blocks is a unit of work of its own, so nothing is dropped and no task gets an unbounded group. Out of a unit
come the links of a spanning forest, not all pairs, and components are found from these.

Nulls: a null text has no words, as an empty one, and fingerprint 0, linked like any other; a null id is its own row
with a fingerprint, which gives its component no name. Repeated rows stay. Extra columns are not read. Empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

SEED = 42
SEGMENTS = 6
BLOCK = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at once.
_STEP = 1 << 14


def segment_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of the ring."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        a, b = starts[at : min(at + _STEP, n)].tolist(), ends[at + width - 1 : min(at + _STEP, n) + width - 1].tolist()
        hashes = np.array([digest(line[i:j], SEED) for i, j in zip(a, b)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprinted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(x.as_py() or b"", shingle) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.int64())], names=["id", "fp"])

    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return df.mapInArrow(run, "id long, fp long")


def has_chain(diff: np.ndarray, most: int, segments: int = SEGMENTS) -> np.ndarray:
    """Whether some chain round the ring keeps every prefix of l segments within l * most / segments differing bits."""
    mask = lambda w: np.uint64((1 << w) - 1)
    parts = np.stack([np.bitwise_count((diff >> np.uint64(a)) & mask(w)) for a, w in segment_bounds(segments)]).astype(np.int16)
    ring = np.concatenate([parts, parts[:-1]])
    alive = np.ones(parts.shape, bool)
    total = np.zeros(parts.shape, np.int16)
    for length in range(1, segments + 1):
        total += ring[length - 1 : length - 1 + segments]
        alive &= total * segments <= length * most
    return alive.any(axis=0)


def forest(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs (one of ``left``, one of ``right``) that differ in at most ``most`` bits."""
    names = np.unique(np.concatenate([left, right]))
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    at_left, at_right = np.searchsorted(names, left), np.searchsorted(names, right)
    for i, x in zip(at_left.tolist(), left):
        diff = right ^ x
        near = np.flatnonzero(has_chain(diff, most))
        near = near[np.bitwise_count(diff[near]) <= most]
        for j in at_right[near].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(x.view(np.int64)), int(names[j].view(np.int64))))
    return out


def _keys(fps: DataFrame, most: int) -> DataFrame:
    """(key, fp): the combinations of equal segments on which fingerprints meet."""
    combos = list(combinations(segment_bounds(), SEGMENTS - most))
    keyed = []
    for n, combo in enumerate(combos):
        mask = sum(((1 << w) - 1) << a for a, w in combo)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keyed.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    return fps.select("fp", F.explode(F.array(*keyed)).alias("key"))


def in_blocks(met: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Rows of ``met`` (key, size of the key's bucket, ``columns``) dealt out in units of work: (key, x, y, side, ``columns``).

    A small bucket is one unit; of a larger one every pair of blocks (x, y) is. Rows of a unit are neighbours, side 0
    before side 1. A unit is bound by two blocks, so a sort within hash partitions keeps it together without collecting it.
    """
    small = met.where(F.col("size") <= block).select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), *columns)
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64(columns[0]), blocks).cast("int")
    large = met.where(F.col("size") > block).withColumn("blocks", blocks).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    large = large.select("*", other.alias("o")).select(
        "key", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"), (F.col("mine") > F.col("o")).cast("int").alias("side"), *columns
    )
    unit = ["key", "x", "y"]
    # The number is given: the work grows faster than the bytes by which small partitions would be joined.
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.unionByName(large).repartition(parts, *unit).sortWithinPartitions(*unit, "side", columns[0])


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Units of work of ``in_blocks``, whole: neighbours that agree in n, bits, x and y."""
    kept: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        got = pa.Table.from_batches([b])
        got = pa.concat_tables([kept, got]) if kept is not None else got
        keys = np.stack([got.column(c).to_numpy().astype(np.int64) for c in ("n", "bits", "x", "y")], axis=1)
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        for i, j in zip([0, *cuts], cuts):
            yield got.slice(i, j - i)
        kept = got.slice(cuts[-1] if cuts else 0).combine_chunks()
    if kept is not None:
        yield kept


def links(fps: DataFrame, *, most: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fp``, distinct) that span the components at ``most`` bits."""
    if not 0 <= most < SEGMENTS:
        raise ValueError(f"most must be under {SEGMENTS}")
    keys = _keys(fps, most)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = written(keys.join(sizes, "key"), "meetings")

    rows = in_blocks(met, ["fp"], block).select("key.n", "key.bits", "x", "y", "side", "fp")

    def linked(part: np.ndarray) -> list[tuple[int, int]]:
        side, fp = part[:, 4], part[:, 5].view(np.uint64)
        left, right = (fp[side == 0], fp[side == 1]) if (side == 1).any() else (fp, fp)
        return forest(left, right, most)

    def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            columns = [unit.column(c).to_numpy().astype(np.int64) for c in ("n", "bits", "x", "y", "side", "fp")]
            yield batch(linked(np.stack(columns, axis=1)))

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id that links reach.

    Ids are gathered by fingerprint first (one row each), so a group of copies is one node however large it is.
    """
    rows = written(fingerprinted(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    first = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    linked = components(links(first.select("fp"), most=most))
    # The component of a fingerprint is named by the smallest id of all its fingerprints.
    named = first.join(linked, first["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    root = named.groupBy("root").agg(F.min("first").alias("component"))
    names = named.join(root, "root").select("fp", "component")
    return rows.join(names, "fp").select("id", "fp", "component")
