"""Fill-in-the-middle by overlapping chunks: a text is cut at two boundaries of its units and its parts change places.

Where a unit ends shows in two adjacent bytes alone, so a text is laid out as chunks of ``CHUNK`` bytes that each see the
first byte of the next one. Boundaries are counted in all chunks at once (one predicate over pairs of neighbours), prefix sums
over the counts give the number of units and the chunk that owns each of the two cuts, and only those chunks are
scanned again for the place. Cuts travel back as byte offsets; parts are put together by SQL functions.

Units: ``line`` (with its line feed), ``word`` (with the blanks before it; blanks at the end are a unit) and ``char`` (code points).
The draws come from the SHA-256 of seed and key, so a row is cut alike wherever and whenever it is read.

Nulls: a null text is empty and gives the form plain; a null key draws like the empty string. Texts that hold a marker stay
plain, so what was put together can always be taken apart. Equal keys with equal texts are cut alike; repeated rows are
each given. Cuts may be equal (an empty middle). Very long texts are read whole, block by block of chunks. Extra columns pass
through; an input column named like a result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

#: Bytes of a chunk; chunks that are looked at together (a block bounds the memory of a long text).
CHUNK, BLOCK = 4096, 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _blank(x: np.ndarray) -> np.ndarray:
    return (x == 32) | ((x >= 9) & (x <= 13))


#: Whether a unit ends between two adjacent bytes.
UNITS = {
    "line": lambda left, right: left == 10,
    "word": lambda left, right: ~_blank(left) & _blank(right),
    "char": lambda left, right: (right & 0xC0) != 0x80,
}


def _chunks(data: np.ndarray, first: int, last: int, chunk: int) -> np.ndarray:
    """Chunks ``first`` to ``last`` (exclusive) of ``chunk`` bytes and the next one, as rows of one view; all have to be whole."""
    return np.lib.stride_tricks.as_strided(data[first * chunk :], (last - first, chunk + 1), (chunk, 1), writeable=False)


def _ends(data: np.ndarray, at: int, chunk: int, ends) -> np.ndarray:
    """Places after which a unit ends, within the chunk that begins at ``at``; the end of the text always ends one."""
    own = data[at : at + chunk + 1]
    found = np.flatnonzero(ends(own[:-1], own[1:])) + at + 1
    return found if at + chunk < len(data) else np.append(found, len(data))


def counts(data: np.ndarray, unit: str, chunk: int = CHUNK) -> np.ndarray:
    """Number of units that end in each chunk."""
    ends, n = UNITS[unit], -(-len(data) // chunk)
    whole = max(0, (len(data) - 1) // chunk)  # chunks that have a byte after them
    out = np.empty(n, np.int64)
    for i in range(0, whole, BLOCK):
        c = _chunks(data, i, min(i + BLOCK, whole), chunk)
        out[i : i + len(c)] = ends(c[:, :-1], c[:, 1:]).sum(axis=1)
    for i in range(whole, n):
        out[i] = len(_ends(data, i * chunk, chunk, ends))
    return out


def cuts(data: bytes, draws: tuple[int, int], unit: str, chunk: int = CHUNK) -> tuple[int, int, int]:
    """(number of units, byte where the prefix ends, byte where the middle ends); a draw picks one of the units + 1 places."""
    if not data:
        return 0, 0, 0
    text = np.frombuffer(data, np.uint8)
    until = np.cumsum(counts(text, unit, chunk))  # units up to the end of each chunk
    n, places = int(until[-1]), []
    for rank in sorted(d % (n + 1) for d in draws):
        if rank:
            owner = int(np.searchsorted(until, rank))
            before = int(until[owner - 1]) if owner else 0
            places.append(int(_ends(text, owner * chunk, chunk, UNITS[unit])[rank - before - 1]))
        else:
            places.append(0)
    return n, *places


def _cut_places(unit: str, chunk: int):
    @F.arrow_udf("struct<n:long,a:int,b:int>")
    def places(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        found = [cuts(t.as_py(), (x, y), unit, chunk) for t, x, y in zip(text, one.to_pylist(), two.to_pylist())]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], names=["n", "a", "b"])

    return places


def draw(key: Column, k: int, seed: int) -> Column:
    """The ``k``-th group of eight digits (from 0) of the SHA-256 of seed and key, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def filled(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with n_units, form (plain, psm or spm), prefix, middle, suffix and output.

    ``rate`` of 100 texts are cut, ``spm`` of 100 of these put the suffix first. Of a plain text the parts are null.
    """
    key = F.col(f"`{id_col}`")
    df = packed(docs, keep, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")), **{f"h{k + 1}": draw(key, k, seed) for k in range(4)})
    df = df.withColumn("cut", _cut_places(unit, chunk)(F.col("text").cast("binary"), "h1", "h2"))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    df = df.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    data = F.col("text").cast("binary")
    part = lambda start, end: F.when(F.col("form") != "plain", F.substring(data, start + 1, end - start).cast("string"))
    a, b = F.col("cut.a"), F.col("cut.b")
    df = df.withColumns({"prefix": part(F.lit(0), a), "middle": part(a, b), "suffix": part(b, F.octet_length(data))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    other = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", other).otherwise(F.col("text"))
    return unpacked(df.withColumn("output", output), n_units=F.col("cut.n"), **{c: F.col(c) for c in ("form", "prefix", "middle", "suffix", "output")})


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Parts hold no marker, so the first one after each part ends it."""
    after = lambda c, marker: F.substr(c, F.locate(marker, c) + len(marker))
    up_to = lambda c, marker: F.substring_index(c, marker, 1)
    first, rest = F.substr(output, F.lit(4)), lambda marker: after(F.substr(output, F.lit(4)), marker)
    psm = F.concat(up_to(first, SUFFIX), after(rest(SUFFIX), MIDDLE), up_to(rest(SUFFIX), MIDDLE))
    other = F.concat(up_to(rest(PREFIX), MIDDLE), after(rest(PREFIX), MIDDLE), up_to(first, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", other).otherwise(output)
