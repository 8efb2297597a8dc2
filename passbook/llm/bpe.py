"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of distinct words.

The rank file becomes literal arrays in the plan: the id of each byte, and a rank map from a pair of ids to the id of
their merge (which is its rank), in which a pair has one of two places. A fold over a word's bytes merges the
leftmost pair of lowest rank until none has a rank.

Texts are cut once. A task gathers its documents in pages of a bounded number of characters and words; a document becomes
references, to tokens or to words of its page, and each page lists its words that are no tokens. The pages are written,
bucketed by page. Then equal words of all pages meet in a shuffle, each distinct word is folded once for the whole
corpus, and its ids go back to the pages that hold it, so no task and no driver ever holds a dictionary of the corpus.
Decoding concatenates the pieces of the ids.

A fold takes time quadratic in the length of its word, so a long word is folded in overlapping windows. Two neighbouring
windows that hold one token in one place are joined there: ids are those of the whole exactly where each two neighbours are
the ids of their own bytes, and both windows vouch for theirs. Windows without such a token (long periodic words) are
merged again from their bytes, with a heap.

Nulls: a null text is empty and has no ids. Equal texts have equal ids; repeated rows are each encoded. Very long texts are
handled whole; one text of over 16 million different words is an error. Extra columns pass through; an input column named
like a result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import json
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucketed, packed, unpacked, with_row

#: A page ends when it has this many characters of text or this many words of its own.
PAGE_CHARS, PAGE_WORDS = 1 << 25, 600_000
#: Bits of a word's number in its page, and of a page's number in its task.
_AT, _PAGE = 24, 12
#: Documents handled at once between two batches, and words that go back to their pages at once.
STEP, BACK = 128, 150_000
#: Words of more characters than LONG are folded in windows: one begins every STRIDE characters and goes LAP into the next.
LONG, STRIDE, LAP = 256, 96, 48
#: Pieces between blanks that a page remembers; the others are looked up word by word.
_MEMO = 150_000
#: Pages that one row of a word names; a word of more pages is folded once for each so many.
_HOLDERS = 1 << 14
#: Fixed value: the pattern for which a space between two other characters always begins a word.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# The rank map --------------------------------------------------------------------------------------------------


def pair_merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(id, id) -> id of the token that both make together, for every way to cut a token in two tokens."""
    return {(ranks[t[:i]], ranks[t[i:]]): n for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def displaced(merges: dict[tuple[int, int], int], ids: int, width: int) -> tuple[list[int], list[int]]:
    """(base, table): rows of the pair table laid over each other without two entries in one place.

    ``table[base[a] + b]`` is ``(a + 1) << width | merge`` where a and b merge, and belongs to another row or is 0 where
    they don't. The longest rows come first; each is tried at one pseudo-random place after another. ``ids`` itself
    stands for the edge of a word and merges with nothing.
    """
    rows: dict[int, list[int]] = {}
    for a, b in merges:
        rows.setdefault(a, []).append(b)
    span, draw = 4 * len(merges) + 1, random.Random(0)
    table, base = np.zeros(span + ids + 1, np.int64), [0] * (ids + 1)
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        cols = np.array(row)
        place = draw.randrange(span)
        while table[place + cols].any():
            place = draw.randrange(span)
        base[a] = place
        table[place + cols] = [(a + 1) << width | merges[a, b] for b in row]
    return base, table.tolist()


class Codec:
    """What encoding and decoding take of a rank file."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.path, self.n_ids = path, max(ranks.values()) + 1
        #: Bits of an id, and of a place and an id below the rank in the state of a word; the rank takes one bit more than an id.
        self.width = self.n_ids.bit_length()
        self.rank = 62 - self.width
        base, table = displaced(pair_merges(ranks), self.n_ids, self.width)
        self.literals = [json.dumps(x) for x in ([ranks[bytes([b])] for b in range(256)], base, table)]


def whole_words(path: str) -> dict[str, bytes]:
    """Tokens that are text, with their id in four bytes."""
    out = {}
    for t, n in load_ranks(path).items():
        try:
            out[t.decode()] = n.to_bytes(4, "little")
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return load_ranks(path)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for t, n in ranks.items():
        out[n] = t
    return out


def _literal(values: str) -> Column:
    return F.from_json(F.lit(values), "array<bigint>")


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def folded(words: Column, c: Codec) -> Column:
    """Ids (array<array<bigint>>) of words given as arrays of bytes (0 to 255): lowest rank first, leftmost of equals.

    The tables stand once in the plan; a lambda variable carries them inwards.
    """
    tables = F.struct(*[_literal(x).alias(k) for k, x in zip(("bytes", "base", "table"), c.literals)])
    return _let(tables, lambda t: F.transform(words, lambda w: _folded(w, t, c.n_ids, c.width, c.rank)))


def _folded(word: Column, t: Column, edge: int, width: int, rank: int) -> Column:
    """The state is one array: of each piece the rank of its merge with the next, its place in the word, and its id.

    Packed in this order, the least element is the pair to merge, leftmost of equals. Edges make every slice valid.
    """
    none, rest, ids = F.lit(1 << width), F.lit(1 << 30), (1 << width) - 1

    def ranked(a: Column, b: Column) -> Column:
        """The merge of a and b where one is, else ``none``, in its place. The owner's bits vanish only from row a."""
        found = F.get(t["table"], (F.get(t["base"], a.cast("int")) + b).cast("int")).bitwiseXOR((a + 1) * (1 << width))
        return F.shiftleft(F.least(found, none), rank)

    def step(acc: Column, _: Column) -> Column:
        def merged(k: Column, low: Column) -> Column:  # k: one-based place of the pair
            new, left = F.shiftright(low, rank), F.get(acc, k - 2)
            around = F.array(
                ranked(left.bitwiseAND(F.lit(ids)), new).bitwiseOR(left.bitwiseAND(F.lit((1 << rank) - 1))),
                ranked(new, F.get(acc, k + 1).bitwiseAND(F.lit(ids))).bitwiseOR(low.bitwiseAND(F.lit((1 << rank) - (1 << width)))).bitwiseOR(new),
            )
            return F.concat(F.slice(acc, F.lit(1), k - 2), around, F.slice(acc, k + 2, rest))

        return _let(F.array_min(acc), lambda low: F.when(low >= 1 << width + rank, acc).otherwise(_let(F.array_position(acc, low).cast("int"), lambda k: merged(k, low))))

    end = F.array(F.lit(edge).cast("bigint"))
    place = lambda i: i.cast("bigint") * (1 << width)
    pieces_of = F.concat(end, F.transform(word, lambda b: F.get(t["bytes"], b.cast("int"))), end)
    first = _let(pieces_of, lambda x: F.transform(x, lambda a, i: ranked(a, F.coalesce(F.get(x, i + 1), F.lit(edge))).bitwiseOR(place(i)).bitwiseOR(a)))
    return F.aggregate(word, first, step, lambda acc: F.transform(F.slice(acc, F.lit(2), F.size(acc) - 2), lambda x: x.bitwiseAND(F.lit(ids))))


# Long words ----------------------------------------------------------------------------------------------------


def heaped(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``data``: lowest rank first, leftmost of equals, in time n log n."""
    end, before = list(range(1, len(data) + 1)), list(range(-1, len(data)))  # of the piece that begins here
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < len(data) and (r := ranks.get(data[a : end[b]])) is not None:
            heapq.heappush(heap, (r, a, end[b]))

    for i in range(len(data)):
        offer(i)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if a < 0 or b < 0 or b >= len(data) or end[b] != stop:  # either piece has changed since
            continue
        end[a], end[b] = stop, -1
        if stop < len(data):
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    at, out = 0, []
    while at < len(data):
        out.append(ranks[data[at : end[at]]])
        at = end[at]
    return out


def _seam(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Place where a token begins that both (places, ids) hold there; -1 if there is none."""
    place, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    same = place[a[1][i] == b[1][j]]
    return int(same[0]) if len(same) else -1


def stitched(windows: list[np.ndarray], starts: np.ndarray, path: str) -> np.ndarray:
    """Ids of a word from the ids of its windows, which begin at bytes ``starts``."""
    piece = pieces(path)
    at, held = [], []
    for ids, s in zip(windows, starts.tolist()):
        size = np.fromiter((len(piece[x]) for x in ids.tolist()), np.int64, len(ids))
        at.append((s + np.cumsum(size) - size, np.asarray(ids, np.int64)))
    seams = [_seam(a, b) for a, b in zip(at, at[1:])]
    if -1 in seams:  # windows that do not meet become one
        text = lambda ids: b"".join([piece[x] for x in ids.tolist()])
        bounds = [0, *[k for k, x in enumerate(seams, 1) if x >= 0], len(at)]
        for i, j in zip(bounds, bounds[1:]):
            if j - i > 1:
                own = [text(at[k][1])[: int(starts[k + 1] - starts[k]) if k + 1 < j else None] for k in range(i, j)]
                ids = np.array(heaped(b"".join(own), _ranks(path)), np.int64)
                size = np.fromiter((len(piece[x]) for x in ids.tolist()), np.int64, len(ids))
                held.append((int(starts[i]) + np.cumsum(size) - size, ids))
            else:
                held.append(at[i])
        at, seams = held, [_seam(a, b) for a, b in zip(held, held[1:])]
        if -1 in seams:
            whole = b"".join(text(x[1])[: int(y[0][0] - x[0][0]) if y is not None else None] for x, y in zip(at, [*at[1:], None]))
            return np.array(heaped(whole, _ranks(path)), np.int64)
    low, high = [-1, *seams], [*seams, 1 << 62]
    return np.concatenate([ids[(place > a) & (place <= b)] for (place, ids), a, b in zip(at, low, high)])


# Texts ---------------------------------------------------------------------------------------------------------


class _Page:
    """References of documents in one page: an id under ``edge`` is a token, the others are words of the page."""

    def __init__(self, number: int, whole: dict[str, bytes], edge: int, pattern: str):
        import regex

        self.number, self.whole, self.edge, self.size = number, whole, edge, 0
        self.words: dict[str, bytes] = {}
        self.long: dict[str, list[int]] = {}  # word -> its number, how many windows, their references, their first bytes
        self.pieces: dict[str, bytes] = {}
        self.find, self.blanks, self.spaced = regex.compile(pattern).findall, regex.compile(r"\s\s").search, pattern == SPACED

    def _word(self, word: str) -> bytes:
        ref = self.whole.get(word) or self.words.get(word)
        if ref is None:
            if len(self.words) >> _AT:
                raise ValueError("a document has too many different words")
            ref = self.words[word] = (self.edge + len(self.words)).to_bytes(4, "little")
            if len(word) > LONG:
                starts = range(0, len(word) - LAP, STRIDE)
                refs = [int.from_bytes(self._word(word[i : i + STRIDE + LAP]), "little") for i in starts]
                first = np.cumsum([0, *[len(word[i : i + STRIDE].encode()) for i in starts[:-1]]])
                self.long[word] = [int.from_bytes(ref, "little") - self.edge, len(refs), *refs, *first.tolist()]
        return ref

    def listed(self) -> tuple[list, list]:
        """The words to fold, with None for long ones, and how these are made of others."""
        return [None if w in self.long else w for w in self.words], [x for made in self.long.values() for x in made]

    def refs(self, text: str) -> bytes:
        self.size += len(text)
        if not self.spaced or text[:1].isspace() or text[-1:].isspace() or self.blanks(text):
            return b"".join(map(self._word, self.find(text)))
        first, *rest = text.split(" ")  # each piece begins a word, with the space before it
        parts = list(map(self.pieces.get, rest))
        if None in parts:
            for i, p in enumerate(parts):
                if p is None:
                    if (p := self.pieces.get(rest[i])) is None:
                        p = b"".join(map(self._word, self.find(" " + rest[i])))
                        if len(self.pieces) < _MEMO:
                            self.pieces[rest[i]] = p
                    parts[i] = p
        return b"".join([*map(self._word, self.find(first)), *parts])

    def full(self) -> bool:
        return self.size >= PAGE_CHARS or len(self.words) >= PAGE_WORDS


def _pages(docs: DataFrame, c: Codec, pattern: str, text_col: str, keep: list[str] | None) -> DataFrame:
    """(page, row, low, high) of each document and (page, words, seams) of each page, written in buckets by page.

    low and high are the halves of the references: apart they are much smaller on disk.
    """
    path, edge = c.path, c.n_ids
    df = packed(docs, keep, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    kind = T.StructType([T.StructField("page", T.LongType()), T.StructField("row", df.schema["row"].dataType), *T.StructType.fromDDL("low binary, high binary, words array<string>, seams array<bigint>").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part, made, page, row = whole_words(path), TaskContext.get().partitionId(), 0, None, None
        if part >= 1 << 63 - _AT - _PAGE:
            raise ValueError("too many partitions to number their pages")

        def batch(row: pa.Array, refs: list, words: list | None = None, seams: list | None = None) -> pa.RecordBatch:
            halves = [pa.array([None if r is None else np.frombuffer(r, "<u2")[k::2].tobytes() for r in refs], pa.binary()) for k in (0, 1)]
            cols = [pa.array([page.number] * len(refs), pa.int64()), row, *halves, pa.array([words] * len(refs), pa.list_(pa.string())), pa.array([seams] * len(refs), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["page", "row", "low", "high", "words", "seams"])

        for b in batches:
            row, texts, refs = b.column("row"), b.column("text"), []
            for k, text in enumerate(texts, 1):
                if page is None:
                    if made >> _PAGE:
                        raise ValueError("too many pages in one partition")
                    page, made = _Page(part << _PAGE | made, whole, edge, pattern), made + 1
                refs.append(page.refs(text.as_py()))
                if page.full() or len(refs) == STEP or k == len(texts):
                    yield batch(row.slice(k - len(refs), len(refs)), refs)
                    refs = []
                if page.full():
                    yield batch(pa.nulls(1, row.type), [None], *page.listed())
                    page = None
                    pa.default_memory_pool().release_unused()
        if page is not None:
            yield batch(pa.nulls(1, row.type), [None], *page.listed())

    return bucketed(df.mapInArrow(cut, kind), "page", "pages")


def _gathered(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``at`` and are ``size`` long, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers under 2^32, compressed."""
    import zstandard

    return zstandard.compress(numbers.astype("<u4").tobytes(), 1)


def _numbers(squeezed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(squeezed), "<u4").astype(np.int64)


def _sent_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded words (places, ids) -> of each page (numbers of its words, ids of each, all ids), packed."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        places, ids = (t.column(k).chunk(0) for k in ("places", "ids"))
        owner = np.repeat(np.arange(t.num_rows), places.value_lengths().to_numpy())
        place, size = places.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        flat, start = ids.flatten().to_numpy().astype("<u4"), np.cumsum(size) - size
        page = place >> _AT
        cuts = np.flatnonzero(np.diff(page)) + 1
        rows = []
        for i, j in zip([0, *cuts], [*cuts, len(page)]):
            o = owner[i:j]
            rows.append((int(page[i]), _squeezed(np.diff(place[i:j] & (1 << _AT) - 1, prepend=0)), _squeezed(size[o]), _squeezed(flat[_gathered(start[o], size[o])])))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["page", "at", "size", "ids"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.column("places").value_lengths().to_numpy().sum()
        if n >= BACK:
            yield out(held)
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield out(held)


def _assembled(path: str, edge: int, kind: pa.DataType):
    def run(body: pa.Table, found: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        none = np.empty(0, np.int64)
        number = lambda name, each=_numbers: np.concatenate([none, *[each(x) for x in found.column(name).to_pylist()]])
        at, length, ids = number("at", lambda x: np.cumsum(_numbers(x))), number("size"), number("ids")
        size = np.concatenate([np.ones(edge, np.int64), np.zeros(int(at.max(initial=-1)) + 1, np.int64)])
        start = np.concatenate([np.arange(edge), np.zeros(len(size) - edge, np.int64)])
        size[edge + at], start[edge + at] = length, edge + np.cumsum(length) - length
        flat = np.concatenate([np.arange(edge), ids]).astype("<u4")
        seams = np.array([x for s in body.column("seams").to_pylist() if s for x in s], np.int64)
        if len(seams):
            k, total, made = 0, len(flat), []
            while k < len(seams):
                word, n = seams[k : k + 2] + [edge, 0]
                refs, first = seams[k + 2 : k + 2 + 2 * n].reshape(2, n)
                if not size[refs].all():
                    raise ValueError("a window of a word has not come back")
                made.append(stitched([flat[i : i + j] for i, j in zip(start[refs].tolist(), size[refs].tolist())], first, path))
                if word >= len(size):
                    size, start = (np.concatenate([x, np.zeros(word + 1 - len(x), np.int64)]) for x in (size, start))
                size[word], start[word], total, k = len(made[-1]), total, total + len(made[-1]), k + 2 + 2 * n
            flat = np.concatenate([flat, *made]).astype("<u4")
        body = body.filter(pc.is_valid(body.column("low")))
        low, high = (pa.chunked_array(body.column(c).chunks, pa.binary()).combine_chunks().cast(pa.large_binary()) for c in ("low", "high"))
        ends, from_high = (np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] // 2 for x in (low, high))
        low, high = (np.frombuffer(x.buffers()[2] or b"", "<u2") for x in (low, high))
        before = np.zeros(len(ends), np.int64)  # ids before each document
        data, used = np.empty(max(len(low), 1024), "<u4"), 0
        for i, j in zip(range(0, len(ends) - 1, STEP), [*range(STEP, len(ends) - 1, STEP), len(ends) - 1]):
            own = low[ends[i] : ends[j]] | high[from_high[i] : from_high[j]].astype(np.uint32) << 16
            each = size[own]
            if len(each) and not each.all():
                raise ValueError("a word of a page has not come back")
            count = int(each.sum())
            if used + count > len(data):
                data = np.concatenate([data[:used], np.empty(max(used // 4, count), "<u4")])
            data[used : used + count], used = flat[_gathered(start[own], each)], used + count
            before[i + 1 : j + 1] = before[i] + np.concatenate([[0], np.cumsum(each)])[ends[i + 1 : j + 1] - ends[i]]
        out = pa.Array.from_buffers(pa.large_binary(), len(before) - 1, [None, pa.py_buffer(before * 4), pa.py_buffer(data[:used])]).cast(pa.binary())
        pa.default_memory_pool().release_unused()
        return pa.table([pa.chunked_array(body.column("row").chunks, kind), out], names=["row", "ids"])

    return run


def encoded(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with ``ids``: little-endian unsigned 32-bit ids, as binary."""
    c = codec(path)
    pages = _pages(docs, c, pattern, text_col, keep)
    words = pages.where("words IS NOT NULL").select("page", F.posexplode("words").alias("at", "word")).where("word IS NOT NULL")
    groups = -(-pages.where("words IS NOT NULL").count() // _HOLDERS) or 1
    held = words.select("word", F.shiftleft("page", _AT).bitwiseOR(F.col("at").cast("long")).alias("place"), F.pmod("page", F.lit(groups)).alias("part"))
    distinct = held.repartition("word", "part").groupBy("word", "part").agg(F.collect_list("place").alias("places"))
    # A character of this string is a byte of the word.
    as_bytes = F.transform(F.split(F.decode(F.encode("word", "UTF-8"), "ISO-8859-1"), ""), F.ascii)
    found = distinct.select("places", F.get(folded(F.array(as_bytes), c), F.lit(0)).alias("ids"))
    back = found.mapInArrow(_sent_back, "page long, at binary, size binary, ids binary")
    body = pages.where("low IS NOT NULL OR size(seams) > 0").select("page", "row", "low", "high", "seams")
    out = T.StructType([body.schema["row"], *T.StructType.fromDDL("ids binary").fields])
    joined = body.groupBy("page").cogroup(back.groupBy("page")).applyInArrow(_assembled(path, c.n_ids, to_arrow_type(body.schema["row"].dataType)), out)
    return unpacked(joined, ids=F.col("ids"))


def decoded(docs: DataFrame, path: str, *, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with ``decoded``: the pieces of the ids, concatenated (binary; null ids: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces(path).__getitem__
        for b in (x.slice(i, STEP) for x in batches for i in range(0, x.num_rows, STEP)):
            out = [None if x is None else b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.binary())], names=["row", "decoded"])

    df = packed(docs, keep, ids=F.col(f"`{ids_col}`"))
    return unpacked(df.mapInArrow(run, with_row(df, "decoded binary")), decoded=F.col("decoded"))
