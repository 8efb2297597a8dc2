"""Token counts by a finite-state tokenizer: transitions carry the number of tokens they emit.

The transducer reads bytes. Its states know where a word of the byte-level pattern stands (letters, numbers, others,
white space with its last character held back, an apostrophe that may begin a contraction, a cut UTF-8 sequence) and,
of the byte-pair merges, what later bytes can still change: the last token of each prefix as far back as some token
could still reach, with the count of tokens relative to now. A token may follow another if merging both gives the
two again; of the tokens that end at a byte exactly one follows the last token before it. A transition emits the
change of the count, so totals are sums of what transitions emit. States are compiled when a text first needs them,
into one table of (next state, emitted); a full table is compiled anew from the states in use, which changes no
count.

Texts are cut in chunks, which step through the table side by side. The state map of a chunk tells for each entry
state its exit state and what it emits. After a place where every state agrees what follows (a space after an ASCII
letter or digit ends the word, whatever it was) the map is constant. Elsewhere a chunk is first run from the state that
the bytes before it lead to, and then from every exit state of the chunk before that its map does not have yet, until
each map covers all that can enter it. A parallel prefix scan composes the maps of a batch, so a text without a single
blank is cut like any other, and no chunk waits for the one before.

The special token's string counts as one token wherever it stands, as the library does by default. Nulls: a null text
is empty and has no tokens. Very long texts take more chunks, not more memory a byte. Repeated rows are each counted.
Extra columns pass through; an input column named like a result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, with_row

#: Bytes from one cut to the next place that allows one; chunks beyond ``WIDEST`` are cut anywhere between characters.
CHUNK, WIDEST = 512, 2048
#: Bytes before such a cut that give the first guess of its state.
_BACK = 64
#: States of a compiled table, and bytes of text that step side by side.
STATES, BATCH = 1 << 18, 1 << 23
#: Emitted counts lie in signed bits beside the next state.
_BIAS, _BITS = 512, 10
_CONTRACTIONS = {"s": True, "t": True, "m": True, "d": True, "re": True, "ve": True, "ll": True}
_SPACES = frozenset("\t\n\v\f\r \x85\xa0                　")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _class(char: str) -> str:
    if char in _SPACES:
        return "W"
    kind = unicodedata.category(char)[0]
    return kind if kind in "LN" else "O"


class Merges:
    """The byte-pair merges of a tokenizer file, and which token may follow which."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        to_bytes = lambda s: bytes(letters[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(to_bytes(a), to_bytes(b)): n for n, (a, b) in enumerate(pairs)}
        self.tokens = {to_bytes(t) for t in spec["model"]["vocab"] if t not in special}
        #: Proper prefixes of tokens: what may still grow.
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.longest = max(map(len, self.tokens))
        self._follows: dict[tuple[bytes, bytes], bool] = {}

    def split(self, word: bytes) -> list[bytes]:
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(((self.rank.get(p, sys.maxsize), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == sys.maxsize:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, a: bytes | None, b: bytes) -> bool:
        """Whether ``b`` may stand after ``a`` (None: at the start of a word)."""
        key = (a, b)
        found = self._follows.get(key)
        if found is None:
            if len(self._follows) > 1_000_000:
                self._follows.clear()
            found = self._follows[key] = self.split(b if a is None else a + b) == ([b] if a is None else [a, b])
        return found

    #: Of an empty word: (suffix that may grow, last token and relative count of each prefix back to its start).
    EMPTY = (b"", ((None, 0),))

    def grow(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte of a word, and the change of its token count.

        ``back[j]`` is of the prefix that ends j bytes before the end; the last entry of a word's start has no token.
        """
        suffix, back = state
        text = suffix + bytes([byte])
        for size in range(1, len(text) + 1):
            token = text[-size:]
            if token in self.tokens and self.follows(back[size - 1][0], token):
                break
        else:
            raise ValueError(f"no token ends {text!r}")
        change = back[size - 1][1] + 1
        keep = next(k for k in range(len(text) + 1) if k == len(text) or text[k:] in self.prefixes)
        held = len(text) - keep
        grown = ((token, 0), *((t, n - change) for t, n in back[:held]))
        return (text[keep:], grown), change


class Transducer:
    """States of the pattern and the merges, compiled on demand.

    A state is (kind, word state, held characters, bytes of an unfinished character). Kinds: S nothing read; L, N, O
    in a word of letters, numbers, others; P a space that may begin a word; A an apostrophe at a word's start, with the
    letters after it; W white space, whose last character is held.
    """

    def __init__(self, path: str, states: int = STATES):
        self.merges, self.most = Merges(path), states
        self.column = np.full(256, -1, np.int32)
        self.width, self.columns = 64, 0
        self._clear()

    def _clear(self) -> None:
        self.names: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.table = np.full((1024, self.width), -1, np.int32)
        self.ends = np.full(1024, -1, np.int16)
        self._intern(("S", Merges.EMPTY, "", b""))

    def _intern(self, name: tuple) -> int:
        n = self.number.get(name)
        if n is None:
            n = self.number[name] = len(self.names)
            self.names.append(name)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.full(self.table.shape, -1, np.int32)])
                self.ends = np.concatenate([self.ends, np.full(len(self.ends), -1, np.int16)])
        return n

    def _word(self, state: tuple, text: str | bytes) -> tuple[tuple, int]:
        total = 0
        for b in text.encode() if isinstance(text, str) else text:
            state, change = self.merges.grow(state, b)
            total += change
        return state, total

    def _count(self, text: str) -> int:
        return self._word(Merges.EMPTY, text)[1]

    def _char(self, kind: str, word: tuple, held: str, char: str) -> tuple[tuple, int]:
        """(kind, word, held) after one more character, and what is emitted."""
        what = _class(char)
        if kind == "W":
            if what == "W":
                word, n = self._word(word, held)
                return ("W", word, char), n
            # The run without its last character is a word; a last space begins the next one, others stand alone.
            n = 0 if held == " " else self._count(held)
            state, more = self._char("P" if held == " " else "S", Merges.EMPTY, "", char)
            return state, n + more
        if kind == "A":
            tail = held + char
            if tail in _CONTRACTIONS:
                return ("S", Merges.EMPTY, ""), self._count("'" + tail)
            if any(c.startswith(tail) for c in _CONTRACTIONS):
                return ("A", Merges.EMPTY, tail), 0
            # No contraction: the apostrophe begins a word of others, which a held letter ends.
            word, n = self._word(Merges.EMPTY, "'")
            state = ("O", word, "")
            for c in tail:
                state, more = self._char(*state, c)
                n += more
            return state, n
        if what == "W":
            return ("W", Merges.EMPTY, char), self._count(" ") if kind == "P" else 0
        if kind == what:
            word, n = self._word(word, char)
            return (what, word, ""), n
        if char == "'" and kind != "P":
            return ("A", Merges.EMPTY, ""), 0
        word, n = self._word(Merges.EMPTY, " " + char if kind == "P" else char)
        return (what, word, ""), n

    def _end(self, name: tuple) -> int:
        kind, word, held, _ = name
        if kind == "W":
            return self._word(word, held)[1]
        if kind == "A":
            return self._count("'") + (self._count(held) if held else 0)
        return 1 if kind == "P" else 0

    def _compile(self, state: int, byte: int) -> int:
        kind, word, held, cut = self.names[state]
        char = cut + bytes([byte])
        need = 1 if char[0] < 0x80 else 2 if char[0] < 0xE0 else 3 if char[0] < 0xF0 else 4
        emitted = 0
        if len(char) < need:
            name = (kind, word, held, char)
        else:
            (kind, word, held), emitted = self._char(kind, word, held, char.decode("utf-8", "replace"))
            name = (kind, word, held, b"")
        if not -_BIAS <= emitted < _BIAS:
            raise OverflowError("a transition emits more than its bits hold")
        return self._intern(name) << _BITS | (emitted + _BIAS)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """Columns of bytes; bytes not seen before get the next free ones."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        for b in new.tolist():
            if self.columns == self.width:
                self.table = np.concatenate([self.table, np.full((len(self.table), self.width), -1, np.int32)], axis=1)
                self.width *= 2
            self.column[b], self.columns = self.columns, self.columns + 1
        return self.column[data]

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entries: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, emitted) of each chunk ``data[start:end]`` from its entry (names of states; else nothing read).

        All chunks step side by side, the longest first in line. Numbers of states hold until the next call.
        """
        order = np.argsort(starts - ends, kind="stable")
        at, left = starts[order], (ends - starts)[order]
        total = np.zeros(len(order), np.int64)
        state = np.zeros(len(order), np.int64) if entries is None else np.array([self._intern(entries[i]) for i in order.tolist()], np.int64)
        columns = self._columns(data)
        live = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), side="right")
        for step, n in enumerate(live.tolist()):
            if len(self.names) > self.most:
                used, back = np.unique(state, return_inverse=True)
                names = [self.names[s] for s in used.tolist()]
                self._clear()
                state = np.array([self._intern(x) for x in names], np.int64)[back]
            col = columns[at[:n] + step]
            got = self.table[state[:n], col]
            if (got < 0).any():
                missing = np.flatnonzero(got < 0)
                # One of each: the others find it compiled.
                pairs = np.unique(state[missing] * 256 + data[at[missing] + step])
                for s, b in zip((pairs // 256).tolist(), (pairs % 256).tolist()):
                    entry = self._compile(s, b)
                    self.table[s, self.column[b]] = entry
                got = self.table[state[:n], col]
            state[:n] = got >> _BITS
            total[:n] += (got & ((1 << _BITS) - 1)) - _BIAS
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def ended(self, states: np.ndarray) -> np.ndarray:
        """What is emitted where a word ends in each of ``states``."""
        for s in np.unique(states).tolist():
            if self.ends[s] < 0:
                self.ends[s] = self._end(self.names[s])
        return self.ends[states].astype(np.int64)

    def running(self, data: np.ndarray, starts: np.ndarray, firm: np.ndarray) -> np.ndarray:
        """Tokens up to the end of each chunk. ``firm``: chunks that begin where all states agree, or a text does."""
        n, ends = len(starts), np.append(starts[1:], len(data))
        closes = np.append(firm[1:], True)  # a word ends with the chunk
        loose = np.flatnonzero(~firm)
        before = np.maximum(starts[loose] - _BACK, starts[loose - 1])
        before += np.array([np.argmax(data[b : b + 4] & 0xC0 != 0x80) for b in before.tolist()], np.int64)
        guess, _ = self.run(data, before, starts[loose])
        start = self.names[0]
        todo = [(c, start) for c in np.flatnonzero(firm).tolist()] + [(c, self.names[g]) for c, g in zip(loose.tolist(), guess.tolist())]
        maps: list[dict[tuple, int]] = [{} for _ in range(n)]  # entry -> its number
        for c, entry in todo:
            maps[c][entry] = 0
        found: list[tuple[int, int, tuple | None, int]] = []  # chunk, number of the entry, exit, emitted
        while todo:
            which = np.array([c for c, _ in todo])
            exits, emitted = self.run(data, starts[which], ends[which], [e for _, e in todo])
            emitted += np.where(closes[which], self.ended(exits), 0)
            names = [None if shut else self.names[s] for shut, s in zip(closes[which].tolist(), exits.tolist())]
            found += [(c, maps[c][entry], name, e) for (c, entry), name, e in zip(todo, names, emitted.tolist())]
            todo = []
            for c, name in zip(which.tolist(), names):
                if name is not None and name not in maps[c + 1]:
                    maps[c + 1][name] = len(maps[c + 1])
                    todo.append((c + 1, name))
        to, count = np.zeros((2, n, max(map(len, maps), default=1)), np.int64)
        for c, k, name, e in found:
            to[c, k], count[c, k] = 0 if name is None else maps[c + 1][name], e
        return scanned(to, count)[:, 0]


def scanned(to: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Counts of the composition of all state maps up to each one, by a parallel prefix scan.

    Row c says for each entry of chunk c which entry of chunk c + 1 it leads to, and what it counts.
    """
    step = 1
    while step < len(to):
        first = to[:-step]
        count = np.concatenate([count[:step], count[:-step] + np.take_along_axis(count[step:], first, 1)])
        to = np.concatenate([to[:step], np.take_along_axis(to[step:], first, 1)])
        step *= 2
    return count


def cuts(data: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK, widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray]:
    """(where chunks begin, whether all states agree there).

    At the bounds of texts, at the first agreed place after each ``chunk`` bytes, and between characters wherever more
    than ``widest`` bytes would be left.
    """
    before = data[:-1] | 0x20
    agreed = np.flatnonzero((data[1:] == 32) & (((before >= 97) & (before <= 122)) | ((data[:-1] >= 48) & (data[:-1] <= 57)))) + 1
    wanted = np.searchsorted(agreed, np.arange(chunk, len(data), chunk))
    firm = np.unique(np.concatenate([bounds, agreed[np.unique(wanted[wanted < len(agreed)])]]))
    size = np.diff(np.append(firm, len(data)))
    loose = [at + k for at, n in zip(firm[size > widest].tolist(), size[size > widest].tolist()) for k in range(widest, n, widest)]
    # A continuation byte is never the first of a chunk.
    loose = np.array(loose, np.int64)
    for _ in range(3):
        loose += (loose < len(data)) & (data[np.minimum(loose, len(data) - 1)] & 0xC0 == 0x80)
    starts = np.union1d(firm, loose[loose < len(data)])
    return starts, np.isin(starts, firm)


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(texts: list[bytes], path: str) -> list[int]:
    """Tokens of each text."""
    machine = transducer(path)
    special = [s.encode() for s in machine.merges.special]
    out: list[int] = []
    pieces, owners, size = [], [], 0
    extra: list[int] = []

    def flush() -> None:
        nonlocal size
        totals = np.array(extra, np.int64)
        if size:
            data = np.frombuffer(b"".join(pieces), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            starts, firm = cuts(data, bounds[:-1])
            running = np.concatenate([[0], machine.running(data, starts, firm)])
            at = np.searchsorted(starts, bounds[:-1])
            np.add.at(totals, np.array(owners), running[np.append(at[1:], len(starts))] - running[at])
        out.extend(totals.tolist())
        pieces.clear(), owners.clear(), extra.clear()
        size = 0

    for text in texts:
        parts = [text]
        for s in special:
            parts = [q for p in parts for q in ([p] if s not in p else [x for y in p.split(s) for x in (y, s)][:-1])]
        for p in parts:
            if p and p not in special:
                pieces.append(p)
                owners.append(len(extra))
                size += len(p)
        extra.append(sum(p in special for p in parts) if len(parts) > 1 else int(text in special))
        if size >= BATCH:
            flush()
    flush()
    return out


def counted(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with ``n_bytes`` (UTF-8) and ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            cols = [b.column("row"), pa.array([len(t) for t in texts], pa.int64()), pa.array(count_tokens(texts, path), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "n_bytes", "n_tokens"])

    df = packed(docs, keep, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    return unpacked(df.mapInArrow(run, with_row(df, "n_bytes long, n_tokens long")), n_bytes=F.col("n_bytes"), n_tokens=F.col("n_tokens"))
