"""Periodic runs of words by block matching: aligned blocks of a power of two are searched for in the whole text.

A run is a stretch of words with smallest period p that is at least ``LEAST`` words and two periods long and that no
neighbour extends. At scale B (1, 2, 4 ...) the periods from 2B - 1 to 4B - 2 are found: such a run holds at least 2B - 1 words
before its last period, so one of the blocks of B words at the multiples of B stands whole among these and occurs
again p words later. All blocks of a scale become keys of one Aho-Corasick automaton, which reads the whole text once;
occurrences at a distance of the scale's periods are seeds, and a seed is extended to both sides, word by word, as far as
words p apart are equal. A key is an integer sequence: the numbers of a block's two halves (equal halves have equal numbers,
words to begin with), and the text is read as the sequences of halves at each offset. So keys stay two numbers long, and a
text of one word over and over costs no more than any other.

Two exact savings: a block is a key only inside a stretch of words that each occur again within the scale's longest period (no
other block can be part of such a run), and a seed within a known run of a divisor of its period is that run again.
Of equal stretches the smallest period counts.

Nulls: a null text has no words and no runs. Texts of blanks only neither. Equal texts have equal runs, repeated rows are
each read. Very long texts are read whole; a scale takes time in proportion to words and occurrences. Extra
columns pass through; an input column named like a result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, with_row

LEAST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _recurrence(ids: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence; the number of words where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids))
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words ``a`` and ``b`` have in common from their start on; looks at twice as many each time."""
    at, step, n = 0, 16, min(len(a), len(b))
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


class _Found:
    """Runs by their stretch, and for each word the known run over it that ends last."""

    def __init__(self, ids: np.ndarray, least: int):
        self.ids, self.least, self.runs = ids, least, {}
        self.begin, self.end, self.period = (np.zeros(len(ids), np.int64) for _ in range(3))
        self.period += 2 * len(ids) + 2

    def covered(self, start: int, stop: int, period: int) -> bool:
        """Whether start to stop stand in a known run of a divisor of ``period`` that is long enough to be the same run."""
        s, e, q = int(self.begin[start]), int(self.end[start]), int(self.period[start])
        return e >= stop and period % q == 0 and e - s >= period + q

    def extend(self, at: int, size: int, p: int) -> int:
        """Extend the seed of ``size`` words that recur ``p`` words after ``at``, keep what is a run; gives where its first copy ends."""
        ids = self.ids
        right = at + size + _equal(ids[at + size : len(ids) - p], ids[at + size + p :])
        left = at - _equal(ids[:at][::-1], ids[p : at + p][::-1])
        end = right + p
        if end - left >= max(self.least, 2 * p) and (left, end) not in self.runs:
            self.runs[left, end] = p
            later = left + np.flatnonzero(self.end[left:end] < end)
            self.begin[later], self.end[later], self.period[later] = left, end, p
        return right


def _starts(found: _Found, near: np.ndarray, size: int, longest: int) -> list[int]:
    """Aligned starts of the blocks of ``size`` words that can be part of a run of the scale not known yet."""
    gaps = np.concatenate([[-1], np.flatnonzero(near > longest), [len(near)]])
    need, out = max(2 * size - 1, found.least - longest), []
    for k in np.flatnonzero(np.diff(gaps) > need):
        at = np.arange(-(-(int(gaps[k]) + 1) // size) * size, int(gaps[k + 1]) - size + 1, size)
        # All seeds of a block deep in a run of a shorter period are in that run.
        deep = (found.period[at] <= size) & (found.end[at] >= at + longest + size)
        out.append(at[~deep])
    return np.concatenate(out).tolist() if out else []


def _numbered(numbers: np.ndarray, half: int) -> np.ndarray:
    """Numbers of the blocks of ``2 * half`` words at every place, from those of their halves."""
    left, right = numbers[:-half].astype(np.int64), numbers[half:]
    return np.unique(left * (int(numbers.max()) + 1) + right, return_inverse=True)[1]


def _occurrences(numbers: np.ndarray, half: int, starts: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(place, aligned starts of the same content in order) of every occurrence of a block; ``numbers`` are those of halves, or words."""
    import ahocorasick

    keys: dict[tuple[int, ...], list[int]] = {}
    for i in starts:
        keys.setdefault((int(numbers[i]), int(numbers[i + half])) if half else (int(numbers[i]),), []).append(i)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, same in keys.items():
        automaton.add_word(key, same)
    automaton.make_automaton()
    step = max(half, 1)
    rows = -(-len(numbers) // step)
    laid = np.full(rows * step, len(numbers) + 1)
    laid[: len(numbers)] = numbers
    # One row for each offset: halves that follow each other, and a number that no half has.
    text = np.column_stack([laid.reshape(rows, step).T, np.full(step, len(numbers) + 1)]).ravel()
    for end, same in automaton.iter(tuple(text.tolist())):
        yield end % (rows + 1) * step + end // (rows + 1) - half, same


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words ``ids``, by start, then period."""
    found, near, size = _Found(ids, least), _recurrence(ids), 1
    numbers, known = (np.unique(ids, return_inverse=True)[1], 1) if len(ids) else (ids, 1)
    while 2 * (2 * size - 1) <= len(ids):
        shortest, longest, half = 2 * size - 1, 4 * size - 2, size // 2
        if starts := _starts(found, near, size, longest):
            while known < half:
                numbers, known = _numbered(numbers, known), 2 * known
            seeds = []
            for at, same in _occurrences(numbers, half, starts):
                seeds += [(at - i, i) for i in same[bisect_left(same, at - longest) : bisect_right(same, at - shortest)]]
            last, reached = 0, 0
            for p, i in sorted(seeds):
                if p != last:
                    last, reached = p, 0
                if i >= reached and not found.covered(i, i + p + size, p):
                    reached = found.extend(i, size, p)
        size *= 2
    return sorted((s, e - s, p) for (s, e), p in found.runs.items())


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and where the words of each text begin (and the last ends)."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    size = np.asarray(pc.list_value_length(split))
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[np.concatenate([[0], np.cumsum(size)])]


def _collapsed(words: pa.Array, starts: np.ndarray, found: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The texts without words that repeat a run's first period, joined by one space."""
    keep = np.ones(len(words), bool)
    for at, those in zip(starts, found):
        for s, length, p in those:
            keep[at + s + p : at + s + length] = False
    left = np.concatenate([[0], np.cumsum(keep)])[starts]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep)).cast(pa.string())), " ")


def _scan(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, starts = _words(b.column("text"))
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            found = [runs(ids[s:e], least) for s, e in zip(starts, starts[1:])]
            listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in those] for those in found], pa.list_(_RUN))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.diff(starts), pa.int64()), listed, _collapsed(words, starts, found)], names=["row", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, text_col: str = "text", least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with n_words, runs and collapsed (the text with each run cut to its first period)."""
    df = packed(docs, keep, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    found = df.mapInArrow(_scan(least), with_row(df, f"n_words bigint, runs {RUNS}, collapsed string"))
    return unpacked(found, **{c: F.col(c) for c in ("n_words", "runs", "collapsed")})
