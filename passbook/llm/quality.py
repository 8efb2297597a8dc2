"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, which together are its whole text. Each passage is encoded (hashed byte trigrams, shares of kinds of characters, distinct words, word
length; then one learned layer); gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages, and the
weighted sum is scored by a logistic layer. All weights are learned together from document labels alone. Only the text
is an input.

Fitting uses a bounded sample: at most ``SAMPLE`` labelled rows, those of the smallest hash of the id, with all their
passages, as long as their texts together have at most ``SAMPLE_BYTES`` bytes (a row that would exceed them is passed over).
Scoring reads every passage of every document, however long, in blocks: of the attention it carries the largest weight,
the sum of weights and the weighted sum.

Nulls: a null text is empty; an empty text is one empty passage and gets a score. Null labels and labels of documents
that are not there are not learned from. Equal texts have equal scores, as each document is scored by itself. If the
sample lacks one of the labels the score is the share of label 1 (0.5 without any). Repeated rows are each scored. Extra
columns pass through; an input column named ``score`` is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, with_row

PASSAGE, SAMPLE, SAMPLE_BYTES = 512, 4000, 64 << 20
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 300, 0.02, 1e-4
THRESHOLD = 0.3

#: Kinds of bytes counted in a passage.
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\f\v", b"\n", b".,;:'\"()-", b"!?", b"#$%&*+=@^~", b"|/\\_<>[]{}`", bytes(range(128, 256)))
#: Buckets of byte trigrams.
GRAMS = 64
#: Bytes counted at once.
_STEP = 1 << 20
FEATURES = len(_KINDS) + 4 + GRAMS


def _table() -> np.ndarray:
    kinds = np.full(256, len(_KINDS), np.uint8)
    for k, members in enumerate(_KINDS):
        kinds[list(members)] = k
    return kinds


_KIND_OF = _table()


def blocks(text: bytes) -> Iterator[np.ndarray]:
    """A row for each passage, so many at once as ``_STEP`` bytes have; a last piece under half a passage joins the one before."""
    n = max(1, (len(text) + PASSAGE // 2) // PASSAGE)
    many = _STEP // PASSAGE
    for k in range(0, n, many):
        parts = [text[i * PASSAGE : (i + 1) * PASSAGE if i < n - 1 else len(text)] for i in range(k, min(k + many, n))]
        out = np.zeros((len(parts), FEATURES), np.float32)
        if text:
            sizes, size = np.array(list(map(len, parts)), np.float32)[:, None], sum(map(len, parts))
            d = np.frombuffer(text, np.uint8)[k * PASSAGE : k * PASSAGE + size + 2]
            passage = np.minimum(np.arange(size) // PASSAGE, len(parts) - 1)
            count = lambda values, kinds: np.bincount(passage[: len(values)] * kinds + values, minlength=len(parts) * kinds).reshape(-1, kinds)  # noqa: B023, E731
            out[:, : len(_KINDS)] = count(_KIND_OF[d[:size]], len(_KINDS) + 1)[:, :-1] / sizes
            d = d.astype(np.uint32)
            gram = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(26)
            out[:, -GRAMS:] = np.sqrt(count(gram.astype(np.int64), GRAMS) / sizes)
            for row, part in zip(out[:, len(_KINDS) : len(_KINDS) + 4], parts):
                words = part.split()
                if words:
                    row[0] = len(set(words)) / len(words)
                    row[1] = min(len(part) / len(words) / 16, 4)
                    row[2] = max(map(len, words)) / 64
                row[3] = len(part) / PASSAGE
        yield np.minimum(out, 4)


def features(text: bytes) -> np.ndarray:
    """A row for each passage."""
    return np.concatenate(list(blocks(text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights; ``share`` alone if there was nothing to tell apart."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, share: float, weights: dict[str, np.ndarray] | None):
        self.mean, self.scale, self.share, self.weights = mean, scale, share, weights

    def score(self, bag: Iterator[np.ndarray]) -> float:
        """The score of one bag, given in blocks of passages; nothing but sums is kept of a block."""
        if (w := self.weights) is None:
            return self.share
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in bag:
            h, _, _, a = _attention(w, (x - self.mean) / self.scale)
            above = max(top, float(a.max()))
            e, before = np.exp(a - above), np.exp(top - above)
            top, total, z = above, total * before + float(e.sum()), z * before + e @ h
        return float(_sigmoid(z / total @ w["score"] + w["score0"])[0])


def _attention(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Encoded passages, the two sides of their gates, and their attention before it is normalised."""
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, s = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    return h, t, s, (t * s) @ w["w"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h, t, s, a = _attention(w, x)
    e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    alpha = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(alpha[:, None] * h, starts)
    return {"starts": starts, "bag": bag, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "logit": z @ w["score"] + w["score0"]}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of documents, by each weight."""
    f = _forward(w, x, sizes)
    d = (_sigmoid(f["logit"]) - y) / len(y)
    g = {"score": f["z"].T @ d, "score0": np.array([d.sum()])}
    dz = (d[:, None] * w["score"])[f["bag"]]
    dalpha = (dz * f["h"]).sum(1)
    da = f["alpha"] * (dalpha - np.add.reduceat(f["alpha"] * dalpha, f["starts"])[f["bag"]])
    g["w"] = (f["t"] * f["s"]).T @ da
    dg = da[:, None] * w["w"]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    g["v"], g["u"] = f["h"].T @ dt, f["h"].T @ ds
    dh = (f["alpha"][:, None] * dz + dt @ w["v"].T + ds @ w["u"].T) * (1 - f["h"] ** 2)
    g["encode"], g["encode0"] = x.T @ dh, dh.sum(0)
    return g


def fit(bags: list[np.ndarray], labels: list[int], seed: int = 7) -> Model:
    """Full-batch Adam on the log loss of documents."""
    y = np.array(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(labels)) < 2:
        return Model(mean, scale, share, None)
    sizes, rng = np.array([len(b) for b in bags]), np.random.default_rng(seed)
    x = (x - mean) / scale
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"encode": draw(FEATURES, HIDDEN), "encode0": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "w": draw(GATE), "score": draw(HIDDEN), "score0": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        g = _gradients(w, x, sizes, y)
        for k in w:
            grad = g[k] + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, share, w)


def held_out(id_col: Column) -> Column:
    """Whether labels of this id are never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out; the driver gets the features of at most ``sample_bytes`` bytes."""
    key, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    chosen = labels.where(key.isNotNull() & label.isin(0, 1) & ~held_out(key)).select(key.alias("id"), label.cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = docs.select(key.alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(rows, pa.binary())], names=["id", "label", "bag"])

    # The sample's size is bound by ``sample``, whatever the tables hold: of an id with several texts the least is learned from.
    one = texts.join(F.broadcast(chosen.select("id").distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
    # Of rows in order of their hash those within the bytes that are left: at most ``sample`` numbers come to the driver.
    both = one.join(F.broadcast(chosen), "id")
    sizes = both.select("id", "label", F.octet_length("text").alias("size"), F.xxhash64("id").alias("h")).collect()
    fitting, left = [], sample_bytes
    for r in sorted(sizes, key=lambda r: (r["h"], r["id"], r["label"])):
        if r["size"] <= left:
            fitting.append(r["id"])
            left -= r["size"]
    if len(fitting) < len(sizes):
        both = both.where(F.col("id").isin(fitting))
    got = both.select("id", "label", "text").mapInArrow(run, "id long, label int, bag binary").collect()
    got.sort(key=lambda r: (r["id"], r["label"], r["bag"]))
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in got], [r["label"] for r in got])


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with ``score``: 0 to 1, higher the likelier label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [model.score(blocks(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    df = packed(docs, keep, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    return unpacked(df.mapInArrow(run, with_row(df, "score double")), score=F.col("score"))
