"""Secret scan: an Aho-Corasick keyword prefilter, anchored expressions near hits only, then embedded checksums.

One pass of an Aho-Corasick automaton over the ASCII-lower-cased bytes finds keywords; each kind's expression is
tried only at the places of its own keywords, leftmost first and without overlap. Kinds with an embedded checksum
(``github``, ``npm``: six base-62 digits of the CRC-32 of the rest) are kept only if it fits. A run of hexadecimal
digits has no keyword, so a direct expression finds it.

Nulls: a null text is empty and has no spans. Equal texts have equal spans, repeated rows are each scanned. Spans are in
code points, end exclusive, by start; at one start in the order of ``KINDS``. Very long texts are read whole, in one
pass. Extra columns pass through; an input column named ``spans`` is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, with_row

#: Kinds in the order in which spans at one place are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "stripe", "slack", "google")
BASE = KINDS[:3]

#: What each kind looks like from its keyword on.
_FORMS = {
    "assign": rb"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": rb"AKIA[A-Z0-9]+",
    "github": rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "npm": rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "stripe": rb"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "slack": rb"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": rb"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
}
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "sk_live_": "stripe", "sk_test_": "stripe", "rk_live_": "stripe", "rk_test_": "stripe",
    "xoxa-": "slack", "xoxb-": "slack", "xoxp-": "slack", "xoxr-": "slack", "xoxs-": "slack", "aiza": "google",
}
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = "array<struct<kind:string,start:int,end:int>>"


def checksum(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of ``body``."""
    n, out = zlib.crc32(body), b""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r : r + 1] + out
    return out.rjust(6, b"0")


def _accepted(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind in ("github", "npm"):
        token = m[0][4:]
        return checksum(token[:-6]) == token[-6:]
    return True


@lru_cache(maxsize=1)
def _compiled():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton, {k: re.compile(p) for k, p in _FORMS.items()}, re.compile(rb"[0-9a-f]{16,}")


def find(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind."""
    automaton, forms, hexes = _compiled()
    found, after = [("hex", m.start(), m.end()) for m in hexes.finditer(text)], dict.fromkeys(KINDS, 0)
    # Latin-1 gives one character for each byte, so the places in both are the same.
    hits = [(end + 1 - size, kind) for end, (size, kind) in automaton.iter(text.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        if start >= after[kind] and (m := forms[kind].match(text, start)):
            after[kind] = m.end()
            if _accepted(kind, m):
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    out, chars, seen = {}, 0, 0
    for at in sorted({x for _, a, b in spans for x in (a, b)}):
        chars += len(text[seen:at].decode("utf-8", "replace"))
        out[at], seen = chars, at
    return [{"kind": k, "start": out[a], "end": out[b]} for k, a, b in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        spans = [_in_code_points(t, s) if t and (s := find(t)) else [] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(spans, kind)], names=["row", "spans"])


def scanned(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with ``spans``: every secret of the whole text."""
    df = packed(docs, keep, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    return unpacked(df.mapInArrow(_scan, with_row(df, f"spans {SPANS}")), spans=F.col("spans"))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, *, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with each secret (overlapping ones together) replaced by ``<kind>`` of the first; ``size_col`` is kept right.

    Documents without a secret are returned as they were; a null text stays null.
    """
    text = F.col(f"`{text_col}`")
    marked = scanned(docs.select(F.struct("*").alias("doc"), text.alias("text")))
    merged = F.aggregate(
        "spans",
        F.array().cast(SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["kind"].alias("kind"), F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    marked = marked.withColumn("cut", merged)
    # Text between secrets: from the end of one (or 0) to the start of the next (or the end).
    ends = F.concat(F.array(F.lit(0)), F.transform("cut", lambda s: s["end"]))
    pieces = F.transform(ends, lambda e, i: F.concat(
        F.substr(F.col("text"), e + 1, F.coalesce(F.get(F.col("cut"), i)["start"], F.length("text")) - e),
        F.coalesce(F.concat(F.lit("<"), F.get(F.col("cut"), i)["kind"], F.lit(">")), F.lit("")),
    ))
    clean = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    marked = marked.withColumn("clean", clean)
    size = {size_col: F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[size_col].dataType)).otherwise(F.col(f"doc.`{size_col}`"))} if size_col in docs.columns else {}
    new = {text_col: F.col("clean")} | size
    return marked.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
