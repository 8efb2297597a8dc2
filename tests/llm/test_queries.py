"""The queries of the training-data operators, run as they are registered, against plain Python over the same tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from passbook.llm import bpe, digest, html_text, quality, queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf).collect()


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, texts):
    import numpy as np
    import public_tokenizers as p
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(p.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = {d: enc.encode_ordinary(t) for d, t in texts.items()}
    want = {(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(texts[d])) for d, i in ids.items()}
    assert {tuple(r) for r in rows(spark, "op1_byte_bpe")} == want


def test_op3(spark, texts):
    import xxhash

    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: brute(t) for d, t in sorted(texts.items())}
    root = {d: d for d in prints}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in prints.items():
        for j, b in prints.items():
            if j < i and (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {tuple(r) for r in rows(spark, "op3_simhash")} == {(d, f"{f:016x}", find(d)) for d, f in prints.items()}


def test_op4(spark, texts):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    n = {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert {tuple(r) for r in rows(spark, "op4_token_counts")} == {(d, len(t.encode()), n[d], n[d] > 1024) for d, t in texts.items()}


def test_op7(spark):
    got = rows(spark, "op7_quality", "/root/testdata/sf0.01")
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and label.get(r.doc_id) in (0, 1)]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.99  # the area under the curve


def test_op7_equal_texts(spark):
    """Equal texts have equal scores wherever they stand; empty tables, repeated rows and a column named score are fine."""
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(["a b c " * 300, None, "", "x" * 5000, "a b c " * 300, None] * 5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    model = quality.trained(docs, labels)
    got = quality.scored(docs.repartition(3), model).collect()
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add(r.score)
    assert len(got) == 30 and set(map(len, by.values())) == {1} and quality.scored(docs.where("false"), model).count() == 0


# Digests by the definition, window by window ----------------------------------------------------------------------


def levels(raw):
    full = digest.WINDOW * 6 * (1 << 20)
    clog = [sum(round(c * log2(c) * (1 << 20)) for c in Counter(raw[i : i + digest.WINDOW]).values()) for i in range(len(raw) - digest.WINDOW + 1)]
    return [(full - c) * (digest.LEVELS - 1) // full for c in clog]


def chain(raw, rank):
    found = levels(raw)
    n, run = len(found), min(digest.RUN, len(found))
    wins = Counter()
    for i in range(n - run + 1):
        allowed = [(rank[found[k]], k) for k in range(i, i + run) if found[k] >= digest.LEAST]
        if allowed:
            wins[min(allowed)[1]] += 1
    places = sorted(k for k, c in wins.items() if c >= min(digest.POPULAR, n - run + 1))
    features = list(dict.fromkeys(hashlib.sha1(raw[k : k + digest.WINDOW]).digest() for k in places)) or ([hashlib.sha1(raw).digest()] if raw else [])
    out = []
    for k in range(0, len(features), digest.PER_FILTER):
        bits = set()
        for f in features[k : k + digest.PER_FILTER]:
            bits |= {int.from_bytes(f[j : j + 4], "big") % digest.BITS for j in range(0, 20, 4)}
        out.append(bits)
    return len(features), out


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    total = 0.0
    for x in a:
        scores = [(len(x & y) - len(x) * len(y) / digest.BITS) / (min(len(x), len(y)) - len(x) * len(y) / digest.BITS) for y in b]
        total += min(1.0, max(0.0, *scores)) if len(scores) > 1 else min(1.0, max(0.0, scores[0]))
    return total / len(a)


def shown(n, filters):
    raw = b"".join(bytes(sum(1 << 7 - i for i in range(8) if byte * 8 + i in f) for byte in range(digest.BITS // 8)) for f in filters)
    return f"{n}:{base64.b64encode(raw).decode()}"


def test_op8(spark, texts, tmp_path):
    """Every column against the definition, over short, empty, equal, unrelated and null texts and over several ranges of ids."""
    picked = sorted((t for t in texts.values() if 300 < len(t) < 900), key=len)[:8]
    own = [*picked, None, "", "short", picked[0], picked[0][:200] + picked[1][200:], "z" * 300, "é" * 90]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(own)], "doc_id long, text string, row string, part int")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in rows(spark, "op8_digest", str(tmp_path))}
    plain = [t or "" for t in own]
    counts = Counter(x for t in plain for x in levels(t.encode()))
    rank = {x: k for k, x in enumerate(sorted(range(digest.LEVELS), key=lambda x: (counts[x], x)))}
    assert len(got) == len(own)
    for i, t in enumerate(plain):
        follow = plain[i - 1]  # descending ids; after the last comes the first
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        mine, changed, after = (chain(x.encode(), rank) for x in (t, edited, follow))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edited), shown(*mine), shown(*changed)), i
        assert r.near_edited == pytest.approx(alike(mine[1], changed[1])) and r.near_next == pytest.approx(alike(mine[1], after[1])), i


def test_op8_likeness(spark, texts):
    """Equal texts 1, half edited ones in between, unrelated ones near 0; ``compared`` says what ``likeness`` does; an empty table gives no rows."""
    got = [r for r in rows(spark, "op8_digest") if r.n_chars > 2000]
    assert sum(r.near_edited for r in got) / len(got) > 0.3 and sum(r.near_next > 0.3 for r in got) / len(got) < 0.05
    docs = spark.createDataFrame([(1, "a b " * 200 + "one"), (2, None)], "doc_id long, text string")
    prints = digest.fingerprinted(docs)
    both = [r.s for r in prints.select(digest.compared(F.col("fingerprint"), F.col("fingerprint")).alias("s")).collect()]
    assert both == [1.0, 1.0] and digest.fingerprinted(docs.where("false")).count() == 0 and digest.with_next(docs.where("false")).count() == 0


# Main text ----------------------------------------------------------------------------------------------------------

LINKS = "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(6))
PARAS = [f"This is paragraph {k} of the story, long enough to count as running text on the page." for k in range(4)]
PAGES = [
    # A menu, the story in plain blocks without any mark, a footer in a plain block with links.
    (f"<body><ul>{LINKS}</ul><div>{'</div><div>'.join(PARAS)}</div><ul>{LINKS}</ul></body>", PARAS),
    # A short paragraph between long ones stays; a stray line among menus, far from the story, goes.
    (f"<body><ul>{LINKS}</ul><div>Stray</div><ul>{LINKS}</ul><p>{PARAS[0]}</p><p>Yes.</p><p>{PARAS[1]}</p></body>", [PARAS[0], "Yes.", PARAS[1]]),
    # Reader comments and adverts in an article, character references, white space, a comment, crossed tags.
    (f"<article><h1>A &amp; B</h1><p>{PARAS[0]}  \n <b>bold<i> both</b> it</i></p><!-- <p>no</p> --><div class='ad'>Buy</div><p>{PARAS[1]}</p></article><div id=comments><p>{PARAS[2]}</p></div>", ["A & B", f"{PARAS[0]} bold both it", PARAS[1]]),
    (None, []), ("", []), ("<nav>only a menu</nav>", []), ("plain words without any markup at all", ["plain words without any markup at all"]),
    (f"<p>{'long ' * 200000}</p>", [("long " * 200000).strip()]),
]


def test_op9(spark, tmp_path):
    pages = spark.createDataFrame([(k, None if k == 3 else f"u{k}", html, "t", "r") for k, (html, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "t", "r")], "page_id long, url string, html string, text string, row string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.text, r.n_chars) for r in rows(spark, "op9_main_text", str(tmp_path))]
    want = [(k, "\n".join(lines), len("\n".join(lines))) for k, (_, lines) in enumerate([*PAGES])]
    assert sorted(got) == sorted([*want, want[0]])
    out = html_text.extracted(pages)
    assert out.columns == pages.columns[:3] + ["row", "text"] and html_text.extracted(pages.where("false")).count() == 0


def test_op9_surges_decide(monkeypatch):
    """Without the threshold of a surge, or without windows, the result is another one."""
    page, want = PAGES[1]
    assert html_text.main_text(page).split("\n") == want
    monkeypatch.setattr(html_text, "SURGE", 0)
    assert html_text.main_text(page).split("\n") == ["Stray", *want]
    monkeypatch.setattr(html_text, "SURGE", 80)
    gap = f"<body><p>{PARAS[0]}</p><p>One.</p></body><ul>{LINKS}</ul><p>Two.</p>"
    assert html_text.main_text(gap).split("\n") == [PARAS[0], "One."]
    monkeypatch.setattr(html_text, "WINDOW", 40)
    assert html_text.main_text(gap).split("\n") == [PARAS[0], "One.", "Two."]


# Secrets ------------------------------------------------------------------------------------------------------------


def token(prefix, body, good=True):
    return prefix + body + (secrets.checksum(body.encode()).decode() if good else "AAAAAA")


GITHUB, BAD = token("ghp_", "a1" * 15), token("gho_", "b2" * 15, False)
NPM = token("npm_", "Z9" * 15)
SECRET_TEXTS = [
    None, "", "nothing here", f"key {GITHUB} and {BAD}", f"é {NPM}!", "sk_live_" + "4" * 20 + " rk_test_" + "x" * 15, "xoxb-1234567890-ab", "AIza" + "k" * 35 + " " + "AIza" + "k" * 36,
    "Password = 'hunter2hunter2' token: short", "AKIA" + "Z" * 14 + " AKIA" + "Z" * 13, "deadbeef" * 2 + " " + "deadbee", f"secret={'0123456789abcdef' * 2}", "token=" * 3 + "x" * 20, "日本 api_key: " + "Q" * 12, "x" * 200000 + " passwd=" + "9" * 12,
]


def expected(text):
    patterns = {
        "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12), "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 16), "github": (r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", lambda m: secrets.checksum(m[1].encode()) == m[2].encode()),
        "npm": (r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", lambda m: secrets.checksum(m[1].encode()) == m[2].encode()), "stripe": ("[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", bool),
        "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", bool), "google": ("AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", bool),
    }
    found = [(m.start(), list(patterns).index(k), f"{k}:{m.start()}:{m.end()}") for k, (p, ok) in patterns.items() for m in re.finditer(p, text) if ok(m)]
    return [s for *_, s in sorted(found)]


def test_op10(spark, texts, tmp_path):
    own = SECRET_TEXTS + list(texts.values())
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(own)], "doc_id long, text string, spans int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in rows(spark, "op10_secrets", str(tmp_path))}
    assert len(got) == len(own)
    for i, t in enumerate(own):
        want = expected(t or "")
        base = [s for s in want if s.split(":")[0] in secrets.BASE]
        count = Counter(s.split(":")[0] for s in base)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == (count["assign"], count["access"], count["hex"], sha(",".join(base)), ",".join(want)), t
    assert sum(f"{k}:" in got[i].spans for i in range(len(SECRET_TEXTS)) for k in ("github", "npm", "stripe", "slack", "google")) == 5
    assert secrets.scanned(docs.where("false")).count() == 0


def test_checksum():
    """Six base-62 digits of the CRC-32, worked out by hand for the empty body and one byte."""
    assert secrets.checksum(b"") == b"000000"
    n, digits = zlib.crc32(b"a"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    assert secrets.checksum(b"a").decode() == "".join(digits[n // 62**k % 62] for k in range(5, -1, -1))


def test_redaction(spark):
    data = [(1, f"my {GITHUB} is", "en", 45), (2, None, "en", None), (3, "clean", "en", 5), (4, "secret=" + "0123456789abcdef" + " end", "en", 1), (4, "é token: " + "q" * 12, "en", 21)]
    docs = spark.createDataFrame(data, "doc_id long, text string, doc string, n_chars long")
    got = sorted(tuple(r) for r in secrets.redacted(docs).collect() if r.text is not None)
    assert got == [(1, "my <github> is", "en", 14), (3, "clean", "en", 5), (4, "<assign> end", "en", 12), (4, "é <assign>", "en", 10)]
    assert [tuple(r) for r in secrets.redacted(docs).where("text IS NULL").collect()] == [(2, None, "en", None)] and secrets.redacted(docs.where("false")).count() == 0
