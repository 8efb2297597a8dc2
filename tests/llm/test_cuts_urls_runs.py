"""Fill-in-the-middle, URL rules and periodic runs against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from passbook.llm import fim, periods, queries, url_rules

SF = "/root/testdata/sf0.001"
BREAKS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z", "char": r"(?s)."}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a\nb\nc"), (3, "a\nb\nc"), (4, "\n\n\n"), (5, "x <S> y\nz"), (6, "ä€𐍈\nö\n" * 5000), (7, "one line without an end " * 9), (None, "p\nq\n"), (8, "<S\n<\n>M>\n<P\n")]
    return spark.createDataFrame([(i, t, "kept", 0, "old") for i, t in rows], "doc_id long, text string, form string, runs int, verdict string")


@pytest.mark.parametrize("unit", list(fim.UNITS))
@pytest.mark.parametrize("chunk", [1, 3, 64, 4096])
def test_cuts(unit, chunk):
    rng = random.Random(chunk)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\t€ä") for _ in range(rng.randint(0, 90)))
        units = re.findall(BREAKS[unit], text)
        assert "".join(units) == text
        draws = rng.getrandbits(32), rng.getrandbits(32)
        places = [len("".join(units[: d % (len(units) + 1)]).encode()) for d in draws]
        assert fim.cuts(text.encode(), draws, unit, chunk) == (len(units), min(places), max(places))


def test_blocks_of_chunks():
    data = np.frombuffer(b"ab\n" * 5000, np.uint8)
    assert fim.counts(data, "line", 7).sum() == 5000 and len(fim.counts(data, "line", 7)) > 2 * fim.BLOCK


def plain_fim(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    digest = sha(f"{seed}:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(BREAKS["line"], text)
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (len(lines), "spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(lines), "psm", f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 100, "seed": 3}, {"rate": 0}])
def test_fim(spark, options):
    docs = odd_rows(spark)
    out = fim.filled(docs, chunk=5, **options)
    assert set(docs.columns) <= set(out.columns)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r.doc_id, r.n_units, r.form, r.output) for r in got))) == sorted(map(str, ((r.doc_id, *plain_fim(r.doc_id, r.text, **options)) for r in docs.collect())))
    assert all(r.back == (r.text or "") and (r.form == "plain") == (r.middle is None) for r in got)
    assert fim.filled(docs.limit(0)).count() == 0


def test_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {(r.doc_id, r.n, r.form, r.output_sha256, r.restored_sha256) for r in queries.op11_fim(spark, SF).collect()}
    assert got == {(d.doc_id, n, form, sha(out), sha(d.text or "")) for d in docs for n, form, out in [plain_fim(d.doc_id, d.text)]}


def plain_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def test_runs():
    rng = random.Random(0)
    for _ in range(1500):
        kinds, n = rng.choice([1, 2, 2, 3, 9]), rng.randint(0, 130)
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
        least = rng.choice([12, 12, 5, 2])
        assert periods.runs(np.array(w, np.int32), least) == plain_runs(w, least), w


def test_runs_of_long_texts():
    assert periods.runs(np.zeros(60_000, np.int32)) == [(0, 60_000, 1)]
    part = np.random.default_rng(0).integers(0, 9000, 7001)
    assert periods.runs(np.concatenate([[9999], np.resize(part, 30_000)])) == [(1, 30_000, 7001)]
    two, one = [np.array([0])], [np.array([0, 1])]  # Fibonacci words: many runs, the deepest nesting
    while len(one[-1]) < 1000:
        two.append(one[-1])
        one.append(np.concatenate([one[-1], two[-2]]))
    assert periods.runs(one[-1]) == plain_runs(one[-1].tolist())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs(spark):
    docs = odd_rows(spark).unionByName(spark.createDataFrame([(9, " \x0b\x0c \r\n", "f", 1, "v"), (10, "\u00a0 \u2003 b\x1cb " * 20, "f", 1, "v")], odd_rows(spark).schema))
    out = periods.periodic_runs(docs)
    assert set(out.columns) == {*docs.columns, "n_words", "collapsed"}
    for r in out.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        found = [tuple(x) for x in r.runs]
        assert r.n_words == len(w) and (len(w) > 1000 or found == plain_runs(w)) and r.collapsed == collapsed(w, found)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_op13(spark):
    def want(d):
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        s, size, p = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(found, key=lambda r: (r[0], r[2])))
        return d.doc_id, len(found), s, size, p, None if p is None else 1000 * size // p, sha(listed), sha(collapsed(w, found))

    docs = [d for d in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((d.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in queries.op13_periods(spark, SF).collect()}
    assert sum(1 for r in got.values() if r[1]) >= 10
    assert all(got[d.doc_id] == want(d) for d in docs)


def test_url_parts(spark):
    urls = {
        None: ("", "", []), "": ("", "", []), "no-host/x": ("", "", []), "http://": ("", "", []), "HTTPS://Www.EX.org": ("www.ex.org", "", ["scheme:https", "site:ex.org", "site:org", "site:www.ex.org"]),
        "ftp://a.b/En/12?q=1&&x#f": ("a.b", "/En/12", ["arg:q", "arg:x", "fragment", "path:#", "path:en", "scheme:ftp", "site:a.b", "site:b"]), "a://b?c://d/e": ("b", "", ["arg:c://d/e", "scheme:a", "site:b"]),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_rules.host_of(F.col("url")).alias("h"), url_rules.path_of(F.col("url")).alias("p"), F.array_sort(url_rules.tokens_of(F.col("url"))).alias("t"))
    assert {r.url: (r.h, r.p, r.t) for r in df.collect()} == urls


def test_mined_rules_against_counts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        host, path = rng.choice(["a.com", "b.com", "spam.net", "x.spam.net"]), rng.choice(["en", "de", "win"])
        bad = rng.random() < (0.95 if host.endswith("spam.net") or path == "win" and host == "a.com" else 0.1)
        rows.append((f"http{'s' * rng.randint(0, 1)}://{host}/{path}/{i}", "block" if bad else "allow"))
    labelled = spark.createDataFrame([*rows, ("http://c.org/", None)], "url string, label string")
    got = {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in url_rules.mined(labelled, support=0.05, least=3, confidence=0.6).collect()}
    tokens = {r.url: r.t for r in labelled.select("url", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    sets = {s for u, _ in rows for k in (1, 2, 3) for s in combinations(sorted(tokens[u]), k)}
    sure = {}
    for s in sets:
        of = [label for u, label in rows if set(s) <= set(tokens[u])]
        for label in ("allow", "block"):
            if of.count(label) >= 15:
                sure[s, label] = of.count(label) / len(of), of.count(label) / len(rows)
    share = {label: sum(x == label for _, x in rows) / len(rows) for label in ("allow", "block")}
    general = lambda s: [p for k in range(1, len(s)) for p in combinations(s, k)]
    want = {k: (round(c, 9), round(n, 9)) for k, (c, n) in sure.items() if c >= 0.6 and c > share[k[1]] and all(sure.get((p, k[1]), (0,))[0] < c for p in general(k[0]))}
    assert got == want and (("site:spam.net",), "block") in got


def test_no_token_of_a_long_url_is_left_out_of_mining(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        odd, bad = i % 8 == 0, rng.random() < 0.3
        path = "/".join(f"p{c}" for c in "abcdefghijklm")  # commoner than the token that decides
        rows.append((f"http://h.com/{path}{'/zz' if odd else ''}?{rng.choice('xy')}=1", "block" if odd or bad else "allow"))
    labelled = spark.createDataFrame(rows, "url string, label string")
    got = url_rules.mined(labelled, least=3)
    assert (["path:zz"], "block") in [(r.tokens, r.verdict) for r in got.collect()]
    short = spark.createDataFrame([(f"http://{rng.choice('ab')}.com/{rng.choice('pq')}/{rng.choice('rs')}", "block" if rng.random() < 0.6 else "allow") for _ in range(200)], "url string, label string")
    rules = lambda most: sorted(tuple(r) for r in url_rules.mined(short, least=3, confidence=0.5, most_tokens=most).select("tokens", "verdict", F.round("confidence", 9), F.round("support", 9), "anchor").collect())
    assert rules(12) == rules(1) != []


def test_judged(spark):
    labelled = spark.createDataFrame([(f"http://s{i % 40}.{'bad' if i % 2 else 'good'}.com/p/{i}", "block" if i % 2 else "allow") for i in range(200)], "url string, label string")
    rules = url_rules.mined(labelled)
    listed = url_rules.listed_rules(spark, [("allow", "vip.bad.com/"), ("block", "vip.bad.com/x"), ("block", "good.com/p/9"), ("allow", "good.com/p/9")])
    pages = spark.createDataFrame(
        [(i, u, "mine", 5) for i, u in enumerate([None, "", "https://BAD.com", "http://a.bad.com/q", "http://vip.bad.com/y", "http://w.vip.bad.com/x1", "http://nobad.com/", "http://good.com/p/91", "http://good.com/p/8", "http://" + "a." * 3000 + "bad.com/"] * 2)],
        "page_id int, url string, verdict string, rank int",
    )
    got = sorted(url_rules.judged(pages, rules, listed).collect(), key=lambda r: r.page_id)
    one = ["allow", "allow", "block", "block", "allow", "block", "allow", "block", "allow", "block"]
    assert [r.verdict for r in got] == 2 * one and [r.rule for r in got[:9]] == [None, None, None, None, "vip.bad.com/", "vip.bad.com/x", None, "good.com/p/9", None] and {r["rank"] for r in got} == {5}
    assert got[2].mined == ["site:bad.com"] and got[8].mined == ["site:good.com"] and got[0].mined is None
    none = url_rules.mined(labelled.limit(0))
    assert none.count() == 0 and url_rules.mined(labelled.limit(3)).count() == 0
    assert {r.verdict for r in url_rules.judged(pages.limit(6), none, listed.limit(0)).collect()} == {"allow"} and url_rules.judged(pages.limit(0), rules, listed).count() == 0
    assert rules.count() <= url_rules.most_rules(url_rules.SUPPORT)
