"""The training-data operators against brute force, other libraries, exact round trips and held-out labels."""

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from passbook.llm import bpe, chat, decontaminate, digest, graph, html_text, near_copies, quality, queries, secrets, simhash, transducer, warc

SF = "/root/testdata/sf0.001"
LONG = "xé" * 3000 + "  \n\t " + "!?" * 500 + "\U0001f600 日本語 ½² <|endoftext|> it's"
ODD = [(1, None), (2, ""), (3, LONG), (4, LONG), (4, "a b c"), (None, "a b c d"), (5, " \t\n ")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, repeated and null ids, and columns named like results."""
    return spark.createDataFrame([(i, t, "r", 1) for i, t in ODD], "doc_id long, text string, row string, fp int")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_bpe(spark, odd):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    docs = odd.select("doc_id", "text", "row").unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", F.lit("r").alias("row")))
    got = bpe.decoded(bpe.encoded(docs.repartition(3), path, p.PATTERN), path).collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encoded(docs.where("false"), path, p.PATTERN).count() == 0


def test_bpe_of_another_pattern(spark, odd):
    """A pattern that has no word begin at a space is not cut at spaces; a page remembers few or many pieces."""
    import public_tokenizers as p
    import tiktoken

    path, pattern = p.path("byte_bpe_50k.tiktoken"), r"\S+ ?|\s+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in bpe.encoded(odd, path, pattern, keep=["text"]).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
    names = bpe.pieces(path)
    for memo in (0, 3, 10**6):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bpe, "_MEMO", memo)
            page = bpe._Page(0, bpe.whole_words(path), len(names), p.PATTERN)
            for text in ("", " ", "a b a b qzx qzx", " qzx  qzx ", LONG, "it's  'qzx'd\tqzx"):
                refs = np.frombuffer(page.refs(text), "<u4").tolist()
                words = list(page.words)
                assert b"".join(names[x] if x < len(names) else words[x - len(names)].encode() for x in refs) == text.encode()


def test_bpe_of_long_words(spark):
    """Words folded in windows have the library's ids, whether windows meet (letters, kana) or not (periodic words)."""
    import public_tokenizers as p
    import tiktoken

    path, rnd = p.path("byte_bpe_50k.tiktoken"), random.Random(5)
    ranks = bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = lambda letters, n: "".join(rnd.choices(letters, k=n))
    kana = [chr(x) for x in [*range(0x3041, 0x3097), *range(0x4E00, 0x4E40), 0x1E00, 0x10400]]
    texts = [some("abcdefghijklmnopqrstuvwxyz", 40_000), some("etaoins", 3000), some(kana, 5000), "b" + "a" * 9000, "xab" * 1500 + "c" + "abx" * 900, "=" * 2000, " " * 1500 + "x" * 257, "7" * 256 + " " + "7" * 305]
    texts += [" ".join([*texts[1:4], texts[1], "end"]), texts[0]]
    for n in (0, 1, 2, 50, 700):
        assert bpe.heaped(texts[0][:n].encode(), ranks) == enc.encode_ordinary(texts[0][:n])
    assert bpe.heaped(b"b" + b"a" * 500, ranks) == enc.encode_ordinary("b" + "a" * 500)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in bpe.encoded(df, path, p.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text)


def test_warc(spark, odd, tmp_path):
    pages = odd.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit(None).cast("string").alias("url"))
    warc.write(pages, str(tmp_path / "w"), segment_bytes=700)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(got) == pages.count() and not any(r.error for r in got)
    by = {(int(r.key), r.type): r for r in got}
    assert bytes(by[4, "response"].payload).decode() in (LONG, "a b c") and by[3, "revisit"].refers_to == "4"
    assert warc.dechunked(warc.chunked(b"x" * 20000)) == b"x" * 20000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab\r\n0\r\n\r\n")


def test_warc_edges(spark, odd, tmp_path):
    """An empty table, the digest of an empty payload, and segments that are missing, repeated or of a wrong length."""
    none = odd.where("false").select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit("u").alias("url"))
    warc.write(none, str(tmp_path / "none"))
    assert warc.digests(warc.read(spark, str(tmp_path / "none"))).count() == 0
    one = odd.where("doc_id IN (2, 3)").select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit("a b").alias("url"), F.lit(1).alias("key"), F.lit("x").alias("digest"))
    warc.write(one, str(tmp_path / "one"))
    got = {r.page_id: r for r in warc.digests(warc.read(spark, str(tmp_path / "one"))).collect()}
    assert (got[2].payload_bytes, got[2].payload_digest) == (0, hashlib.sha1(b"").hexdigest()) and got[3].payload_digest == hashlib.sha1(LONG.encode()).hexdigest()

    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"y" * 100)
    own = lambda n, *more: [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", f"<{n}>"), ("X-Key", "7"), *([("WARC-Segment-Origin-ID", "<1>")] if n > 1 else []), ("WARC-Segment-Number", n), *more]
    total = lambda n: ("WARC-Segment-Total-Length", n)
    first, second, last = warc._record(own(1), block[:60]), warc._record(own(2), block[60:90]), warc._record(own(3, total(len(block))), block[90:])
    wrong = warc._record(own(3, total(1)), block[90:])
    other = warc._record(own(2), b"other")
    for name, records, fault in [("ok", [last, first, second], None), ("twice", [first, second, second, last], None), ("gap", [first, last], "missing"), ("headless", [second, last], "missing"), ("length", [first, second, wrong], "length"), ("open", [first, second], "length"), ("clash", [first, second, other, last], "repeated")]:
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
        (r,) = warc.read(spark, str(folder)).collect()
        assert (r.error is None and bytes(r.payload) == b"y" * 100) if fault is None else (fault in r.error and r.payload is None), name


def test_simhash(spark, odd):
    import xxhash

    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL AND doc_id > 3").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    texts = docs.collect()
    prints = [brute(r.text) for r in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(texts):
        least[find(i)] = min(least.get(find(i), 1 << 60), r.doc_id)
    want = sorted((r.doc_id, prints[i], least[find(i)]) for i, r in enumerate(texts))
    assert sorted((r.id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(odd.where("false")).count() == 0


def test_links_in_blocks(spark):
    """A bucket over the block size is cut in blocks, and no link is lost."""
    rnd = random.Random(1)
    base = [rnd.getrandbits(62) for _ in range(20)]
    fps = sorted({b ^ (1 << rnd.randrange(62)) ^ (1 << rnd.randrange(62)) for b in base for _ in range(40)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = {r.node: r.component for r in graph.components(simhash.links(df, block=8)).collect()}
    whole = {r.node: r.component for r in graph.components(simhash.links(df, block=10**6)).collect()}
    assert comp == whole
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                assert comp[a] == comp[b]


def test_near_copies(spark, odd):
    """Groups equal those of brute force over all pairs; edits of one text, more than a block, stay one group."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    edits = [" ".join(f"e{n}" if i == n % 397 else w for i, w in enumerate(words)) for n in range(40)]
    texts = [*(t for t in (r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect())), *edits, None, "", " \n", LONG, LONG, "A b c", "a  b c", "a b"]
    for t in [t for t in texts[:150] if t and len(t.split()) > 30]:  # a few words changed, left out or added at random
        w = t.split()
        for _ in range(rnd.randint(1, max(1, len(w) // 40))):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x in enumerate(sets):
        for j in range(i):
            if 0.8 * max(len(x), len(sets[j])) <= min(len(x), len(sets[j])) and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.id: r.component for r in near_copies.groups(docs, block=16).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = near_copies.deduplicated(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [(0, 7), (1, 0), (3, len(LONG)), (4, 5), (4, len(LONG))]
    assert near_copies.deduplicated(odd.where("false")).count() == 0


def test_near_copies_at_the_threshold(spark, monkeypatch):
    """Groups whose pairs lie right at the threshold equal brute force: no link is lost to thinning by fingerprint, or to the parts of a hub."""
    rnd, texts = random.Random(11), []
    for group, (size, changes) in enumerate([(100, 5), (40, 5), *[(10, 5)] * 6]):  # mean similarity about 0.78
        base = [f"g{group}w{i}" for i in range(400)]
        for n in range(size):
            w = list(base)
            for k in rnd.sample(range(400), changes):
                w[k] = f"e{len(texts)}x{k}"
            texts.append(" ".join(w))
    sets, root = [frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, hub in ((simhash.BLOCK, near_copies.HUB), (16, 3)):
        monkeypatch.setattr(near_copies, "HUB", hub)
        got = {r.id: r.component for r in near_copies.groups(docs, block=block).collect()}
        assert sum(got[i] != find(i) for i in range(len(texts))) == 0


def test_near_copies_of_short_texts(spark):
    """Pairs of 8 and 9 words (4 of 5 shingles) whose fingerprints differ in more bits than the filter allows are found too."""
    rng = random.Random(2)
    pairs = [[f"w{rng.randrange(10**6)}" for _ in range(9)] for _ in range(4000)]
    prints = [[near_copies.sketch(near_copies.shingles([x.encode() for x in w[:n]]))[0] for n in (8, 9)] for w in pairs]
    far = [w for w, (a, b) in zip(pairs, prints) if (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() > near_copies.MOST]
    assert far
    docs = spark.createDataFrame([(2 * i + k, " ".join(w[: 8 + k])) for i, w in enumerate(far) for k in (0, 1)], "doc_id long, text string")
    assert {r.doc_id for r in near_copies.deduplicated(docs).collect()} == {2 * i for i in range(len(far))}


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (5, 5), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in graph.components(chain).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300} and graph.components(chain.where("false")).count() == 0


def test_token_counts(spark, odd):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path = p.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(3)
    alphabet = [chr(x) for x in [*range(1, 0x250), 0x2028, 0x3000, 0x2160, 0x4E00, 0x300, 0x1F600, 0x661, 0xBD, 0x2003, 0x85]] + list(" '_sdtmlrveel \n\t") * 30 + ["<|endoftext|>"] * 9
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 50))) for _ in range(1500)]
    assert transducer.count_tokens([t.encode() for t in texts], path) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    small = transducer.Transducer(path, states=300)
    data = np.frombuffer(LONG.replace("<|endoftext|>", "").encode() * 2, np.uint8)
    starts, firm = transducer.cuts(data, np.array([0]))
    assert small.running(data, starts, firm)[-1] == len(tok.encode(LONG.replace("<|endoftext|>", "") * 2, add_special_tokens=False).ids)
    for r in transducer.counted(odd, path).collect():
        assert r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode()) and r.row == "r"


def test_token_counts_without_blanks(spark):
    """Chunks cut anywhere: their state maps, composed by the scan, count what the library counts for the whole text."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path = p.path("byte_bpe_50k.json")
    tok, machine, rnd = Tokenizer.from_file(path), transducer.Transducer(path), random.Random(8)
    kana = "".join(chr(rnd.choice([*range(0x3041, 0x3097), *range(0x4E00, 0x4E40)])) for _ in range(900))
    for text in (kana, "foo, bar; " * 90, "aaaaaaaaab" * 80, "=" * 700 + " " * 300 + "x" * 300, "it's'd've" * 70, "\u00e9\U0001f600" * 200, "".join(rnd.choices("abcdefghij\n'.", k=1500))):
        data = np.frombuffer(text.encode(), np.uint8)
        for chunk, widest in ((8, 16), (40, 90), (10**9, 37)):
            starts, firm = transducer.cuts(data, np.array([0]), chunk, widest)
            assert not firm.all() and machine.running(data, starts, firm)[-1] == len(tok.encode(text, add_special_tokens=False).ids)


def test_scan():
    """The prefix scan of state maps equals one step after the other."""
    rnd = np.random.default_rng(4)
    to, count = rnd.integers(0, 3, (77, 3)), rnd.integers(-5, 9, (77, 3))
    state, total, want = 0, 0, []
    for c in range(77):
        total, state = total + count[c, state], to[c, state]
        want.append(total)
    assert transducer.scanned(to, count)[:, 0].tolist() == want


def test_chat_layouts(spark):
    rows = ['{"messages":[{"role":"user","content":"q <|im_end|>"},{"role":"assistant","content":"a & b"}]}', '{"prompt":"q","completion":"a"}', '{"instruction":"q","input":"","output":"a"}', '{"x":1}', None]
    got = chat.json_turns(spark.createDataFrame([(r,) for r in rows], "j string"), "j").collect()
    assert [r.layout for r in got] == ["messages", "prompt_completion", "instruction_input", None, None]
    turns = spark.createDataFrame([(1, 1, "assistant", "x <|im_start|> &amp; \n"), (1, 0, None, None)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.formatted(chat.canonical_turns(turns))).first()
    assert [(t.role, t.text) for t in back.turns] == [("", ""), ("assistant", "x <|im_start|> &amp; \n")] and back.learned == ["x <|im_start|> &amp; \n"]


TWO = [("user", "q <|im_end|>"), ("assistant", "a & b")]
RECORDS = {
    "messages": ('{"messages":[{"role":"user","content":"q <|im_end|>","x":1},{"role":"assistant","content":"a & b"}]}', TWO),
    "sharegpt": ('{"conversations":[{"from":"human","value":"q <|im_end|>"},{"from":"gpt","value":"a & b"}]}', TWO),
    "prompt_completion": ('{"prompt":"q <|im_end|>","completion":"a & b","other":[1]}', TWO),
    "prompt_response": ('{"prompt":"q <|im_end|>","response":"a & b"}', TWO),
    "system_prompt_response": ('{"system":"s","prompt":"q <|im_end|>","response":null}', [("system", "s"), ("user", "q <|im_end|>"), ("assistant", "")]),
    "instruction": ('{"instruction":"q <|im_end|>","output":"a & b"}', TWO),
    "instruction_input": ('{"instruction":"q","input":"i","output":"o"}', [("user", "q\\n\\ni"), ("assistant", "o")]),
    "question_answer": ('{"question":"q <|im_end|>","answer":"a & b"}', TWO),
}


@pytest.mark.parametrize("name", sorted(RECORDS))
def test_chat_layout(spark, name):
    """Each layout by its JSON record and by its schema, through the template and back."""
    record, want = RECORDS[name]
    want = [(r, t.replace("\\n", "\n")) for r, t in want]
    as_json = spark.createDataFrame([(1, record, "x")], "conv_id long, j string, layout string")
    got = chat.json_turns(as_json, "j").first()
    assert got.layout == name and [(t.role, t.text) for t in got.turns] == want
    typed = spark.read.json(spark.createDataFrame([(record,)], "value string").rdd.map(lambda r: r.value)).withColumn("conv_id", F.lit(1))
    typed = typed.withColumns({c: F.col(c).cast("string") for c, t in typed.dtypes if t == "void"})
    back = chat.read_back(chat.formatted(chat.canonical_turns(typed))).first()
    assert [(t.role, t.text) for t in back.turns] == want and back.learned == [t for r, t in want if r == "assistant"]


def test_chat_edges(spark):
    """Ties and repeated turns, very long texts, empty tables, extra columns, unknown layouts."""
    long = "<|im_start|>" * 20000
    rows = [(1, 0, "user", "b", "x", 1), (1, 0, "user", "a", "x", 1), (1, 0, "user", "a", "x", 1), (1, None, "system", long, "x", 1), (None, 1, "assistant", "&lt;|", "x", 1), (2, 1, "a\nb", None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, turns int")
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical_turns(turns))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("system", long), ("user", "a"), ("user", "a"), ("user", "b")] and back[None].learned == ["&lt;|"] and [tuple(t) for t in back[2].turns] == [("a\nb", "")]
    assert chat.formatted(chat.canonical_turns(turns.where("false"))).count() == 0
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_decontamination_against_brute_force(spark):
    """Repeated items, ties in rarity, overlapping windows, items of one word, repeated documents, clashing columns, both ways to join."""
    rnd = random.Random(2)
    some = lambda n: " ".join(rnd.choice("abcde") for _ in range(n))
    items = [(1, some(12)), (2, some(12)), (2, some(11)), (3, "a b a b a b a b a b a b"), (4, "zebra"), (5, "e d"), (6, None), (7, ""), (8, "a b a b a b a b a b a b"), (None, "c c")]
    docs = [(k, some(rnd.randint(0, 120)) + rnd.choice(["", " zebra", " Zebra, a", " a b a b a b a b a b"])) for k in range(60)]
    docs += [(60, items[0][1] + " " + items[0][1]), (60, items[0][1]), (61, None), (62, "x " * 30000 + items[1][1])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = [(None if i is None else str(i), w[k : k + 10]) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    want = []
    for _, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found |= {i} - {None}
        want.append((len(w), len(hit), sorted(found), bool(hit)))
    df = spark.createDataFrame([(i, t, "r", [1], 5) for i, t in docs], "doc_id long, text string, row string, items array<int>, n_hit int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, wid int")
    for most in (decontaminate.BROADCAST_ROWS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontaminate, "BROADCAST_ROWS", most)
            got = decontaminate.contamination(df, bench).collect()
        assert sorted((r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == sorted(want) and all(r.row == "r" for r in got)
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not w[3] for w in want)


def test_decontamination(spark, odd):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "short item here"), (3, None), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item.upper()} after"), (2, " ".join(f"w{i}" for i in range(9))), (3, "a short, item! here"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (16, 14, ["1"], True), 2: (9, 0, [], False), 3: (4, 3, ["2"], True), 4: (0, 0, [], False), 5: (0, 0, [], False)}
    assert decontaminate.contamination(odd, bench).count() == len(ODD) and not decontaminate.contamination(docs, bench.where("false")).where("contaminated").count()


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.trained(docs, labels)
    got = quality.scored(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert sum((r.score >= quality.THRESHOLD) == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.scored(odd, model).collect())
    assert quality.trained(docs, labels.where("false")).share == 0.5
    texts = [b"some words " * 90, b"", b"Long text, of many passages! 123\n" * 80_000]  # the last over 2 MiB: its passages are as wide as others
    assert len(quality.features(texts[2])) == len(texts[2]) // quality.PASSAGE and all(len(x) <= quality._STEP // quality.PASSAGE for x in quality.blocks(texts[2]))
    for t in texts:
        assert abs(model.score(quality.blocks(t)) - plain_score(model, quality.features(t))) < 1e-9


def plain_score(model, bag):
    """The score by its definition, number by number."""
    w, sigmoid = model.weights, lambda v: 1 / (1 + np.exp(-v))
    encoded = [np.tanh(x @ w["encode"] + w["encode0"]) for x in (bag - model.mean) / model.scale]
    gates = [sum(w["w"][k] * np.tanh(h @ w["v"][:, k]) * sigmoid(h @ w["u"][:, k]) for k in range(quality.GATE)) for h in encoded]
    weights = np.exp(np.array(gates) - max(gates))
    z = sum(a * h for a, h in zip(weights / weights.sum(), encoded))
    return float(sigmoid(z @ w["score"] + w["score0"][0]))


def test_quality_gradients():
    """Each gradient against the difference quotient of the loss."""
    rng = np.random.default_rng(3)
    sizes, y = np.array([1, 4, 2, 7]), np.array([1.0, 0.0, 1.0, 0.0])
    x = rng.normal(size=(sizes.sum(), quality.FEATURES))
    shapes = {"encode": (quality.FEATURES, quality.HIDDEN), "encode0": (quality.HIDDEN,), "v": (quality.HIDDEN, quality.GATE), "u": (quality.HIDDEN, quality.GATE), "w": (quality.GATE,), "score": (quality.HIDDEN,), "score0": (1,)}
    w = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}

    def loss():
        p = quality._sigmoid(quality._forward(w, x, sizes)["logit"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = quality._gradients(w, x, sizes, y)
    for k, s in shapes.items():
        for spot in {tuple(rng.integers(0, n) for n in s) for _ in range(6)}:
            at = w[k][spot]
            ends = []
            for step in (1e-5, -1e-5):
                w[k][spot] = at + step
                ends.append(loss())
            w[k][spot] = at
            assert abs((ends[0] - ends[1]) / 2e-5 - g[k][spot]) < 1e-6, k


def test_quality_sample_bytes(spark, monkeypatch):
    """The fit reads no more bytes than stated, whole texts in order of the hash."""
    docs = spark.createDataFrame([(i, "x" * (100 + 900 * (i % 2))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, found: seen.append(len(found)))
    for most in (0, 5000, 10**6):
        quality.trained(docs, labels, sample_bytes=most)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60))
    assert seen[0] == 0 and 5 <= seen[1] <= 50 and seen[2] == 60 - held


def test_quality_of_repeated_ids(spark, monkeypatch):
    """Of an id with several texts one is learned from, the same in any order of the rows."""
    rows = [(i, f"{'word ' * (k + 1)}{i}") for i in range(40) for k in range(6)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, found: seen.append([(b.tobytes(), y) for b, y in zip(bags, found)]))
    for order in (rows, rows[::-1]):
        quality.trained(spark.createDataFrame(order, "doc_id long, text string"), labels, sample=10)
    assert len(seen[0]) == 10 and seen[0] == seen[1]


def test_digest(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    rank = digest.rarity(docs)
    rows = {r.id: r for r in digest.with_next(docs, rank=rank).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        n = len(texts[d])
        follow = texts[order[(i + 1) % len(order)]]
        edited = texts[d][: n - n // 2] + follow[: n // 2]
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[d].fingerprint == digest.encoded(*digest.digest(texts[d].encode(), rank))
    assert digest.with_next(odd, rank=rank).count() == len(ODD)


def test_rarity(spark, odd):
    """Ranks follow counts over every window of every text."""
    from collections import Counter
    from math import log2

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    counts = Counter()
    for r in docs.collect():
        raw = (r.text or "").encode()
        for i in range(len(raw) - digest.WINDOW + 1):
            clog = sum(round(c * log2(c) * (1 << 20)) for c in Counter(raw[i : i + digest.WINDOW]).values())
            full = digest.WINDOW * 6 * (1 << 20)
            counts[(full - clog) * (digest.LEVELS - 1) // full] += 1
    order = sorted(range(digest.LEVELS), key=lambda x: (counts[x], x))
    want = {x: n if x >= digest.LEAST else -1 for n, x in enumerate(order)}
    assert dict(enumerate(digest.rarity(docs).tolist())) == want


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>One &amp;  two.</p><p>Three.</p></article><footer>c</footer></body></html>"
    assert html_text.main_text(page) == "Head\nOne & two.\nThree." and html_text.main_text(None) == "" and html_text.main_text("<p") == ""


def test_main_text_beside_a_mark():
    """Lines outside an <article> are weighed as others: a teaser card takes nothing from the text of the page."""
    body = [f"Paragraph {n} of a text that stands in plain blocks and is the main text." for n in range(6)]
    page = "<body><div>" + "</div><div>".join(body) + "</div><form>x</form><form>x</form><form>x</form><form>x</form><article class=card><h2>Next</h2></article></body>"
    assert html_text.main_text(page) == "\n".join(body)
    beside = "<article><h1>Head</h1><form>x</form><form>x</form><form>x</form><p>" + "In the article. " * 40 + "</p></article><div>" + body[0] + "</div><div>" + body[1] + "</div>"
    assert html_text.main_text(beside) == "\n".join(["Head", ("In the article. " * 40).strip(), *body[:2]])


def test_main_text_in_doubtful_wrappers():
    """What wraps the text of the page may be called anything; what stands beside it may not."""
    one = "Some words of running text stand here, as many as a paragraph has."
    body, want = f"<p>{one}</p>" * 6, "\n".join([one] * 6)
    for page in (
        "<div class='content has-sidebar'><article>{}</article></div>", "<div class='site no-sidebar'>{}</div>", "<div class='layout-with-banner'><main>{}</main></div>", "<form id='aspnetForm'>{}</form>",
        "<article><div class='discussion-paper'>{}</div></article>", "<div class=page-sidebar><div class=banner>{}</div></div>", "<form><div class=menu><p>Home Start</p></div>{}<div class=comments><p>I think so too, and more.</p></div></form>",
        "<article>{}</article><section class=comments>" + "<article><p>A comment of some length that a reader left there.</p></article>" * 12 + "</section>",
        "<article>{}<div class=related><p>" + one + "</p></div></article>",
    ):
        assert html_text.main_text(page.format(body)) == want, page
    assert html_text.main_text(f"<nav>{body}</nav>") == "" and html_text.main_text("<div class=menu></div><form></form>") == ""


def test_main_text_of_given_pages(spark):
    """On every given page: the text of its article but for what is marked as an advert or a notice inside it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extracted(pages, keep=["page_id", "html"]).collect():
        article = re.search(r"(?s)<article[^>]*>(.*)</article>", r.html)[1]
        plain = lambda s: "".join(html.unescape(re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<[^>]*>", "", s)).split())
        assert "".join(r.text.split()) in plain(article) or len("".join(r.text.split())) > 0.9 * len(plain(article)), r.page_id
        assert len("".join(r.text.split())) >= 0.8 * len(plain(article)), r.page_id


def test_main_text_after_unclosed_elements():
    page = lambda inner: f"<article><p>First {inner} words.</p><p>All of the rest.</p></article>"
    for icon in ('<svg class="i"/>', "<math/>", "<object data=x>", "<video src=x>", "<svg>", "<template>", "<iframe src=x>", "<svg><path d='z'/></svg>", "<noscript>n</noscript>", "<script>s</script>"):
        assert html_text.main_text(page(icon)).split() == "First words. All of the rest.".split(), icon
    assert html_text.main_text(page("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>")) == "First x=1 words.\nAll of the rest."
    for tag in ("object", "audio", "video", "canvas"):
        assert html_text.main_text(page(f"<{tag}>instead</{tag}>")) == "First instead words.\nAll of the rest.", tag
    assert html_text.main_text(page("<textarea>never closed")) == "First"


def test_secrets(spark, odd):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in secrets.scanned(docs).collect():
        want = [("assign", m.start(), m.end()) for m in assign.finditer(r.text) if len(m[2]) >= 12] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", r.text) if len(m[0]) >= 18] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", r.text) if len(m[0]) >= 16]
        assert sorted((s.kind, s.start, s.end) for s in r.spans if s.kind in secrets.BASE) == sorted(want)
    assert secrets.scanned(odd).count() == len(ODD)
