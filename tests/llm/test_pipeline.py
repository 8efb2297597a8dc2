"""Each stage of the pipeline against plain Python over its own input, and its edge cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passbook.llm import common, quality
from test_queries import expected

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def inputs(spark):
    """What each stage reads, by name, and what the last one gives."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = docs
        docs = common.written(stage(spark, docs, SF), "stage")
    return found | {"end": docs}


def after(inputs, name):
    names = [*STAGE, "end"]
    return {r.doc_id: r for r in inputs[names[names.index(name) + 1]].collect()}


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_low_quality_goes(spark, inputs):
    docs = inputs["quality classifier"]
    model = quality.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if model.score(quality.blocks((r.text or "").encode())) >= quality.THRESHOLD}
    assert set(after(inputs, "quality classifier")) == want and 0 < len(want) < docs.count()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(label[d] == 0 for d in want if d in label) <= 0.1 * len(want)


def test_one_of_each_group_stays(inputs):
    rows = inputs["SimHash near-dedup"].orderBy("doc_id").collect()
    sets, root = [shingled(r.text) for r in rows], list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x in enumerate(sets):
        for j in range(i):
            if 0.8 * max(len(x), len(sets[j])) <= min(len(x), len(sets[j])) and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert set(after(inputs, "SimHash near-dedup")) == {r.doc_id for i, r in enumerate(rows) if find(i) == i}


def test_contaminated_go(spark, inputs):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    rows = inputs["benchmark decontamination"].collect()
    assert set(after(inputs, "benchmark decontamination")) == {r.doc_id for r in rows if clean(words(r.text))} != {r.doc_id for r in rows}


def test_secrets_are_replaced(inputs):
    kept, changed = after(inputs, "secret scans"), 0
    rows = inputs["secret scans"].collect()
    assert set(kept) == {r.doc_id for r in rows}
    for r in rows:
        text, end, out = r.text or "", 0, ""
        for kind, start, stop in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in expected(text))):
            if start >= end:
                out += text[end:start] + f"<{kind}>"
            end = max(end, stop)
        out += text[end:]
        changed += out != text
        assert kept[r.doc_id].text == (r.text if r.text is None else out) and kept[r.doc_id].n_chars == len(out)
    assert changed


def test_ids_decode(inputs):
    import public_tokenizers as p
    import tiktoken

    from passbook.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(p.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids, texts = after(inputs, "byte-level BPE"), {r.doc_id: r.text or "" for r in inputs["byte-level BPE"].collect()}
    assert set(ids) == set(texts)
    for d, r in ids.items():
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert got == enc.encode_ordinary(texts[d]) and r.n_tokens == len(got) and enc.decode(got) == texts[d]


def test_run(spark, inputs):
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in inputs["end"].collect()}


@pytest.mark.parametrize("name", list(STAGE))
def test_nulls_and_empty_tables(spark, inputs, name):
    docs = inputs[name]
    odd = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(3).withColumn("text", F.lit(""))).unionByName(docs.limit(2))
    odd = odd.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    out = STAGE[name](spark, common.written(odd, "odd"), SF)
    assert 0 < out.count() <= odd.count() and STAGE[name](spark, docs.where("false"), SF).count() == 0
    assert out.columns == (["doc_id", "n_tokens", "ids"] if name == "byte-level BPE" else docs.columns)
