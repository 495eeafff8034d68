"""Each stage against a brute-force version on its own input."""

import base64
import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def stage_outputs(spark, docs, sf_dir, tmp):
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{tmp}/{k}")
        out.append(spark.read.parquet(f"{tmp}/{k}"))
    return out


def checked(outputs, items):
    columns = outputs[0].columns
    rows = [o.collect() for o in outputs]
    assert all(o.columns == columns for o in outputs[:-1])
    start, spoken, exact, near, clean, ids = rows
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in spoken)
    assert {r.doc_id for r in start if not re.search(r"[^\W\d_]", r.text or "")}.isdisjoint(r.doc_id for r in spoken)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in spoken:
        first[norm(r.text)] = min(r.doc_id, first.get(norm(r.text), r.doc_id))
    assert sorted(first.values()) == sorted(r.doc_id for r in exact)
    want = brute([(r.doc_id, r.text) for r in exact], 5)
    assert sorted({c for _, c in want.values()}) == sorted(r.doc_id for r in near)
    gone = {r.doc_id for r in near} - {r.doc_id for r in clean}
    assert {r.doc_id for r in near if any(i in r.text for i in items)} == gone
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in clean}
    assert sorted(texts) == sorted(r.doc_id for r in ids)
    for r in ids:
        want_ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want_ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want_ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    return rows


@pytest.fixture(scope="module")
def items(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def test_stages_on_the_whole_table(spark, items, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = checked(stage_outputs(spark, docs, SF, str(tmp_path)), items)
    assert len(rows[1]) == len(rows[0])  # all these documents are of some language
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, rows[-1]))


def test_stages_on_odd_rows(spark, items, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("doc_id", "text", "lang", "source", "n_chars", "'z' as row", "1 as score", "2 as digest", "3 as node")
    extra = spark.createDataFrame([(9001, None, None, None, None, "a", 1, 1, 1), (9002, "", "en", "s", 0, "a", 1, 1, 1), (9003, "123 !!", "en", "s", 6, "a", 1, 1, 1),
                                   (9004, "and this  is kept", "en", "s", 9, "a", 1, 1, 1), (9005, "and this\nis kept", "en", "s", 9, "a", 1, 1, 1),
                                   (9004, "and this  is kept", "en", "s", 9, "a", 1, 1, 1), (9006, "lead in. " + items[0], "en", None, None, "a", 1, 1, 1)], docs.schema)
    rows = checked(stage_outputs(spark, docs.union(extra), SF, str(tmp_path)), items)
    left = {r.doc_id for r in rows[-1]}
    assert 9004 in left and not left & {9001, 9002, 9003, 9005, 9006}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert all(o.count() == 0 for o in stage_outputs(spark, docs, SF, str(tmp_path)))
