"""Encoding against tiktoken and the plain library, round trips, and the shard format."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lattica.llm import bpe, grammar, queries

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  ", "\n", " \n ", "a", "don't stop", "a  b", "x \n\n y", "\ttab", "ends ", "naïve 漢字 🙂🙂", "<|endoftext|>", "!" * 50, "a" * 5000, "\x1c\x85 "]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    rng = random.Random(7)
    parts = [" ", "\n", "\t", "a", "th", "er", "'s", "'", "12", ".", "é", "  ", " ", "　", "漢", "🙂", "\r\n", "!!", "\x85", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_rank_ids_equal_tiktoken(reference):
    own, texts = bpe.codec(RANKS, P.PATTERN), ODD + random_texts(3000)
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == reference.encode_ordinary(text or "")
        assert own.decode(ids) == (text or "").encode()


def test_json_ids_equal_library():
    own, texts = bpe.codec(P.path("byte_bpe_50k.json")), ODD + random_texts(2000)
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_full_piece_table_is_emptied(monkeypatch, reference):
    monkeypatch.setattr(bpe, "PIECES", 5)
    own = bpe.Codec(bpe.codec(RANKS, P.PATTERN).tokenizer)
    for texts in (["one two three four five six seven eight"], ["nine two ten"], random_texts(50)):
        for text, ids in zip(texts, own.encode(texts)):
            assert ids.tolist() == reference.encode_ordinary(text)


def test_offsets_and_split_characters():
    own, text = bpe.codec(RANKS, P.PATTERN), "naïve 漢字 🙂 end"
    ids = own.encode([text])[0]
    starts, ends = own.offsets(ids, text)
    assert starts[0] == 0 and ends[-1] == len(text) and (starts < ends).all()
    pieces = own.decode_pieces(ids)
    assert "".join(pieces) == text
    for i, a, b in zip(ids.tolist(), starts, ends):
        assert own.bytes[i] in text[a:b].encode()


def test_encode_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a b", 6)], "doc_id long, text string, ids int")
    got = bpe.encode(df, RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert got[0].ids == [] and got[0].text is None and len(got[1].ids) == len(got[1].starts) == 2
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_op3_whole_table(spark, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op3_bpe_codec"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("ids", [[], [0], [1] * 999, [1, 2] * 500 + [3], list(range(300)) * 7])
def test_grammar_round_trip(ids):
    g = grammar.Grammar(grammar.compress(np.array(ids, dtype=np.uint32), 400, min_count=2))
    assert g.ids().tolist() == ids
    for a, b in [(0, 1), (0, len(ids)), (3, 17), (5, 5), (len(ids) - 1, len(ids))]:
        if 0 <= a <= b <= len(ids):
            assert g.slice(a, b).tolist() == ids[a:b]


def test_grammar_random_and_smaller():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.4, 20000).clip(1, 399).astype(np.uint32)
    packed = grammar.compress(ids, 400)
    assert (grammar.Grammar(packed).ids() == ids).all() and len(packed) < 2 * len(ids)
    wide = grammar.Grammar(grammar.compress(ids, 65530))  # more than 65536 symbols
    assert len(wide.rules) > 6 and (wide.ids() == ids).all() and (wide.slice(700, 9000) == ids[700:9000]).all()


@pytest.mark.parametrize("ids", [[1, 2] * 500, [1] * 3000, list(range(300)) * 70, [5, 5, 6] * 999])
def test_grammar_goes_on_until_no_pair_is_frequent(ids):
    g = grammar.Grammar(grammar.compress(np.array(ids, dtype=np.uint32), 400, min_count=4))
    seq = g.seq.tolist()
    counts, k = {}, 0
    while k + 1 < len(seq):  # without overlaps
        pair = (seq[k], seq[k + 1])
        counts[pair] = counts.get(pair, 0) + 1
        k += 2 if seq[k] == seq[k + 1] else 1
    assert max(counts.values(), default=0) < 2 * 4 and g.ids().tolist() == ids
    lengths = grammar.expansion_lengths(g.rules, 400)
    assert lengths.tolist() == g.lengths.tolist() and int(lengths[g.seq].sum()) == len(ids)


def test_slice_looks_at_covering_symbols_only():
    ids = np.random.default_rng(4).zipf(1.3, 50_000).clip(1, 399).astype(np.uint32)
    g = grammar.Grammar(grammar.compress(ids, 400))
    seen = []
    whole, g.expand = g.expand, lambda seq: seen.append(len(seq)) or whole(seq)
    assert (g.slice(20_000, 20_010) == ids[20_000:20_010]).all() and max(seen) <= 10 and g.flat is None


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d")], "doc_id long, text string")
    got = bpe.digests(df, RANKS, P.PATTERN).collect()
    assert len(got) == 3 and len(set(map(tuple, got))) == 2
    read = grammar.read_documents(spark, grammar.write_shards(df, P.path("byte_bpe_50k.json"))).collect()
    assert sorted(tuple(r) for r in read) == brute_shards([(1, "a b c"), (1, "a b c"), (2, "d")])


def brute_shards(docs):
    own, start, out = bpe.codec(P.path("byte_bpe_50k.json")).tokenizer, 0, []
    for doc_id, text in docs:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_op5_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = queries.queries()["op5_grammar_shards"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_shards(docs)


def test_shards_odd_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "null id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = grammar.write_shards(df, P.path("byte_bpe_50k.json"), shard_ids=100)
    got = grammar.read_documents(spark, path).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [tuple(r) for r in got] == brute_shards([(None, "null id"), *[(k, t) for k, t, _ in rows[:-1]]])
    empty = grammar.write_shards(df.limit(0), P.path("byte_bpe_50k.json"))
    assert grammar.read_documents(spark, empty).count() == 0


def test_portions_hold_all_rows(monkeypatch):
    """Batches are cut by their bytes of text, not dropped or reordered; a text that is larger stands alone."""
    import pyarrow as pa

    from lattica.llm import bpe

    monkeypatch.setattr(bpe, "PORTION", 10)
    texts = ["abc", None, "", "\u00e9" * 4, "x" * 50, "", "y" * 10, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(bpe.portions(iter([batch.slice(0, 0), batch, batch.slice(3)]), 1))
    assert [(r["doc_id"], r["text"]) for b in got for r in b.to_pylist()] == [*enumerate(texts), *list(enumerate(texts))[3:]]
    assert all(b.num_rows == 1 or sum(len((r["text"] or "").encode()) for r in b.to_pylist()) <= 10 for b in got)


def test_a_word_is_given_and_kept_once_whatever_marks_follow():
    own = bpe.Codec(bpe.codec(P.path("byte_bpe_50k.json")).tokenizer)
    given, plain = [], own.plain
    own.plain = type("Counted", (), {"encode_batch_fast": lambda _, blocks, **k: given.extend(blocks) or plain.encode_batch_fast(blocks, **k)})()
    texts = ["x wörd", "x wörd, wörd. wörd!? wörd...", "y wörd; stone\nwörd\nwörd: stone"]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    words = " ".join(given).split(" ")
    assert len(words) == len(set(words)) == 7  # stone after a space, the others after one and without
    own.encode(["x wörd" + mark for mark in bpe.MARKS])
    assert len(" ".join(given).split(" ")) == 7 and sorted(w for w in own.known if w) == ["stone", "wörd", "x", "y"]


def test_columns_are_encoded_as_lists(monkeypatch):
    import pyarrow as pa

    texts = [*ODD, "", None, " \nx", "a \n b", "\n", "x\n", " x", "x ", "a\n\nb", "\u00aa\u00b5!", "x\u0301 e\u0301!", "don't' '", "\ufb01 \u02b0x, \u01c5.", *random_texts(500)]
    own = bpe.Codec(bpe.codec(P.path("byte_bpe_50k.json")).tokenizer)
    want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["before", *texts, "after"], kind)
        assert [x.tolist() for x in own.encode(column.slice(1, len(texts)))] == want
    assert own.encode([]) == [] and own.encode(pa.array([None], pa.string()))[0].tolist() == []
    small = bpe.Codec(own.tokenizer, pieces=3)
    assert [x.tolist() for t in texts for x in small.encode([t])] == want and small.places < 100
