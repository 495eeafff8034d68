"""Held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np

from lattica.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op1_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "el perro y el gato", "es"),
                                  (4, None, "en"), (5, "", None), (6, "123 $$$", "en"), (None, "the dog and the cat", None), (1, "the cat and the dog", "en"),
                                  (7, "word " * 100000, None)], "doc_id long, text string, lang string").selectExpr("*", "'x' as score")
    got = {(r.doc_id, r.text): r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[1, "the cat and the dog"].lang_pred == "en" and got[None, "the dog and the cat"].lang_pred in {"en", "de", "es"}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in [(4, None), (5, ""), (6, "123 $$$")])
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    one = docs.where("lang = 'de'")
    assert langid.predict(one, langid.Model(langid.features(["ja"]), np.array(["de"]))).first().lang_pred == "de"


def test_features_follow_whole_text():
    a, b = langid.features(["abc " * 50000 + "xyz", "abc " * 50000])
    assert not np.array_equal(a, b) and abs(np.linalg.norm(a) - 1) < 1e-5
    assert np.allclose(langid.features(["x", "abc"])[1], langid.features(["abc"])[0])


def plain_features(text):
    """The definition, gram by gram."""
    raw = text.lower().encode().translate(langid.PLAIN) + b"\0\0"
    count = np.zeros(langid.BUCKETS)
    for i in range(len(raw) - 2):
        two = (raw[i] * 257 + raw[i + 1]) % 2**32
        for salt, gram in enumerate((raw[i], two, (two * 263 + raw[i + 2]) % 2**32)):
            count[(((gram ^ (gram >> 15)) * 2654435761 + salt * 40503) % 2**32) >> 20] += 1
    x = np.sqrt(count)
    return x / max(np.linalg.norm(x), 1e-9)


def test_features_against_the_definition(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (5, 0, 900, 17, 62, 63, 64, 65, 66, 129, 130, 300)]
    for group in (1 << 20, 64):  # groups of texts, and long texts in parts
        monkeypatch.setattr(langid, "GROUP", group)
        assert np.abs(langid.features(texts) - np.stack([plain_features(t) for t in texts])).max() < 1e-6


def test_predictions_against_plain_loops(spark):
    """The whole table with one fixed model, decided text by text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    for r in docs.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        x = plain_features(r.text)
        top = np.exp([langid.SLOPE * (w[:-1] @ x + w[-1]) for w in model.top])
        f = int(np.argmax(top))
        codes = list(model.families.values())[f]
        votes = {c: 0.0 for c in codes}
        for (a, b), w in model.pairs.items():
            if a in votes:
                p = 1 / (1 + np.exp(-langid.SLOPE * (w[:-1] @ x + w[-1])))
                votes[a] += p
                votes[b] += 1 - p
        best = max(codes, key=votes.get)
        want = votes[best] / max(1, len(codes) - 1) * top[f] / top.sum() if len(codes) > 1 else top[f] / top.sum()
        assert got[r.doc_id][0] == best and abs(got[r.doc_id][1] - want) < 1e-4


def test_svm_reaches_the_optimum():
    """The weights against many steps of plain gradient descent on the same loss."""
    rng = np.random.default_rng(2)
    y = np.where(rng.random(80) < 0.4, 1, -1)
    x = (rng.normal(size=(80, 5)) + y[:, None] * 0.8).astype(np.float32)
    weight = np.where(y > 0, 80 / (2 * (y > 0).sum()), 80 / (2 * (y < 0).sum()))
    one = np.concatenate([x, np.ones((80, 1))], axis=1)
    loss = lambda w: 0.5 * w @ w + langid.COST * (weight * np.maximum(0, 1 - y * (one @ w)) ** 2).sum()
    w = np.zeros(6)
    for _ in range(20_000):
        w -= 2e-5 * (w - 2 * langid.COST * ((weight * np.maximum(0, 1 - y * (one @ w)) * y) @ one))
    assert loss(langid.linear_svm(x, y, epochs=200)) <= loss(w) * 1.01
