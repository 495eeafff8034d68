"""Held-out accuracy, the exchange of labels, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import cotrain, queries

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 5 <> 0")
    scored = cotrain.score(docs, cotrain.fit(docs, train)).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    y, s = np.array([r.quality for r in scored]), np.array([r.score for r in scored])
    assert np.mean((s >= 0.5) == (y == 1)) > 0.9
    assert np.mean(s[y == 1] >= 0.5) > 0.95
    assert all(0 <= x <= 1 for r in scored for x in (r.score, r.text_score, r.meta_score))


def test_query_scores_all(spark):
    got = queries.queries()["op4_quality"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_views_teach_each_other():
    """A view that few labels can't teach learns from the other one, in every draw; together they are no worse."""
    gain = []
    for seed in range(1, 6):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, 2, 4000).astype(float)
        views = [np.concatenate([y[:, None] * 5 + rng.normal(size=(4000, 1)), rng.normal(size=(4000, 3))], axis=1),
                 rng.normal(size=(4000, 40)) + (2 * y[:, None] - 1) * 0.25]
        few, pool, rest = slice(0, 60), slice(60, 2000), slice(2000, None)
        alone = cotrain.Model([v[few] for v in views], y[few], [v[:0] for v in views])
        taught = cotrain.Model([v[few] for v in views], y[few], [v[pool] for v in views])
        right = lambda m: [np.mean((s >= 0.5) == (y[rest] == 1)) for s in m.score([v[rest] for v in views])]
        gain.append(np.subtract(right(taught), right(alone)))
    gain = np.array(gain)
    assert (gain[:, 1] > 0.02).all() and gain[:, 1].mean() > 0.04 and gain[:, 2].mean() > 0


def test_scores_against_plain_sums(spark):
    """One fixed model: the scores of the table, document by document."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = cotrain.fit(docs, labels)
    got = {r.doc_id: (r.text_score, r.meta_score, r.score) for r in cotrain.score(docs, model).collect()}
    for r in docs.collect():
        views = [cotrain.text_view(r.text)[None, :], cotrain.metadata_view(r.source, r.lang, r.n_chars)[None, :]]
        assert np.allclose([float(s[0]) for s in model.score(views)], got[r.doc_id], atol=1e-6)


def test_all_unlabelled_documents_take_part():
    """A share of the corpus is exchanged, so a rare kind of text teaches however many documents there are."""
    rng = np.random.default_rng(2)
    n = 20000
    y = rng.integers(0, 2, n).astype(float)
    views = [np.concatenate([y[:, None] * 6 + rng.normal(size=(n, 1)), rng.normal(size=(n, 3))], axis=1) for _ in (0, 1)]
    few, pool = slice(0, 400), [v[400:] for v in views]
    sums = []

    class Counting(cotrain.Rows):
        def sum(self, of, scaled, rounds, w):
            if of is cotrain._added:
                sums.append([int((~np.isnan(t)).sum()) for t in cotrain._exchanged(scaled(self.views), self.place, rounds)[1]])
            return super().sum(of, scaled, rounds, w)

    cotrain.Model([v[few] for v in views], y[few], Counting(pool))
    assert all(0.8 * cotrain.ROUNDS * 0.05 * len(pool[0]) < x for x in sums[-1])  # 4000 and more; 1000 of each view before


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "s", "en", 0), (None, "a b", "s", None, -5), (2, "", "s", "en", 0), (3, "x " * 100000, "t", "de", 200000)],
                                 "doc_id long, text string, source string, lang string, n_chars long").selectExpr("*", "1 as y", "2 as score")
    for rows, want in (([], 0.5), ([(1, 1), (2, None)], 1.0), ([(1, 0), (9, 1)], 0.0)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert {r.score for r in cotrain.score(docs, cotrain.fit(docs, labels)).collect()} == {want}
    both = spark.createDataFrame([(1, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    assert cotrain.score(docs, cotrain.fit(docs, both)).count() == 5
    assert cotrain.score(docs.limit(0), cotrain.fit(docs.limit(0), both)).count() == 0


def test_packed_sums():
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=(50, 6)), rng.integers(0, 2, 50), rng.normal(size=7)
    sums = cotrain._sums(x, y, w)
    assert len(cotrain._packed(sums)) == 7 * 8 // 2 + 7
    assert np.allclose(cotrain._unpacked(cotrain._packed(sums), sums.shape), sums, rtol=1e-12)


def test_what_is_sent_does_not_grow_with_the_files(spark):
    rows = spark.createDataFrame([(0.1, b"", b"")], "place double, a binary, b binary").repartition(300)
    assert cotrain.Table(rows).rows.rdd.getNumPartitions() <= max(cotrain.ADDERS, spark.sparkContext.defaultParallelism)


def test_no_text_is_shuffled_to_find_the_unlabelled(spark, monkeypatch):
    """By a broadcast of identifiers or, where they are many, by a join of views: the same documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    seen, scores = [], []
    keep = cotrain.written

    def spy(df, name):
        out = keep(df, name)
        if name == "views":
            seen.append((df._jdf.queryExecution().optimizedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(cotrain, "written", spy)
    for most in (cotrain.BROADCAST_ROWS, 0):
        monkeypatch.setattr(cotrain, "BROADCAST_ROWS", most)
        scores.append({(r.doc_id, r.n): r.s for r in cotrain.score(docs, cotrain.fit(docs, labels)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()})
    want = docs.join(labels.where("quality is not null"), "doc_id", "left_anti").count()
    assert [n for _, n in seen] == [want, want]
    small, large = (plan for plan, _ in seen)
    assert "strategy=broadcast" in small and large.index("Join") < large.index("MapInArrow")
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][k] - scores[1][k]) < 1e-6 for k in scores[0])
