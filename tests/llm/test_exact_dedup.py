"""Groups against brute force, the index over several batches, failed verification, and odd rows."""

import hashlib
import re

from pyspark.sql import functions as F

from lattica.llm import exact_dedup, queries
from tests.llm.oracle import same_as_sql

SF = "/root/testdata/sf0.01"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted([(d, least[norm(t)], len(groups[norm(t)]), d == least[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows], key=str)


ODD = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (6, "\n\x0b"), (7, "x"), (7, "x"), (8, "é b"), (10, "é b"), (None, "n"), (None, "n"), (None, "a b"), (11, "b" * 200000), (12, "b" * 200000)]


def test_query_equals_sql(spark):
    same_as_sql(spark, SF, "op8_exact_dedup", queries)


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'k' as digest", "1 as id", "2 as rows")
    for limit in (0, 1000):
        got = exact_dedup.decisions(df, broadcast_rows=limit).collect()
        assert sorted(map(tuple, got), key=str) == brute(ODD)
        kept = exact_dedup.kept_rows(df, broadcast_rows=limit)
        assert kept.columns == df.columns
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(["3", "1", "4", "7", "8", "None", "11"])
    assert exact_dedup.decisions(df.limit(0)).count() == 0 and exact_dedup.kept_rows(df.limit(0)).count() == 0


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 3)
    rows = [(k, "same text" if k % 3 else f"t{k % 9}") for k in range(100)]
    assert sorted(map(tuple, exact_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_batches_flush_runs_and_compact(spark):
    rows = [(k, f"t{k % 7}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark)
    for part in (df.where("doc_id >= 30"), df.where("doc_id between 10 and 29")):
        index.flush(part)
    index.compact()
    index.flush(df.where("doc_id < 10"))
    assert len(index.pending) == 1
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = index.find([digest("t3"), digest("t5"), digest("none")])
    assert {(r.digest, r.id, r.rows) for r in found.collect()} == {(digest(f"t{k}"), k, len(range(k, 40, 7))) for k in (3, 5)}
    assert re.search(r"PushedFilters: \[[^]]*In\(digest", found._jdf.queryExecution().executedPlan().toString())
    index.compact()
    whole = exact_dedup.build(df).entries().select("digest", "id", "rows", "at_id")
    assert sorted(map(tuple, index.entries().select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert {(r.id, r.rows) for r in whole.collect()} == {(k, len(range(k, 40, 7))) for k in range(7)}


def test_runs_are_sorted(spark):
    df = spark.createDataFrame([(k, f"t{k % 50}") for k in range(300)], "doc_id long, text string").repartition(3)
    index = exact_dedup.DigestIndex(spark)
    index.flush(df)
    runs = {}
    for r in spark.read.parquet(index.pending[0]).select("digest", F.input_file_name().alias("run")).collect():
        runs.setdefault(r.run, []).append(r.digest)
    assert len(runs) == 3 and all(d == sorted(d) for d in runs.values()) and sum(map(len, runs.values())) == 300


def test_collision_is_found(spark, monkeypatch):
    """With a digest that doesn't tell texts apart, the bytes still do."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.decisions(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_no_python_in_the_plan(spark):
    plan = queries.queries()["op8_exact_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
