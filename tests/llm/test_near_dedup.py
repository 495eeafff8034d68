"""Components against brute force, planted families, and odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import near_dedup, queries

SF = "/root/testdata/sf0.001"


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k:k + n]) for k in range(max(len(words) - n + 1, min(1, len(words))))}


def brute(rows, n, percent=80):
    """doc_id → (set size, component)."""
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    for k, (d, s) in enumerate(sets):
        met = {}
        for g in s:
            for j in where[g]:
                if j < k:
                    met[j] = met.get(j, 0) + 1
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = root(d), root(sets[j][0])
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets}


def decided(df, n):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.decisions(df, n).collect()}


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.queries()["op6_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("crowded", [512, 20])
def test_families_of_near_copies(spark, monkeypatch, crowded):
    """Families whose members are linked in part only: chains, borderline copies and large regions."""
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for size, edits in ((120, 7), (60, 11), (3, 2), (40, 1)):
        base = [word() for _ in range(80)]
        for _ in range(size):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(80)] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(word() for _ in range(60))) for k in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert decided(df, 2) == brute(rows, 2)


def brute_matrix(rows, n, percent=80):
    """The same for a group whose members all share shingles: all pairs by one product."""
    sets = [shingle_set(t, n) for _, t in rows]
    seen = {}
    for s in sets:
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    place = {g: k for k, g in enumerate(g for g, c in seen.items() if c > 1)}
    has = np.zeros((len(rows), len(place)), np.float32)
    for k, s in enumerate(sets):
        has[k, [place[g] for g in s if g in place]] = 1
    both, size = has @ has.T, np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.full(len(rows), -1)
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        if label[k] < 0:
            todo, label[k] = [k], rows[k][0]
            while todo:
                new = np.flatnonzero(linked[todo.pop()] & (label < 0))
                label[new] = rows[k][0]
                todo += new.tolist()
    return {d: (int(size[k]), int(label[k])) for k, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("hot,levels", [(64, 5), (8, 5), (4, 2)])
def test_a_group_of_2000_near_copies(spark, monkeypatch, hot, levels):
    """Copies just under and just over the threshold, copies of a copy, cut ones and an absent original."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    vocabulary = [word() for _ in range(300)]
    base = [word() for _ in range(120)]
    other = base[:80] + [word() for _ in range(40)]
    texts = []
    for k in range(2000):
        copy = list(base if k % 3 else other)
        for _ in range(rng.choice([1, 4, 5, 6, 7, 7, 8, 9, 14])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        if k % 11 == 0:
            del copy[rng.randrange(60, 110):]
        if k % 13 == 0:
            at = rng.randrange(100)
            del copy[at:at + rng.randrange(1, 9)]
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = brute_matrix(rows, 2)
    groups = {c for _, c in want.values()}
    assert 100 < len(groups) < 1500
    assert decided(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2) == want


@pytest.mark.parametrize("most", [1 << 27, 16])
def test_rows_of_what_nodes_of_a_cloud_add(spark, monkeypatch, most):
    """Of what 300 nodes add, 40 shingles each, only rarest ones that a second node may have become rows, and every pair that has to share one meets."""
    monkeypatch.setattr(near_dedup, "SHARED_BYTES", most)  # of a table of 16 bytes, each stands for hundreds of shingles
    rng = random.Random(5)
    size, own, p = 60, 20, 80
    added = []
    for k in range(300):
        fresh = list(range(10_000 + 40 * k, 10_000 + 40 * k + 40))
        twin = added[k - 1][:rng.randrange(20, 39)] if k % 10 == 1 else []
        added.append((twin + rng.sample(range(50), k % 3) + fresh)[:40])
    n = {}
    for g in (g for a in added for g in a):
        n[g] = n.get(g, 0) + 1
    counts = near_dedup.written(spark.createDataFrame([(7, g, c) for g, c in n.items()], "cloud long, g long, n long"), "counts")
    known = spark.createDataFrame([(7, k, k, True, size, own, 40, sorted(a)) for k, a in enumerate(added)],
                                  "cloud long, node long, label long, far boolean, size long, own long, n_added long, added array<long>")
    exploded = []

    class Spy:
        def __getattr__(self, name):
            return getattr(F, name)

        def explode(self, column):
            exploded.append(column)
            return F.explode(column)

    tables, write = {}, near_dedup.written
    monkeypatch.setattr(near_dedup, "F", Spy())
    monkeypatch.setattr(near_dedup, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    met, hot = near_dedup._sharing(known, counts, p, False)
    got = {(r.a, r.b) for r in met.collect()}
    assert {(r.g, r.n) for r in tables["rare"].collect()} <= {(g, c) for g, c in n.items() if c > 1}
    need = -(-size * p // 100) - own
    assert {(a, b) for a in range(300) for b in range(a + 1, 300) if len(set(added[a]) & set(added[b])) >= need} <= got and got
    assert exploded == ["rarest"]
    often = spark.sparkContext.broadcast(near_dedup._often(counts))
    rows = near_dedup._rarest(known, often, p).collect()
    assert all(set(r.rarest) <= set(added[r.node]) and len(r.rarest) <= size - -(-size * p // 100) + 1 for r in rows)
    if most > 16:
        assert sum(len(r.rarest) for r in rows) < 1.2 * sum(1 for a in added for g in a if n[g] > 1) < 0.3 * sum(map(len, added))


def test_sets_that_agree_in_half_their_names(spark):
    rows = [(k, 0, 5, h2, 3, b"x") for k, h2 in enumerate([7, 8, 7])] + [(9, 0, 6, 7, 3, b"x"), (10, 0, None, None, 0, None)]
    signed = spark.createDataFrame(rows, "doc_id long, text_key long, h1 long, h2 long, n_shingles long, signature binary")
    got = {(r.h1, r.h2): (r.node, r.first.doc_id) for r in near_dedup._nodes(signed).collect()}
    assert got[6, 7] == (6, 9) and got[5, 7][1] == 0 and got[5, 8][1] == 1 and len({n for n, _ in got.values()}) == 3


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A  b\tc"), (8, "é É"), (9, "É é"), (10, "x " * 5000), (11, "x x"), (6, "a b c")]
    df = spark.createDataFrame([*rows, (None, "a b c")], "doc_id long, text string").selectExpr("*", "1 as node", "'x' as a")
    got = near_dedup.decisions(df, 2).collect()
    assert len(got) == 13
    want = brute(rows[:-1], 2)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = near_dedup.kept_rows(df, 2)
    assert kept.columns == df.columns and {1, 2, 3, 4, 6, 8} <= {r.doc_id for r in kept.collect()}
    assert decided(df.limit(0), 2) == {} and near_dedup.kept_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_a_long_chain(spark, local):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 300), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.components(edges, local).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 200: 100, 300: 100}
