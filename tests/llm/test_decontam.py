"""Planted passages, re-parameterised questions, and a brute-force search for whole items."""

import numpy as np

from lattica.llm import decontam, queries

SF = "/root/testdata/sf0.01"
ITEM = "Tom has 12 apples and gives 5 apples to Mary Jones before he walks 3 km to the market and sells 12 more."


def decided(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as share")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: list(r.item_ids) for r in decontam.decisions(d, b).collect()}


def test_reparameterised_and_inconsistent(spark):
    other = ITEM.replace("12", "40").replace("5", "9").replace("Mary Jones", "Anna Smith").replace("3 km", "8 miles")
    uneven = ITEM.replace("has 12", "has 40").replace("sells 12", "sells 77")
    docs = [(1, "Some words come first. " + ITEM + " Some words follow."), (2, "Intro here. " + other), (3, ITEM.lower()),
            (4, "A clean text about apples and the market and nothing else at all."), (5, None), (6, ""), (1, "Some words come first. " + ITEM + " Some words follow.")]
    got = decided(spark, docs, [(7, ITEM), (8, None), (9, ""), (None, ITEM), (10, "short one")])
    assert got == {1: [7], 2: [7], 3: [7], 4: [], 5: [], 6: []}
    words, _, _, kind = decontam.tokens(uneven)
    assert [w for w, k in zip(words, kind) if k == decontam.NUMBER] == ["40", "5", "3", "77"]


def test_slots_must_hold(spark):
    item = "the sum of 7 and 7 with 7 and 7 or 7 then 7 by 7"
    same, mixed = item.replace("7", "31"), "the sum of 1 and 2 with 3 and 4 or 5 then 6 by 8"
    assert decided(spark, [(1, same), (2, mixed)], [(5, item)]) == {1: [5], 2: []}


def test_repeated_template_with_other_values(spark):
    item = "Tom buys 3 red pens for school. Ann buys 5 red pens for school."
    other = item.replace("3", "8").replace("5", "9")
    apart = item.replace("school. Ann", "school. Then it rained for quite a while. Ann")
    assert decided(spark, [(1, item), (2, other), (3, apart)], [(5, item)]) == {1: [5], 2: [5], 3: [5]}


def test_each_stretch_is_checked(spark):
    item = "the sum of 7 and 7 with 7 and 7 or 7 then 7 by 7"
    mixed = "the sum of 1 and 2 with 3 and 4 or 5 then 6 by 8"
    far = " Other words stand here for a long while and say nothing." * 9 + " "
    half = "we saw 4 cats run home past 4 red gates and then past 4 low walls by the sea"
    odd = "we saw 5 cats run home past 6 red gates and then past 7 low walls by the sea"
    docs = [(1, mixed + far + item), (2, mixed + far + item.replace("7", "31")), (3, item + far + mixed), (4, mixed + far + mixed),
            (5, odd + far + " ".join(half.split()[:-4]))]
    assert decided(spark, docs, [(5, item), (6, half)]) == {1: [5], 2: [5], 3: [5], 4: [], 5: [6]}


def test_short_items_and_empty_tables(spark):
    assert decided(spark, [(1, "x red fish swims y"), (2, "red fish")], [(1, "red fish swims")]) == {1: [1], 2: []}
    assert decided(spark, [], [(1, ITEM)]) == {}
    assert decided(spark, [(1, ITEM), (None, ITEM)], []) == {1: [], None: []}
    assert decided(spark, [(None, ITEM), (None, "clean words of another text here")], [(3, ITEM)]) in ({None: [3]}, {None: []})


def test_clean_rows(spark):
    d = spark.createDataFrame([(1, "x " + ITEM, 3), (2, "a clean one", 4), (None, None, 5)], "doc_id long, text string, item_ids int")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontam.clean_rows(d, b)
    assert got.columns == d.columns and sorted(r.item_ids for r in got.collect()) == [4, 5]


def test_texts_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(decontam, "WORDS", 50)
    monkeypatch.setattr(decontam, "_canon", decontam.Canon())
    text = " ".join(f"w{k}x" for k in range(300))
    words, plain, _, _ = decontam.tokens(text)
    assert len(words) == 300 == len(set(plain.tolist()))


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {r.doc_id: set(r.item_ids) for r in queries.queries()["op7_decontamination"](spark, SF).collect()}
    assert len(got) == len(docs)
    grams = {}
    for item in items:
        words = item.text.lower().split()
        for k in range(len(words) - 7):
            grams.setdefault(tuple(words[k:k + 8]), set()).add(item.item_id)
    for d in docs:
        whole = {i.item_id for i in items if i.text in d.text}
        words = d.text.lower().split()
        touched = set().union(*[grams.get(tuple(words[k:k + 8]), set()) for k in range(len(words) - 7)], set())
        assert whole <= got[d.doc_id] <= touched, d.doc_id


def met_by_loops(docs, items):
    """(doc_id, item_id) → the meetings of their windows, token tuple by token tuple, without hashes or filters."""
    def forms(text):
        words, _, _, kind = decontam.tokens(text)
        plain = [w.strip(decontam._MARKS).lower() for w in words]
        out = []
        for named in (False, True):
            kinds = [decontam.WORD if k == decontam.NAME and not named else int(k) for k in kind]
            out.append((words, [p if k == decontam.WORD else k for p, k in zip(plain, kinds)], kinds))
        return out if (kind == decontam.NAME).any() else out[:1]

    def windows(form, size):
        words, tokens, kinds = form
        for at in range(len(words) - size + 1):
            part = kinds[at:at + size]
            if part.count(decontam.WORD) >= min(3, (size + 1) // 2):
                slots = [w.strip(decontam._MARKS).lower() for w, k in zip(words[at:at + size], part) if k > 0]
                yield at, tuple(tokens[at:at + size]), slots

    found, items = {}, [(i, forms(t), len(decontam.tokens(t)[0])) for i, t in items if t]
    index = {}
    for item, own, n in items:
        size = min(decontam.WINDOW, n)
        for form, f in enumerate(own if size else []):
            every = list(windows(f, size))
            for place, key, slots in every:
                index.setdefault((size, key), []).append((item, place, len(every), n, form, slots))
    for doc, text in docs:
        theirs = forms(text or "")
        for number, f in enumerate(theirs):
            for size in {s for s, _ in index}:
                for at, key, said in windows(f, size):
                    if number and decontam.NAME not in key:
                        continue  # the same window in both forms
                    for item, place, n_windows, n_words, form, slots in index.get((size, key), ()):
                        row = (at, place, n_windows, n_words, form, tuple(slots), tuple(said))
                        found.setdefault((doc, item), set()).add(row)
    return found


def test_decisions_against_loops(spark):
    """Every document and item of the small tables, with re-parameterised and broken copies of items among the documents."""
    small = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(900, ITEM), (901, "the sum of 7 and 7 with 7 and 7 or 7 then 7 by 7")]
    docs += [(90001, ITEM.replace("12", "31")), (90002, ITEM.replace("has 12", "has 40")), (90003, "so " + items[0][1] + " end"), (90004, "the sum of 1 and 2 with 3 and 4 or 5 then 6 by 8"),
             (90005, ITEM.replace("Mary Jones", "Ann Lee").replace("km", "miles").lower()), (90006, " ".join(ITEM.split()[:9]) + " and then something else happens altogether")]
    want = {}
    for (doc, item), rows in met_by_loops(docs, items).items():
        names = ("at", "place", "n_windows", "n_words", "form", "slots", "said")
        rows = [dict(zip(names, (*r[:5], list(r[5]), list(r[6])))) for r in rows]
        if len(rows) >= rows[0]["n_windows"] * decontam.SHARE and decontam._met(rows) >= decontam.SHARE:
            want.setdefault(doc, set()).add(item)
    got = {doc: set(found) for doc, found in decided(spark, docs, items).items() if found}
    assert got == want and {90001, 90003} <= set(got) and 90004 not in got and 90006 not in got


def test_filter_grows_with_the_benchmark(spark):
    assert [decontam.filter_bits(n) for n in (0, 1000, 1 << 16, (1 << 16) + 1, 1 << 40)] == [1 << 20, 1 << 20, 1 << 20, 1 << 21, 1 << 30]
    hashes = spark.range(100_000).selectExpr("xxhash64(id) as hash", "5 as size")
    bits, sizes = decontam._filter(hashes)
    assert len(bits) * 8 == decontam.filter_bits(100_000) and sizes == [5]
    packed = np.frombuffer(bits, np.uint8)

    def passed(rows):
        h = np.array([r[0] for r in rows.collect()]).view(np.uint64)
        return np.mean(np.all([(packed[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1 for b in decontam._bits(h, 8 * len(packed))], axis=0))

    assert passed(hashes.select("hash")) == 1 and passed(spark.range(10_000).selectExpr("xxhash64(id, 7) as hash")) < 0.02
