"""Base spans against the plain patterns, and the field against exhaustive decoding."""

import hashlib
import itertools
import random
import re

import numpy as np

from lattica.llm import pii, queries

SF = "/root/testdata/sf0.001"
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            doubled = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d))) if d else 0
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split(".")) or kind == 2 and 14 <= len(d) <= 19 and doubled % 10 == 0 or kind == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", "+", " ", "12", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "+1 (212) 555-0188", "é", "\n", "x@y.z", "(", "0"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_end_soon():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 300_000, "1." * 100_000, "+1 " * 100_000):
        pii.base_spans(text)


def test_viterbi_is_exhaustive():
    field = pii.trained()
    for text in ("call (212) 555-0188 now", "jane [at] mail [dot] com", "plain words here"):
        _, _, shape, first = pii.words(text)
        near = [np.append(shape, pii.SHAPES)[k] for k in (np.arange(len(shape)) - 1, np.arange(len(shape)), np.arange(1, len(shape) + 1))]
        near[0][0] = pii.SHAPES
        e = sum(field.e[k][near[k]] for k in range(3))
        best = max((y for y in itertools.product(range(9), repeat=len(shape)) if pii.LABELS[y[0]][0] != "I"),
                   key=lambda y: sum(e[i, y[i]] for i in range(len(y))) + sum(field.t[a, b] for a, b in zip(y, y[1:])))
        assert field.decode(shape, first).tolist() == list(best)


def test_marginals_against_all_labellings():
    """The sums of training, over rows of different lengths."""
    rng, n = np.random.default_rng(0), len(pii.LABELS)
    e, t, alive = rng.normal(size=(2, 3, n)), rng.normal(size=(n, n)), np.array([[1, 1, 1], [1, 1, 0]], bool)
    node, edge = pii.Field._expected(e * alive[:, :, None], t, alive)
    want_edge = np.zeros((n, n))
    for k, size in enumerate((3, 2)):
        every = list(itertools.product(range(n), repeat=size))
        weight = np.exp([sum(e[k, i, y[i]] for i in range(size)) + sum(t[a, b] for a, b in zip(y, y[1:])) for y in every])
        weight /= weight.sum()
        for i in range(size):
            assert np.allclose(node[k, i], [weight[[y[i] == c for y in every]].sum() for c in range(n)])
        for y, w in zip(every, weight):
            for pair in zip(y, y[1:]):
                want_edge[pair] += w
    assert np.allclose(edge, want_edge)


#: Lines that the field hasn't seen, marked alike.
HELD_OUT = """
please call {phone:(303) 555-0191} at once
our phone {phone:415-555-0172} is busy
fax number {phone:(619) 555-0133} for orders
tel {phone:718.555.0126} after nine
dial {phone:0161 496 0758} to book
reach Bob on {phone:808-555-0117}, please
his cell {phone:(907) 555-0150} was off
ring {phone:020 7946 0345} now
mail {email:peter [at] garden [dot] org} for seeds
contact {email:office (at) lake (dot) com} soon
write to {email:sam at bakery dot com} today
email {email:nina.brown at school dot edu} please
send it to {email:desk [at] press [dot] net} or
ask {email:luis at harbor dot org} first
address {email:a.b [at] sea [dot] com}
the card {card:4111 2222 3333 4445} expired
pay by {card:5500-1111-2222-3338} only
visa {card:4539 1488 0343 6468} was lost
number {card:6011-5555-6666-7773} is on file
ip {ip:10[.]20[.]30[.]40} was blocked
the host {ip:172[.]16[.]0[.]9} answered
server {ip:203 dot 0 dot 113 dot 99} is back
from {ip:198 . 51 . 100 . 77} it came
address {ip:2001:db8:1::ab9:c0a8:102} was seen
the old house at the end of the street was sold
in 1876 there were 40 ships and 900 men at sea
version 10.4.2 needs 512 MB of memory
they came at ten, left at noon and met at six
a dot on the page, a dash at the edge
chapters 3, 4 and 5 (see page 120) are short
order 5567812 was sent on 2020-11-23 at 09:15
token = "0f1e2d3c4b5a69788796a5b4c3d2e1f001234567" is old
| a | b | c | 12 | 15 |
the war of 1812 and the year 1914 [see below]
Was en la de, thon es. At the, of and. El.
WHAT!! IS!! THAT!! AT!! ALL!!
3 of 10 and 7 of 12 are 25 percent
http://www.site.com/page?id=12345 is down
call me when the card is at the desk
the mail was at the host address
""".strip().split("\n")


def test_precision_and_recall_on_held_out_lines():
    field, found, right, want = pii.trained(), 0, 0, 0
    for row in HELD_OUT:
        text, spans = "", set()
        for part in re.split(r"(\{\w+:[^}]*\})", row):
            if m := re.fullmatch(r"\{(\w+):([^}]*)\}", part):
                spans.add((len(text), pii.KINDS.index(m[1]), len(text) + len(m[2])))
                part = m[2]
            text += part
        assert not set(pii.base_spans(text)) & spans  # the patterns find none of them
        got = set(pii.added_spans(field, [text])[0]) - set(pii.base_spans(text))
        found, right, want = found + len(got), right + len(got & spans), want + len(spans)
    assert right / found >= 0.8 and right / want >= 0.8, (found, right, want)


def test_field_leaves_prose_alone(spark):
    """Of 1000 documents, whatever the field adds holds digits or an at: it doesn't take prose for personal data."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    added = [t[a:b] for t, (base, every) in zip(texts, pii.find(pii.trained(), texts)) for a, _, b in set(every) - set(base)]
    assert len(added) <= 5


def test_long_lines_take_bounded_batches():
    """A long line among short ones: pieces, not padding of all to the longest."""
    field = pii.trained()
    long = " ".join(f"w{k} 555 (a)" for k in range(60_000))
    found = pii.added_spans(field, ["call (212) 555-0188 now"] * 500 + [long + " ring (212) 555-0188 today"] + ["ring 212-555-0143"] * 12)
    assert all(x == [(5, 3, 19)] for x in found[:500]) and (len(long) + 6, 3, len(long) + 20) in found[500]
    _, _, shape, first = pii.words(long)
    begin = np.flatnonzero(pii._pieces(shape, first))
    assert np.diff(np.append(begin, len(shape))).max() <= pii.LONG


def test_pruned_lines_are_empty(spark):
    field = pii.trained()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    _, _, shape, first = pii.words("\n".join(texts))
    assert (field.decode(shape, first) == field.decode(shape, first, prune=False)).all()


def test_field_adds_what_patterns_miss():
    field = pii.trained()
    found = pii.find(field, ["call me at (555) 123-4567 now", "mail john [at] foo [dot] com", None, "", "plain text, version 2.0."])
    assert found[0] == ([], [(11, 3, 25)]) and found[1][1][0][1] == 0 and found[2:] == [([], [])] * 3


def test_query_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op10_personal_data"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a@b.c 🙂 x@y.zz"), (2, ""), (2, "")], "doc_id long, text string").selectExpr("*", "1 as n_ip")
    got = {(r.doc_id, r.spans) for r in pii.spans(df).collect()}
    assert got == {(1, ""), (None, "email:0:5,email:8:14"), (2, "")}
    assert pii.spans(df.limit(0)).count() == 0
