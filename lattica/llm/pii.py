"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes that adds spans.

Base patterns give emails, IP addresses, card numbers and phone numbers, leftmost and without overlaps within a kind;
matches that fail their check are dropped. The field is trained from ``LABELLED``, a small table of marked lines, by
gradient ascent on its likelihood, and finds what the patterns can't: phone numbers without a plus, spelled-out and
bracketed addresses, IP addresses written apart or of version 6, card numbers that fail their check. It reads words as
shapes: the classes of their characters, their length, their digits, whether they are one of a few telling words
(``TELLING``), and the same of both neighbours. What it decodes stands: a span is added unless it overlaps a base span.

A sequence is one line of a text; a line of more than ``LONG`` words is cut into pieces of at most that many, after the
last word of a piece that has letters alone and isn't a telling one. Sequences are decoded by Viterbi in numpy batches of
at most ``CELLS`` words. A sequence whose words all score so far below "nothing" that no run of transitions could make
up for it is left out, as its decoding is known: it is empty.

Defined cases: a null text counts as empty and has no spans; offsets are code points; rows are independent, so repeated
rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits matches only where the run's start does
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: The labelled table: a span is written {kind:text}.
LABELLED = """
call {phone:(212) 555-0188} before noon
his number is {phone:(017) 555-7713} and she
phone {phone:(415) 555-2671} or write
ring {phone:555-867-5309} today
fax {phone:212-555-0143} please
tel {phone:312-555-0199}
tel: {phone:312.555.0147}
dial {phone:020 7946 0958} for the office
call us at {phone:0800 555 0112} any day
reach me on {phone:(974) 555-3436} after six
cell {phone:617-555-0170} thanks
the desk {phone:(503) 555-0122} is open
mobile {phone:07700 900 123} works best
text {phone:415 555 0136} to join
she left {phone:646-555-0109}, then hung up
ask for Ann at {phone:(808) 555-0164}.
office {phone:030 1234 5678} or
telephone {phone:01632 960 983}
{phone:(702) 555-0155} is the number
and {phone:919-555-0128} rang all day
write to {email:jane [at] mail [dot] com} soon
mail {email:bob [at] example [dot] org} now
contact {email:info (at) site (dot) net} for help
send it to {email:sales [at] shop [dot] com} today
address {email:x.y [at] host [dot] org}
email {email:joe at site dot com} and wait
write {email:mary.jones at example dot org} for more
reach {email:support at company dot net} any time
mail me: {email:tom at home dot com}
the address is {email:kim at school dot edu} she said
ask {email:press at paper dot co dot uk} first
send to {email:ann.lee at mail dot example dot org} please
{email:lee (at) work dot com} or call
email us {email:hello [at] town dot org}.
contact {email:bill_b at firm dot de} today
card {card:4111 1111 1111 1112} was declined
number {card:5500-0000-0000-0005} expired
pay with {card:6011 0009 9013 9425} only
visa {card:4012 8888 8888 1882} on file
his card {card:3782-8224-6310-0051} is lost
card no {card:4000 1234 5678 9011} ends in May
use {card:5105-1051-0510-5101} to pay
charged to {card:4222 2222 2222 2221} twice
mastercard {card:5454 5454 5454 5455} valid
the account {card:6011-1111-1111-1118} was closed
from {ip:192[.]168[.]1[.]20} it came
ip {ip:10[.]0[.]0[.]1} is blocked
host {ip:203 . 0 . 113 . 7} answered
server {ip:198 dot 51 dot 100 dot 23} is down
ip {ip:10 dot 0 dot 0 dot 8} pinged
log in from {ip:172 . 16 . 254 . 1} failed
address {ip:2001:db8::8a2e:370:7334} was seen
ip {ip:fe80::1ff:fe23:4567:890a} on the link
the host {ip:185(.)220(.)101(.)4} scanned us
server {ip:2001:0db8:85a3:0000:0000:8a2e:0370:7334} up
and {ip:91[.]189[.]92[.]38} again
Licensed under the Apache License, Version 2.0.
version 3.1.4 of the library is out
see section 4.2 and table 12 for details
in 1998 there were 250 people at the show
from 2001 to 2010 it grew by 12.5 percent
the price is $19.99 or 20 dollars
token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" was leaked
ths. token = "2b0cb261201f091f991b2c1144c292e775ffe40a"
secret "90871200112233445566778899aabbccddeeff00" in the file
at at at at at at at
key = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" expired
order 8861234 shipped on 2021-03-04 at 10:30
it is a plain line of words and nothing else
Was and. Then by the river, they (all of them) sat [or stood] there
the well-known state-of-the-art method (see above) works
| name | value | total | share |
### a $$$ junk *** line %%% here &&&
WHO ARE THEY!! NOBODY KNOWS!! AT ALL!!
chapter 7 page 44 line 3 of 12
1 2 3 4 5 6 7 8 9 10
pi is 3.14159265 and e is 2.71828
isbn 978-3-16-148410-0 is a book number
on 12/05/2019 the (second) meeting [open to all] took place
Licensed under CC BY-NC 4.0.
General Public License, version 3.
between 10-12 and 14-16 each day
scores 3-1 and 2-0 in 90 minutes
id 7536784127813050 and 4845168114407329 appear
he said: yes! she said: no? they left...
http://www.example.org/a/b?c=1 is a link
file_name-01.txt and file_name-02.txt were read
look at this dot on the map and at that line
they met at noon at the site near the sea
the dot com boom ended at last
a red dot at the end of the line is a mark
sit at home or at work, at ease
at 10:30 he was at the shop with a card and a phone
the card was on the host table at the office
call at the desk or mail a letter to the address
the server was down and the phone rang at six
ratio 3:2 and time 12:45:10 were noted
1984 and 2001 are books; 451 is too
add 250 g of flour, 100 ml of milk and 2 eggs
rooms 101, 102 and 103 on floor 12
a total of 1,250,000 people in 35 towns
isbn 978-0-306-40615-7 and ISBN: 0-306-40615-2 are codes
part no 123-456-7890-12 is out of stock
mr.smith at noon went home and j.doe at ten
look at p.12 and at fig.3 or see dot.com
id 4845168114407329 appears, nr 1234567890123456 too
number 2669109448945250 on the list
number 9807915762804490 in the row
10 20 30 40 50 60 70 are tens
5 12 18 24 30 33
card 2 of 4 and visa rules for 90 days
the 978 series, 0 306 40615 7, is old
de de de de de de de de de de
es es es es es of of of of
lystti at es edon. And so
he it at es annd. Erl
of. of. of. of. of. of. of. of. of.
The The The an. an. an. an. in. in.
Wh. Onor haonnt thha on at thonin. The. That. At.
El ue de la, esbocio. Ado. Ascos. En el.
www.example.org and docs.site.net/a are hosts
e.g. this, i.e. that, etc. at the end
Dr. A. B. Smith lives at St. John dot street
@home and @work are tags, a@ too
2 + 2 = 4 and 10 - 3 = 7
from 100 to 200 to 300 and then 1000 more
year 2020 2021 2022 2023 2024
dans la maison de la ville on the at and of
der Hund und die Katze (alle) gehen nach Hause
el perro y el gato [todos] van a casa
item 12 costs 3 . 50 or so
step 1 . open the box . step 2 . close it
std::vector<int>::iterator it = a::b::c
see fig. 3 (a) and fig. 4 (b) at page 5
""".strip().split("\n")

#: Words that tell, by class.
TELLING = {1: "at", 2: "dot", 3: "com org net edu gov io uk", 4: "call phone tel telephone mobile cell fax dial ring text",
           5: "card visa mastercard account", 6: "email mail contact write", 7: "ip host server address"}
LONG, CELLS = 512, 1 << 16

LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Bits of a word: upper, lower or other letter, digit, @, dot, hyphen, bracket, other.
_BITS = np.full(128, 128, dtype=np.uint8)
for _chars, _bit in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("0123456789", 4), ("@", 8), (".", 16), ("-", 32), ("()[]", 64), (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", 0)):
    for _c in _chars:
        _BITS[ord(_c)] = _bit
_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
SHAPES = 256 * 4 * 8 * 8
_MOST = 10  # letters of a telling word
_WEIGHTS = np.append(np.random.default_rng(11).integers(1, 1 << 63, _MOST, dtype=np.uint64) | np.uint64(1), np.uint64(0))


def _named(word: str) -> int:
    return sum(ord(c) * int(_WEIGHTS[k]) for k, c in enumerate(word)) % (1 << 64)


_TOLD = sorted((_named(word), kind) for kind, row in TELLING.items() for word in row.split())
_TOLD_NAMES, _TOLD_KINDS = np.array([n for n, _ in _TOLD], np.uint64), np.array([k for _, k in _TOLD])


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "") if len(m.group()) >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and shape of each word, and whether a line begins there."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bits = _BITS[np.minimum(codes, 127)]
    if len(far := np.flatnonzero(codes > 127)):
        bits[far] = np.where(np.isin(codes[far], _SPACES), 0, 2)
    inside = bits != 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, start, start.astype(bool)
    core = bits.copy()  # without the marks that end a word
    ending = np.append(~inside[1:], True)
    for _ in range(3):
        ending &= np.isin(bits, (16, 128))
        core[ending] = 0
        ending = np.append(ending[1:], False)
    either = np.bitwise_or.reduceat(core, start).astype(np.int64)
    digits = np.add.reduceat((bits == 4).astype(np.int32), start)
    size = end - start
    shape = (either * 4 + np.digitize(size, [4, 8, 13])) * 8 + np.digitize(digits, [1, 2, 3, 4, 5, 8, 12])
    shape = shape * 8 + _told(codes, bits, start, either, digits)
    lines = np.searchsorted(np.flatnonzero(codes == 10), start)
    return start, end, shape, np.concatenate([[True], lines[1:] != lines[:-1]])


def _told(codes: np.ndarray, bits: np.ndarray, start: np.ndarray, either: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """The class of each word whose letters are a telling word, else 0."""
    letter = (bits & 3) != 0
    upto = np.cumsum(letter, dtype=np.int32)
    count = np.diff(np.append(upto[start] - letter[start], upto[-1]))
    some = np.flatnonzero((count >= 2) & (count <= _MOST) & (digits == 0))
    out = np.zeros(len(start), np.int64)
    # only the letters of words that are short enough
    of = np.repeat(np.arange(len(some)), count[some])
    first = np.cumsum(count[some]) - count[some]
    at = np.flatnonzero(letter)[np.repeat(upto[start[some]] - letter[start[some]] - first, count[some]) + np.arange(len(of))]
    value = (codes[at] | np.uint32(32)).astype(np.uint64) * _WEIGHTS[np.arange(len(of)) - first[of]]
    if len(some):
        name = np.add.reduceat(value, first)
        place = np.minimum(np.searchsorted(_TOLD_NAMES, name), len(_TOLD_NAMES) - 1)
        out[some] = np.where(_TOLD_NAMES[place] == name, _TOLD_KINDS[place], 0)
    return out


def _factors(shape: np.ndarray) -> np.ndarray:
    """Features of shapes: their bits, length, digits and class."""
    bits = (shape[:, None] >> 8 >> np.arange(8)) & 1
    return np.concatenate([bits, np.eye(4)[(shape >> 6) & 3], np.eye(8)[(shape >> 3) & 7], np.eye(8)[shape & 7], np.ones((len(shape), 1))], axis=1).astype(np.float32)


class Field:
    """Transition scores and the score of each label for each shape of a word and of its neighbours."""

    def __init__(self, rows: list[str], steps: int = 100, rate: float = 0.15, decay: float = 0.004):
        n, data = len(LABELS), [self._marked(row) for row in rows]
        seen = np.unique(np.concatenate([shape for shape, _ in data]))
        f = np.concatenate([_factors(seen), np.zeros((1, _factors(seen[:1]).shape[1]), np.float32)])  # the last: no neighbour
        w, own, t = np.zeros((3, f.shape[1], n)), np.zeros((len(seen) + 1, n)), np.zeros((n, n))
        means, squares = [np.zeros_like(x) for x in (w, own, t)], [np.zeros_like(x) for x in (w, own, t)]
        # all rows at once, the longest first, so that those that go on are a beginning of the table
        data.sort(key=lambda d: -len(d[0]))
        size = np.array([len(shape) for shape, _ in data])
        place = np.full((len(data), size.max() + 2), len(seen))
        y = np.zeros((len(data), size.max()), int)
        for k, (shape, labels) in enumerate(data):
            place[k, 1:len(shape) + 1], y[k, :len(shape)] = np.searchsorted(seen, shape), labels
        alive = np.arange(size.max())[None, :] < size[:, None]
        near = [place[:, :-2][alive], place[:, 1:-1][alive], place[:, 2:][alive]]
        truth = np.eye(n)[y[alive]]
        pairs = alive[:, 1:]
        edges = np.zeros((n, n))
        np.add.at(edges, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        for step in range(1, steps + 1):
            e = np.zeros((*alive.shape, n))
            e[alive] = own[near[1]] + sum(f[near[k]] @ w[k] for k in range(3))
            node, edge = self._expected(e, t, alive)
            left = truth - node[alive]
            grads = [-decay * x for x in (w, own, t)]
            for k in range(3):
                grads[0][k] += f[near[k]].T @ left
            np.add.at(grads[1], near[1], left)
            grads[2] += edges - edge
            for k, (p, g) in enumerate(zip((w, own, t), grads)):  # Adam
                means[k] = 0.9 * means[k] + 0.1 * g
                squares[k] = 0.99 * squares[k] + 0.01 * g * g
                p += rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
        for k, name in enumerate(LABELS):  # an I follows only its own B or I
            if name[0] == "I":
                t[[j for j, other in enumerate(LABELS) if other[1:] != name[1:]], k] = -30
        self.t = t.astype(np.float32)
        every = _factors(np.arange(SHAPES))
        # The last row is "no neighbour".
        self.e = [np.concatenate([every @ w[k], np.zeros((1, n))]).astype(np.float32) for k in range(3)]
        self.e[1][seen] += own[:-1].astype(np.float32)
        gain = max(0.0, float(self.t.max() - self.t[0, 0]))
        self.most = [(x[:, 1:] - x[:, :1]).max(axis=1) for x in self.e]
        self.most[1] += 2 * gain

    @staticmethod
    def _marked(row: str) -> tuple[np.ndarray, np.ndarray]:
        text, spans = "", []
        for part in re.split(r"(\{\w+:[^}]*\})", row):
            if m := re.fullmatch(r"\{(\w+):([^}]*)\}", part):
                spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
                text += m[2]
            else:
                text += part
        start, end, shape, _ = words(text)
        y = np.zeros(len(start), dtype=int)
        for a, b, kind in spans:
            inside = np.flatnonzero((start >= a) & (end <= b))
            y[inside] = 2 + 2 * kind
            y[inside[:1]] = 1 + 2 * kind
        return shape, y

    @staticmethod
    def _expected(e: np.ndarray, t: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels, and the summed marginals of transitions, by forward and backward sums over rows of words."""
        def lse(x, axis):
            top = x.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

        fwd, bwd = e.copy(), np.zeros_like(e)
        for i in range(1, e.shape[1]):
            on = int(alive[:, i].sum())
            fwd[:on, i] += lse(fwd[:on, i - 1, :, None] + t, 1)
        for i in range(e.shape[1] - 2, -1, -1):
            on = int(alive[:, i + 1].sum())
            bwd[:on, i] = lse(t + (e[:on, i + 1] + bwd[:on, i + 1])[:, None, :], 2)
        total = lse(fwd[np.arange(len(e)), alive.sum(axis=1) - 1], 1)
        edge = np.zeros_like(t)
        for i in range(e.shape[1] - 1):
            on = int(alive[:, i + 1].sum())
            edge += np.exp(fwd[:on, i, :, None] + t + (e[:on, i + 1] + bwd[:on, i + 1])[:, None, :] - total[:on, None, None]).sum(axis=0)
        return np.exp(fwd + bwd - total[:, None, None]), edge

    def decode(self, shape: np.ndarray, first: np.ndarray, prune: bool = True) -> np.ndarray:
        """The best label of each word. first: where a line begins."""
        y = np.zeros(len(shape), dtype=np.int8)
        if not len(shape):
            return y
        before, after = np.roll(shape, 1), np.roll(shape, -1)
        before[first], after[np.append(first[1:], True)] = SHAPES, SHAPES
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(shape)))
        hot = np.arange(len(begin))
        if prune:
            above = self.most[0][before] + self.most[1][shape] + self.most[2][after] >= 0
            hot = np.flatnonzero(np.logical_or.reduceat(above, begin))
        hot = hot[np.argsort(size[hot], kind="stable")]
        at = 0
        while at < len(hot):
            # as many sequences as fit into CELLS, the longest of them last
            fits = np.arange(1, len(hot) - at + 1) * size[hot[at:]] <= CELLS
            lines = hot[at:at + max(1, int(fits.argmin()) if not fits.all() else len(fits))]
            at += len(lines)
            rows, long = begin[lines], int(size[lines].max())
            alive = np.arange(long)[None, :] < size[lines][:, None]
            where = np.minimum(rows[:, None] + np.arange(long), len(shape) - 1)
            back = np.zeros((long, len(lines), len(LABELS)), dtype=np.int8)
            score = None
            for i in range(long):
                w = where[:, i]
                e = self.e[0][before[w]] + self.e[1][shape[w]] + self.e[2][after[w]]
                if i == 0:
                    score = e - 30 * np.array([name[0] == "I" for name in LABELS], dtype=np.float32)
                    continue
                through = score[:, :, None] + self.t
                back[i] = through.argmax(axis=1)
                score = np.where(alive[:, i, None], through.max(axis=1) + e, score)
                back[i][~alive[:, i]] = np.arange(len(LABELS))
            label = score.argmax(axis=1)
            for i in range(long - 1, -1, -1):
                ok = alive[:, i]
                y[where[ok, i]] = label[ok]
                label = back[i][np.arange(len(lines)), label]
        return y


_fields: dict[tuple[str, ...], Field] = {}


def trained(rows: list[str] = LABELLED) -> Field:
    return _fields.setdefault(tuple(rows), _fields.get(tuple(rows)) or Field(rows))


_TRIM = ".,;:!?\"'*#$%&|"


def _pieces(shape: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a sequence begins: each line, and the pieces of lines of more than LONG words."""
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(shape)))
    if not (size > LONG).any():
        return first
    first = first.copy()
    quiet = ((shape >> 8) < 4) & (shape & 7 == 0)
    for a, n in zip(begin[size > LONG].tolist(), size[size > LONG].tolist()):
        end = a + n
        while end - a > LONG:
            before = np.flatnonzero(quiet[a:a + LONG])
            a += int(before[-1]) + 1 if len(before) else LONG
            first[a] = True
    return first


def added_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of the field in each text, as (start, kind number, end)."""
    joined, starts = "\n".join(texts), np.cumsum([0] + [len(t) + 1 for t in texts])
    start, end, shape, first = words(joined)
    first = _pieces(shape, first)
    y = field.decode(shape, first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hits = np.flatnonzero(y)
    k = 0
    while k < len(hits):
        i = j = int(hits[k])
        kind = (int(y[i]) - 1) // 2
        while j + 1 < len(y) and y[j + 1] == 2 + 2 * kind and not first[j + 1]:
            j += 1
        k += j - i + 1
        a, b = int(start[i]), int(end[j])
        b = a + len(joined[a:b].rstrip(_TRIM))
        a = b - len(joined[a:b].lstrip(_TRIM))
        doc = int(np.searchsorted(starts, a, side="right")) - 1
        if b > a:
            out[doc].append((a - int(starts[doc]), kind, b - int(starts[doc])))
    return out


def find(field: Field, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text."""
    texts = [t or "" for t in texts]
    out = []
    for text, more in zip(texts, added_spans(field, texts)):
        base = base_spans(text)
        new = [s for s in more if not any(s[0] < b and a < s[2] for a, _, b in base)]
        out.append((base, sorted(base + new) if new else base))
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans."""
    field = docs.sparkSession.sparkContext.broadcast(trained())  # of fixed size

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(field.value, batch.column(1).to_pylist())
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *counts, pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b, _ in found], pa.string()),
                pa.array([_said(a) for _, a in found], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return map_batches(docs.select("doc_id", "text"), fn,
                       "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
