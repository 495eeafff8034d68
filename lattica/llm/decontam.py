"""Benchmark decontamination by template canonicalisation.

Words of a text become canonical tokens: numbers, names (capitalised words inside a sentence) and units become typed
placeholders, all others their lower-cased letters. Windows of ``WINDOW`` tokens are hashed and joined with the windows of
the benchmark. A second form keeps names as words, so that a copy in another case is found too. Where windows of an item
meet a text, the values in the slots are compared: one value of the item has to be one value in the text throughout, so a
question with other numbers or names is caught, and a chance meeting of templates isn't. An item that repeats a template
meets a text in several ways; values are compared along one of them, and values equal to the item's are always held.

A document is contaminated by an item if, within one stretch of the text of at most twice the item's length, at least
``SHARE`` of the item's windows are met and at least ``CONSISTENT`` of its repeated values are held. Stretches are checked
from each place of the text, and the best one that holds counts.

The benchmark's window hashes go to the executors as a Bloom filter of 16 bits and more for each window, up to
``FILTER_BITS``; its size is counted first. Windows that pass it are joined with the benchmark's windows by hash in Spark,
which shuffles or broadcasts by size. Of a benchmark of more than 67 million windows more chance hits go into that join;
the result is the same.
Windows that are nearly all placeholders say nothing and are left out on both sides.

Defined cases: null and empty texts are clean; an item shorter than a window is one window of its own length, met only
where it stands as a whole; an empty item is never met; a null item_id is ignored; rows that repeat are each decided
alike; rows with a null doc_id are decided by their text; extra columns are ignored by ``decisions`` and carried by
``clean_rows``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, on_leaving, written

WINDOW, SHARE, CONSISTENT = 5, 0.5, 0.8
#: The most bits of the Bloom filter (128 MB), and the least.
FILTER_BITS, LEAST_BITS = 1 << 30, 1 << 20
#: Bytes of a block in which parts of the filter are merged.
BLOCK = 1 << 16
#: Distinct words that a worker keeps.
WORDS = 400_000
#: Units of measure and currencies.
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer
kilometers mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres
gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz
w kw mw v a ohm j kj cal kcal pa kpa bar psi k c f usd eur gbp dollar dollars euro euros cent cents percent mph kmh kph""".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_MARKS = "\"'`.,;:!?()[]{}<>*#$%&|~^=_-–—“”‘’«»…"
NUMBER, NAME, UNIT, WORD = 1, 2, 3, 0
_PLACE = {NUMBER: 0x9E3779B97F4A7C15, NAME: 0xC2B2AE3D27D4EB4F, UNIT: 0x165667B19E3779F9}


class Canon(dict):
    """word → its place in the tables: hash, kind (-1: marks alone), whether it ends a sentence, whether it is capitalised."""

    def __init__(self):
        super().__init__()
        self.hash, self.kind = np.zeros(WORDS, np.uint64), np.zeros(WORDS, np.int8)
        self.ends, self.upper = np.zeros(WORDS, bool), np.zeros(WORDS, bool)

    def __missing__(self, word: str) -> int:
        core, at = word.strip(_MARKS), len(self)
        low = core.lower()
        if not core:
            self.kind[at], self.hash[at] = -1, 0
        elif "0" <= core[-1] <= "9" or "0" <= core[0] <= "9" and _NUMBER.fullmatch(core):
            number = bool(_NUMBER.fullmatch(core))
            self.kind[at], self.hash[at] = (NUMBER, _PLACE[NUMBER]) if number else (WORD, xxhash.xxh3_64_intdigest(low))
        elif low in UNITS:
            self.kind[at], self.hash[at] = UNIT, _PLACE[UNIT]
        else:
            self.kind[at], self.hash[at] = WORD, xxhash.xxh3_64_intdigest(low)
        self.ends[at] = not core or word.rstrip("\"')]*#$%&|”’»")[-1:] in ".!?:"
        self.upper[at] = core[:1].isupper()
        self[word] = at
        return at


_canon = Canon()
on_leaving(lambda: _canon.clear())


def tokens(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words that have letters or digits, their hashes with names as words and as placeholders, and their kinds."""
    global _canon
    lines = [line.split() for line in text.split("\n")]
    words = [w for line in lines for w in line]
    if not words:
        none = np.empty(0, np.uint64)
        return [], none, none, np.empty(0, np.int8)
    if len(_canon) + len(words) > WORDS:
        _canon = Canon()
        if len(words) > WORDS:
            return _long(lines, words)
    at = np.fromiter(map(_canon.__getitem__, words), np.int64, len(words))
    return _typed(lines, words, _canon.hash[at], _canon.kind[at], _canon.ends[at], _canon.upper[at])


def _long(lines: list[list[str]], words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """A text of more words than the table holds, table by table."""
    global _canon
    parts = []
    for k in range(0, len(words), WORDS):
        _canon = Canon()
        at = np.fromiter(map(_canon.__getitem__, words[k:k + WORDS]), np.int64)
        parts.append((_canon.hash[at], _canon.kind[at], _canon.ends[at], _canon.upper[at]))
    return _typed(lines, words, *map(np.concatenate, zip(*parts)))


def _typed(lines: list[list[str]], words: list[str], plain: np.ndarray, kind: np.ndarray, ends: np.ndarray, upper: np.ndarray):
    starts = np.concatenate([[True], ends[:-1]])
    begin = np.cumsum([len(line) for line in lines])[:-1]
    starts[begin[begin < len(words)]] = True
    kind[(kind == WORD) & upper & ~starts] = NAME
    some = kind >= 0
    cased = np.where(kind == NAME, np.uint64(_PLACE[NAME]), plain)
    if not some.all():
        words = [w for w, ok in zip(words, some.tolist()) if ok]
    return words, plain[some], cased[some], kind[some]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` tokens."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k:k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def spoken(kind: np.ndarray, size: int) -> np.ndarray:
    """Whether at least three, or half, of a window's tokens are words."""
    n = len(kind) - size + 1
    if n <= 0:
        return np.empty(0, bool)
    count = np.concatenate([[0], np.cumsum(kind == WORD)])
    return count[size:] - count[:-size] >= min(3, (size + 1) // 2)


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of hashes in a filter of ``size`` bits, a power of two."""
    return [((h * np.uint64(m)) >> np.uint64(65 - size.bit_length())).astype(np.int64) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _slots(words: list[str], kind: np.ndarray, a: int, size: int) -> list[str]:
    return [words[i].strip(_MARKS).lower() for i in range(a, a + size) if kind[i] > 0]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """hash, size, item_id, place, n_windows and slots of the windows of each item, in both forms."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(*[c.to_pylist() for c in batch.columns]):
                words, plain, cased, kind = tokens(text)
                size = min(WINDOW, len(words))
                if not size:
                    continue
                n = len(words) - size + 1
                forms = [(plain, np.where(kind == NAME, WORD, kind)), (cased, kind)]
                for form, (hashes, kinds) in enumerate(forms if (kind == NAME).any() else forms[:1]):
                    good = spoken(kinds, size)
                    for at in np.flatnonzero(good).tolist():
                        out.append((int(windows(hashes[at:at + size], size)[0].view(np.int64)), size, item, at, int(good.sum()), len(words), form, _slots(words, kinds, at, size)))
            names = ["hash", "size", "item_id", "place", "n_windows", "n_words", "form", "slots"]
            kinds_of = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds_of)], names=names)

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    return map_batches(rows, fn, "hash long, size int, item_id long, place int, n_windows int, n_words int, form int, slots array<string>")


def filter_bits(windows: int) -> int:
    """The size of the filter: at least 16 bits a window, as long as that is at most FILTER_BITS."""
    return min(FILTER_BITS, max(LEAST_BITS, 1 << (16 * max(1, windows) - 1).bit_length()))


def _filter(bench: DataFrame) -> tuple[bytes, list[int]]:
    """The Bloom filter of the benchmark's hashes, and the sizes of its windows. Tasks send the blocks that they set bits in; the driver holds the
    filter and one block."""
    size = filter_bits(bench.count())

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            for b in _bits(batch.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(packed, b >> 3, (128 >> (b & 7)).astype(np.uint8))
        for at in range(0, len(packed), BLOCK):
            if packed[at:at + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed[at:at + BLOCK].tobytes()], pa.binary())], names=["at", "block"])

    packed = np.zeros(size // 8, dtype=np.uint8)
    for r in map_batches(bench.select("hash").coalesce(8), fn, "at long, block binary").toLocalIterator():
        packed[r["at"]:r["at"] + BLOCK] |= np.frombuffer(r["block"], np.uint8)
    return packed.tobytes(), sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most WINDOW sizes


def _candidates(docs: DataFrame, bits: bytes, sizes: list[int]) -> DataFrame:
    """One row for each window of a text that passes the filter: its document, place, hash and slots."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes at most

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            rows = []
            for doc, key, text in zip(*[c.to_pylist() for c in batch.columns]):
                if not text:
                    continue
                words, plain, cased, kind = tokens(text)
                forms = [(plain, np.where(kind == NAME, WORD, kind)), (cased, kind)]
                for form, (hashes, kinds) in enumerate(forms if (kind == NAME).any() else forms[:1]):
                    for size in sizes:
                        h = windows(hashes, size)
                        at = np.arange(len(h))
                        for b in _bits(h, 8 * len(packed)):
                            b = b[at]
                            at = at[(packed[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1]
                        at = at[spoken(kinds, size)[at]]
                        if form:  # windows without a name are the same in both forms
                            named = np.concatenate([[0], np.cumsum(kind == NAME)])
                            at = at[named[at + size] > named[at]]
                        rows += [(doc, key, int(h[i].view(np.int64)), size, i, _slots(words, kinds, i, size)) for i in at.tolist()]
            names = ["doc_id", "key", "hash", "size", "at", "said"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return map_batches(docs, fn, "doc_id long, key long, hash long, size int, at int, said array<string>")


def _met(rows: list[dict]) -> float:
    """The best share of an item's windows within a stretch of the text in which the item's values are held; else 0."""
    best = 0.0
    for form in {r["form"] for r in rows}:
        own = sorted((r for r in rows if r["form"] == form), key=lambda r: (r["at"], r["place"]))
        n, reach = own[0]["n_windows"], 2 * own[0]["n_words"]
        least = max(1, math.ceil(SHARE * n))
        lines: dict[int, list[dict]] = {}
        for r in own:
            lines.setdefault(r["at"] - r["place"], []).append(r)
        widest = 0
        for line in lines.values():
            k = 0
            while len(line) - k > widest and len(line) - k >= least:  # from each of its places on, while that can add
                widest = max(widest, _held(line[k:]))
                k += 1
        count: dict[int, int] = {}
        a = b = 0
        while a < len(own):  # each place of the text begins a stretch
            while b < len(own) and own[b]["at"] <= own[a]["at"] + reach:
                count[own[b]["place"]] = count.get(own[b]["place"], 0) + 1
                b += 1
            if len(count) > widest and len(count) >= least:
                widest = max(widest, *map(_held, _readings(own[a:b])))
            at = own[a]["at"]
            while a < len(own) and own[a]["at"] == at:
                count[own[a]["place"]] -= 1
                if not count[own[a]["place"]]:
                    del count[own[a]["place"]]
                a += 1
        best = max(best, widest / n)
    return best


def _readings(rows: list[dict]) -> Iterator[list[dict]]:
    """Ways to read a stretch: all meetings; those of equal values; and one for each place, along an alignment that begins the stretch or the longest one, then by the others."""
    yield rows
    yield [r for r in rows if r["slots"] == r["said"]]
    lines: dict[int, list[dict]] = {}
    for r in rows:
        lines.setdefault(r["at"] - r["place"], []).append(r)
    order = sorted(lines.values(), key=len, reverse=True)
    for first in [order[0], *(line for line in order[1:] if line[0]["at"] == rows[0]["at"])]:
        places, ats, out = set(), set(), []
        for r in (r for part in (first, *order) for r in part):  # each place of the item and of the text is read once
            if r["place"] not in places and r["at"] not in ats:
                places.add(r["place"])
                ats.add(r["at"])
                out.append(r)
        yield sorted(out, key=lambda r: r["at"])


def _held(rows: list[dict]) -> int:
    """The most places of the item that a beginning of ``rows`` meets while its values stand for one value of the text each, but for a share; each window's slots are one reading."""
    said: dict[str, dict[str, int]] = {}
    top: dict[str, int] = {}
    places: set[int] = set()
    most = held = total = 0
    for r in rows:
        places.add(r["place"])
        for own, other in zip(r["slots"], r["said"]):
            values = said.setdefault(own, {})
            values[other] = values.get(other, 0) + 1
            total += 1
            if values[other] > top.get(own, 0):
                top[own] = values[other]
                held += 1
        if len(places) > most and (not total or held / total >= CONSISTENT):
            most = len(places)
    return most


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), item_id, share: one row for each contaminated document and item."""
    bench = written(benchmark_windows(benchmark), "bench")
    bits, sizes = _filter(bench)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    found = _candidates(rows, bits, sizes).join(bench, ["hash", "size"])
    met = found.groupBy("doc_id", "key", "item_id").agg(
        F.collect_set(F.struct("at", "place", "n_windows", "n_words", "form", "slots", "said")).alias("windows"))
    met = met.where(F.size("windows") >= F.array_min("windows.n_windows") * SHARE)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = [_met(rows) for rows in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(share, pa.float64())], names=["doc_id", "key", "item_id", "share"])

    return map_batches(met, fn, "doc_id long, key long, item_id long, share double").where(F.col("share") >= SHARE)


def decisions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, contaminated, kept, item_ids (ascending) and share (of the item met best)."""
    found = written(hits(docs, benchmark), "met").groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"))
    joined = rows.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.key = f.key"), "left")
    return joined.select("d.doc_id", F.expr("f.key is not null").alias("contaminated"), F.expr("f.key is null").alias("kept"),
                         F.coalesce("f.item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("f.share", F.lit(0.0)).alias("share"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that no item contaminates, with all their columns."""
    found = written(hits(docs, benchmark), "met").select(F.col("doc_id").alias("_met_id"), F.col("key").alias("_met_key")).distinct()
    clean = docs.join(found, (F.col("doc_id").cast("long").eqNullSafe(F.col("_met_id"))) & (F.xxhash64("text") == F.col("_met_key")), "left_anti")
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
