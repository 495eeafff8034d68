"""Token shards in a Re-Pair grammar format.

Documents are encoded in ascending order of doc_id, each followed by an end id. A *shard* holds about ``SHARD_IDS`` ids.
Within a shard, frequent pairs of neighbouring symbols are replaced by a new nonterminal, round after round: each round
counts all pairs, takes those with at least ``SHARE`` of the largest count (and ``MIN_COUNT``), and replaces their
occurrences from left to right, until no pair stands ``MIN_COUNT`` times. What is stored: the rules, the length of each
rule's expansion, and the remaining sequence. With the expansion lengths, any range of ids is decoded from the symbols
that cover it alone, and only the rules that these use are looked at.

Shards are rows of a Parquet table in the shared store: ``part`` and ``shard`` (their order is the order of the ids),
``doc_ids``, ``counts`` and ``payload``. Symbols take 16 bits, or 32 in a shard that has more than 65536 of them.

Defined cases: a null text counts as empty, so its document is the end id alone; null doc_ids come first; rows with the
same doc_id are ordered by a hash of their text; extra columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import bpe
from lattica.llm.common import map_batches, scratch_path

SHARD_IDS = 1 << 20
SHARE, MIN_COUNT = 1 / 32, 8
#: Distinct words whose ids a worker keeps while it writes shards (about 200 bytes each).
PIECES = 1_500_000
MAGIC = b"RPG1"
_SLOTS = 1 << 18


def _replaced(seq: np.ndarray, first: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the new sequence, and the pairs that became the symbols first, first + 1, ..."""
    half, mixer, kind = (16, np.uint32(0x9E3779B1), np.uint32) if first <= 1 << 16 else (32, np.uint64(0x9E3779B97F4A7C15), np.uint64)
    slot_of = lambda c: ((c * mixer) >> kind(2 * half - 18)).astype(np.intp)
    code = (seq[:-1].astype(kind) << kind(half)) | seq[1:]
    at = slot_of(code)
    # A pair is no more frequent than its slot, and some pair is as frequent as the best of the fullest slot: most needn't be counted.
    full = np.bincount(at, minlength=_SLOTS)
    best = np.unique(code[at == full.argmax()], return_counts=True)[1].max()
    pairs, counts = np.unique(code[(full >= max(min_count, int(best * SHARE)))[at]], return_counts=True)
    good = counts >= max(min_count, int(counts.max(initial=0) * SHARE))
    pairs, counts = pairs[good], counts[good]
    pairs = pairs[np.argsort(-counts, kind="stable")]
    _, free = np.unique(slot_of(pairs), return_index=True)  # a pair whose slot is taken waits for the next round
    pairs = pairs[np.sort(free)]
    if not len(pairs):
        return seq, np.empty((0, 2), dtype=np.uint32)
    number = np.full(_SLOTS, -1, dtype=np.int32)
    number[slot_of(pairs)] = np.arange(len(pairs))
    where = np.flatnonzero((number >= 0)[at])
    new = number[at[where]]
    same = pairs[new] == code[where]
    where, new = where[same], new[same]
    # Of pairs that overlap in a row, every second one is replaced, from the left.
    begins = np.concatenate([[True], np.diff(where) != 1])
    place = np.arange(len(where))
    take = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
    where, new = where[take], new[take]
    out, keep = seq.copy(), np.ones(len(seq), dtype=bool)
    out[where], keep[where + 1] = first + new, False
    return out[keep], np.stack([pairs >> kind(half), pairs & kind((1 << half) - 1)], axis=1).astype(np.uint32)


def compress(ids: np.ndarray, terminals: int, min_count: int = MIN_COUNT) -> bytes:
    """The grammar of a sequence of ids below ``terminals``."""
    seq, rules = np.asarray(ids, dtype=np.uint32), np.empty((0, 2), dtype=np.uint32)
    lengths = np.ones(terminals, dtype=np.int64)
    while len(seq) > min_count:
        seq, new = _replaced(seq, terminals + len(rules), min_count)
        if not len(new):
            break
        rules = np.concatenate([rules, new])
        lengths = np.concatenate([lengths, lengths[new].sum(axis=1)])  # a round's rules refer to earlier rounds only
    wide = terminals + len(rules) > 1 << 16
    kind = "<u4" if wide else "<u2"
    return b"".join([MAGIC, struct.pack("<BIIQ", wide, terminals, len(rules), len(seq)), rules.astype(kind).tobytes(),
                     lengths[terminals:].astype("<u4").tobytes(), seq.astype(kind).tobytes()])


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """The number of ids of each symbol. A rule refers to earlier symbols only, but to some of its own round's predecessors never."""
    lengths = np.ones(terminals + len(rules), dtype=np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[terminals + k] = lengths[a] + lengths[b]
    return lengths


class Grammar:
    """A stored shard's payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        wide, self.terminals, n, m = struct.unpack_from("<BIIQ", payload, 4)
        kind, at = np.dtype("<u4" if wide else "<u2"), 4 + struct.calcsize("<BIIQ")
        self.rules = np.frombuffer(payload, kind, 2 * n, at).reshape(n, 2).astype(np.uint32)
        at += 2 * n * kind.itemsize
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), np.frombuffer(payload, "<u4", n, at).astype(np.int64)])
        self.seq = np.frombuffer(payload, kind, m, at + 4 * n).astype(np.uint32)
        self.ends = np.cumsum(self.lengths[self.seq])
        self.flat: np.ndarray | None = None

    def ids(self) -> np.ndarray:
        """All ids, copied from the expansions of all symbols, which are made once."""
        if self.flat is None:
            at = self.terminals
            self.begins = np.concatenate([np.arange(at), at + np.cumsum(self.lengths[at:]) - self.lengths[at:]])
            own, whole = np.arange(at, dtype=np.uint32), []
            part = lambda x: whole[x - at] if x >= at else own[x:x + 1]
            for x, y in self.rules.tolist():
                whole.append(np.concatenate([part(x), part(y)]))
            self.flat = np.concatenate([own, *whole])
        size = self.lengths[self.seq]
        return self.flat[np.repeat(self.begins[self.seq] - (self.ends - size), size) + np.arange(int(self.ends[-1]) if len(size) else 0)]

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for; each pass replaces the nonterminals that are left by their rules."""
        while (more := seq >= self.terminals).any():
            at = np.cumsum(1 + more) - 1 - more
            out = np.empty(len(seq) + int(more.sum()), np.uint32)
            out[at[~more]] = seq[~more]
            rule = self.rules[seq[more] - self.terminals]
            out[at[more]], out[at[more] + 1] = rule[:, 0], rule[:, 1]
            seq = out
        return seq

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start up to end, from the symbols that cover them."""
        if end <= start:
            return np.empty(0, dtype=np.uint32)
        a, b = np.searchsorted(self.ends, [start, end - 1], side="right")
        before = int(self.ends[a - 1]) if a else 0
        return self.expand(self.seq[a:b + 1])[start - before:end - before]


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None, shard_ids: int = SHARD_IDS) -> str:
    """Encode documents and write the shards; returns the folder."""
    path = path or scratch_path(docs.sparkSession, "shards")
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
            .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, shard = bpe.codec(vocabulary, pieces=PIECES), TaskContext.get().partitionId(), 0
        end, docs_in, ids_in, held = np.array([end_id], dtype="<u4"), [], [], 0

        def row() -> pa.RecordBatch:
            counts = np.array([len(x) + 1 for x in ids_in], dtype="<u4")
            ids = np.concatenate([y for x in ids_in for y in (x, end)])
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([docs_in], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([compress(ids, len(own.bytes))], pa.binary())],
                names=["part", "shard", "doc_ids", "counts", "n_ids", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1))):
                docs_in.append(doc)
                ids_in.append(ids)
                held += len(ids) + 1
                if held >= shard_ids:
                    yield row()
                    docs_in, ids_in, held, shard = [], [], 0, shard + 1
        if docs_in:
            yield row()

    map_batches(rows, fn, "part int, shard int, doc_ids array<long>, counts array<long>, n_ids long, payload binary").write.parquet(path)
    return path


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard and the ids before the shard; sums of parts come first, so that no task sees all shards."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (shards.select("part", "shard", within.alias("within")).join(parts.select("part", "before"), "part")
            .select("part", "shard", (F.col("before") + F.col("within")).alias("base")))


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards."""
    shards = spark.read.parquet(path)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids, counts = Grammar(x["payload"]).ids().astype("<u4"), np.array(x["counts"], dtype=np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["part"]] * len(counts), pa.int32()), pa.array([x["shard"]] * len(counts), pa.int32()), pa.array(x["doc_ids"], pa.int64()),
                    pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts.tolist())], pa.int64())],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = map_batches(shards.select("part", "shard", "doc_ids", "counts", "payload"), fn,
                        "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(shards.select("part", "shard", "n_ids")), ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
