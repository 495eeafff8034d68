"""Near-duplicate components by a MinHash LSH forest, every link confirmed on whole shingle sets.

Words are runs of other than ASCII white space, with A-Z lower-cased. A document's set holds its distinct shingles of
``words`` words; a shorter text's whole sequence is its one shingle; a text without words has an empty set and is linked
with nothing. Documents are linked where 100 * intersection >= 100 * threshold * union, and components are what links
connect.

* **Nodes.** Documents with equal sets (by a 128-bit hash) are one node; a third of all rows may share one.
* **Forest.** A node has ``HASHES`` MinHash values. Each of ``TREES`` orders sorts all nodes by its own sequence of values.
  A region is what agrees in the first ``DEPTH`` values. In a region of up to ``ALL`` nodes all pairs are candidates, in a
  larger one each node with its neighbours in the order, those with the longest common prefix; a crowded region is cut by
  more values, the more the larger it is, and dealt out in parts, so no task gets it whole.
* **Confirmation.** Candidates whose 128-bit sketches speak against the threshold by more than 6 standard deviations are
  left out; the others are confirmed on the whole texts, unless both nodes are connected already: first the best
  candidate of each node, then the best between different components, at last all between different components.
* **Clouds.** What large regions connect is a cloud. Neighbours leave links out there, so each cloud that isn't one
  component yet is settled exactly, without comparing all its pairs. See ``_settled``.

Links go through tables in the shared store; nothing but counts reaches the driver. Tables that grow with the corpus are
broadcast, or joined to components in one task, only up to a checked size. Defined cases: null and empty texts
have an empty set and are components of their own; a row with a null doc_id has a null component_id, is kept and links
nothing; rows that repeat are decided alike; extra columns are ignored by ``decisions`` and carried by ``kept_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import broadcast_if_small, discard, map_batches, on_leaving, written

HASHES, TREES, DEPTH, ALL, NEAR = 128, 32, 4, 9, 1
#: A region of more nodes than this is cut one value deeper, and again at each eightfold, and dealt out in parts of this size.
CROWDED = 512
#: Candidate nodes are broadcast to the scan for their texts up to so many (8 bytes each); beyond, that join shuffles.
BROADCAST_ROWS = 500_000
#: Links are joined to components in one task up to so many (16 bytes each); beyond, in tables.
LOCAL_EDGES = 500_000
#: Shingles of clouds' middles are broadcast up to so many (8 bytes each); beyond, that join shuffles.
BROADCAST_SHINGLES = 2_000_000
#: In a cloud, nodes that share a shingle are compared if at most so many have it; more of them are a cloud of their own.
HOT = 64
#: Bytes of the table of how often shingles stand in a cloud: at most, and for each shingle of several nodes.
SHARED_BYTES, SHARED_EACH = 1 << 27, 16
#: Bytes of it that a task sends at once.
BLOCK = 1 << 16
#: Clouds are cut into clouds so many times; then shingles are compared however many nodes have them.
LEVELS = 5
#: Distinct words that a worker keeps.
WORDS = 400_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
#: The order of each tree: DEPTH values of its own, then DEPTH of others'.
_ORDER = np.stack([np.concatenate([np.arange(DEPTH * t, DEPTH * t + DEPTH),
                                   _rng.permutation(np.delete(np.arange(HASHES), np.s_[DEPTH * t:DEPTH * t + DEPTH]))[:DEPTH]])
                   for t in range(TREES)])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_words = _Words()
on_leaving(_words.clear)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    tokens = (text or "").encode().lower().split()  # bytes: white space and letters are ASCII's
    h = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(len(h) - words + 1, min(1, len(h)))
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k:k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, (x[None, at:at + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return out


def set_name(found: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """128 bits that name a set."""
    if not len(found):
        return None, None
    both = xxhash.xxh3_128_intdigest(found.tobytes())
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, h1 and h2 (the set's name; null for an empty set), n_shingles, signature."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            names = [set_name(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *[pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "text_key", "h1", "h2", "n_shingles", "signature"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text"), fn,
                       "doc_id long, text_key long, h1 long, h2 long, n_shingles long, signature binary")


def _nodes(signed: DataFrame) -> DataFrame:
    """node, h1, h2, first (doc_id, text_key), signature of each distinct set. A node is called h1; sets that agree in h1 alone are called by both."""
    sets = signed.where("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("signature").alias("signature")).withColumn("node", F.col("h1"))
    sets = written(sets, "nodes")
    twice = written(sets.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h1").alias("twice")), "twice")
    if twice.isEmpty():
        return sets
    named = sets.drop("node").join(broadcast_if_small(twice, BROADCAST_ROWS), F.col("h1") == F.col("twice"), "left")
    return written(named.withColumn("node", F.when(F.col("twice").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "h2"))).drop("twice"), "nodes")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _planted(nodes: DataFrame) -> DataFrame:
    """TREES rows for each node: the keys of depth 4, 5, 6 and 8, what follows in the order, and the sketch."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(node), HASHES)
            bits = np.packbits((sig >> np.uint32(7)).astype(np.uint8) & 1, axis=1).view(">u8").astype(np.uint64).view(np.int64)
            value = sig[:, _ORDER].astype(np.uint64)  # nodes, trees, depths
            key = np.broadcast_to(np.arange(TREES, dtype=np.uint64) + np.uint64(1), value.shape[:2])
            keys = {}
            for d in range(2 * DEPTH):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ value[:, :, d])
                keys[d + 1] = key
            after = np.zeros(value.shape[:2], np.uint64)
            for d in range(DEPTH, 2 * DEPTH):
                after = (after << np.uint64(16)) | (value[:, :, d] >> np.uint64(16))
            flat = lambda x: pa.array(x.reshape(-1).view(np.int64))
            wide = lambda x: pa.array(np.repeat(x, TREES))
            yield pa.RecordBatch.from_arrays(
                [*[flat(keys[d]) for d in (4, 5, 6, 8)], flat(after), wide(node), wide(bits[:, 0]), wide(bits[:, 1])],
                names=["k4", "k5", "k6", "k8", "after", "node", "s1", "s2"])

    return map_batches(nodes.select("node", "signature"), fn,
                       "k4 long, k5 long, k6 long, k8 long, after long, node long, s1 long, s2 long")


def most_apart(threshold: float) -> int:
    """The most bits in which two sketches may differ: 6 standard deviations over what the threshold expects."""
    p = (1 - threshold) / 2
    return int(HASHES * p + 6 * np.sqrt(HASHES * p * (1 - p)))


def _walk(apart: int):
    """Candidates (a, b, apart) and what large regions connect (apart null) of sorted rows, with bounded memory."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5), np.int64)  # the last rows: region, node, sketch, hub of a crowded region
        began, first_row = 0, None  # rank of the first held row in its region; first row of its region
        for batch in batches:
            new = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if not len(new):
                continue
            rows = np.concatenate([held, new])
            fresh = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
            rank = np.arange(len(rows)) - first + np.where(first == 0, began, 0)
            firsts = rows[first]
            if first_row is not None:
                firsts[first == 0] = first_row
            out = []
            now = np.arange(len(held), len(rows))
            for lag in range(1, ALL):
                i = now[(rank[now] >= lag) & ((rank[now] < ALL) | (lag <= NEAR))]
                out.append((rows[i], rows[i - lag]))
            x, y = (np.concatenate([o[k] for o in out]) for k in (0, 1))
            off = np.bitwise_count((x[:, 2:4] ^ y[:, 2:4]).view(np.uint64)).sum(axis=1, dtype=np.int32)
            good = (off <= apart) & (x[:, 1] != y[:, 1])
            a, b, off = np.minimum(x[good, 1], y[good, 1]), np.maximum(x[good, 1], y[good, 1]), off[good]
            full = now[rank[now] == ALL]
            large = np.concatenate([now[rank[now] >= ALL], *[full - k for k in range(1, ALL + 1)]])
            large = large[rows[large, 1] == rows[large, 4]]  # a crowded region's nodes have a hub
            crowd = now[rows[now, 1] != rows[now, 4]]
            m = np.concatenate([rows[large, 1], rows[crowd, 1]])
            hub = np.concatenate([firsts[large, 1], rows[crowd, 4]])
            m, hub = m[m != hub], hub[m != hub]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([a, m])), pa.array(np.concatenate([b, hub])),
                pa.concat_arrays([pa.array(off), pa.nulls(len(m), pa.int32())])], names=["a", "b", "apart"])
            keep = max(0, len(rows) - ALL)
            began, first_row, held = int(rank[keep]), firsts[keep].copy(), rows[keep:]

    return fn


def _forest(nodes: DataFrame, threshold: float) -> DataFrame:
    rows = _planted(nodes)
    crowd = rows.groupBy("k4").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where(F.col("size") > CROWDED)
    crowd = broadcast_if_small(written(crowd.withColumnRenamed("k4", "crowd"), "crowd"), BROADCAST_ROWS)
    deeper = rows.join(crowd, F.col("k4") == F.col("crowd"), "left")
    size = F.col("size")
    cut = F.when(size <= 8 * CROWDED, F.col("k5")).when(size <= 64 * CROWDED, F.col("k6")).otherwise(F.col("k8"))
    part = F.when(size.isNull(), F.col("k4")).otherwise(F.xxhash64(cut, F.pmod(F.col("node"), F.ceil(size / CROWDED))))
    walked = (deeper.select(part.alias("part"), "after", "node", "s1", "s2", F.coalesce("hub", "node").alias("hub"))
              .repartition("part").sortWithinPartitions("part", "after", "node").select("part", "node", "s1", "s2", "hub"))
    return written(map_batches(walked, _walk(most_apart(threshold)), "a long, b long, apart int"), "walk")


def components(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """node, label (the least node of its component) of the nodes that edges (a, b) name, but for those least nodes.

    Up to ``local_edges`` edges are joined in one task; beyond, large and small stars go on in tables until nothing changes."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "stars")
    limit = LOCAL_EDGES if local_edges is None else local_edges
    if now.limit(limit + 1).count() <= limit:
        return map_batches(now.coalesce(1), _united, "node long, label long")
    last, before = None, now
    now = now.distinct()
    while True:
        now = written(now, "stars")
        discard(before)
        before = now
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        last = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = small.select("e.*").where("u <> v").distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (over := up.get(x, x)) != x:
            up[x] = x = up.get(over, over)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(u), root(v)
            up.setdefault(u, u)
            up.setdefault(v, v)
            if x != y:
                up[max(x, y)] = min(x, y)
    found = [(x, r) for x in up if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["node", "label"])


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold."""
    percent = round(100 * threshold)
    x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, one = None, None
        for batch in batches:
            hit = []
            for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != own:
                    own, one = a, shingles(s, words)
                other = shingles(t, words)
                both = len(np.intersect1d(one, other, assume_unique=True))
                hit.append(100 * both >= percent * (len(one) + len(other) - both))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return map_batches(pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y"), fn, "a long, b long")


def _best(pairs: DataFrame) -> DataFrame:
    """Of each node's candidates, the one whose sketch is nearest."""
    both = pairs.select("a", "b", "apart").union(pairs.select("b", "a", "apart"))
    best = both.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Joined:
    """Labels of nodes, as links come in. A node without a label is its own."""

    def __init__(self, spark):
        self.labels = written(spark.createDataFrame([], "node long, label long"), "labels")

    def add(self, links: DataFrame) -> None:
        """links: a written table (a, b), which goes. Labels stand for all links before."""
        if not links.isEmpty():
            every = self.labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links.select("a", "b"))
            old, self.labels = self.labels, written(components(every), "labels")
            discard(old)
        discard(links)

    def of(self, rows: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
        """rows with the label of a node column."""
        own = broadcast_if_small(self.labels, BROADCAST_ROWS).select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        out = rows.join(own, F.col(node) == F.col("_n"), "left").withColumn(label, F.coalesce("_l", node))
        return out.drop("_n", "_l")


def _linked(docs: DataFrame, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and h1, h2, first (doc_id, text_key) of its component, of each node."""
    signed = written(_signed(docs, words), "signed")
    nodes = _nodes(signed)
    walk = _forest(nodes, threshold)
    cand = written(walk.where("apart is not null").groupBy("a", "b").agg(F.min("apart").alias("apart")), "candidates")
    found = written(components(walk.where("apart is null").select("a", "b").distinct()), "clouds")
    discard(walk)
    cloud = found.select("node", F.col("label").alias("cloud"))
    cloud = written(cloud.union(cloud.select("cloud", "cloud").distinct()), "clouds")
    discard(found)
    joined = _Joined(docs.sparkSession)
    if not cand.isEmpty() or not cloud.isEmpty():
        named = cand.select(F.col("a").alias("node")).union(cand.select("b")).union(cloud.select("node")).distinct()
        firsts = nodes.join(named, "node").select("node", F.col("first.doc_id").alias("want"), F.col("first.text_key").alias("want_key"))
        firsts = written(firsts, "firsts")
        found = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text").join(
            broadcast_if_small(firsts, BROADCAST_ROWS), (F.col("id") == F.col("want")) & (F.col("key") == F.col("want_key")))
        texts = written(found.dropDuplicates(["node"]).select("node", "text"), "texts")
        _tried(cand, cloud, texts, joined, words, threshold)
        _settled(cloud, texts, joined, words, threshold)
        discard(texts)
    discard(cand)
    label = written(joined.of(nodes.select("node", "h1", "h2", "first")), "named")
    discard(nodes)
    first = written(label.groupBy("label").agg(F.min("first").alias("first")), "first")  # by itself, so that a join with a large component can be split
    out = written(label.select("h1", "h2", "label").join(first, "label").select("h1", "h2", "first"), "firsts")
    for table in (label, first, cloud):
        discard(table)
    return signed, out


def _tried(cand: DataFrame, cloud: DataFrame, texts: DataFrame, joined: _Joined, words: int, threshold: float) -> None:
    """Confirm candidates: the best of each node, twice; then all that still lie between components, but for pairs of one cloud."""
    left = cand
    for turn in range(4):
        few = left.limit(2001).count() <= 2000
        pick = written(left.select("a", "b") if few or turn == 3 else _best(left), "pick")
        links = written(_confirmed(pick, texts, words, threshold), "links")
        joined.add(links)
        if few or turn == 3:
            return
        open_pairs = left
        if turn == 0:
            for end in ("a", "b"):
                own = broadcast_if_small(cloud, BROADCAST_ROWS).select(F.col("node").alias(f"n{end}"), F.col("cloud").alias(f"c{end}"))
                open_pairs = open_pairs.join(own, F.col(end) == F.col(f"n{end}"), "left")
            open_pairs = open_pairs.where("ca is null or cb is null or ca <> cb").select("a", "b", "apart")
        open_pairs = joined.of(joined.of(open_pairs, "a", "la"), "b", "lb").where("la <> lb")
        before, left = left, written(open_pairs.join(pick, ["a", "b"], "left_anti").select("a", "b", "apart"), "left")
        if turn:
            discard(before)
        discard(pick)


def _settled(cloud: DataFrame, texts: DataFrame, joined: _Joined, words: int, threshold: float) -> None:
    """Find all links between different components of one cloud (node, cloud).

    A cloud's *middle* is the set of shingles that more than half of its nodes have. A node x differs from the middle by
    the shingles D(x) that it adds or lacks, and the sets of x and y differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles.
    With p the threshold in percent and e(x) = (100 + p) |D(x)| - (100 - p) |x|, x and y are linked exactly if
    e(x) + e(y) <= 2 (100 + p) |D(x) & D(y)|.

    * The node of the least e is the cloud's hub. Every y with e(y) + e(hub) <= 0 is linked with it, whatever they share.
    * Any other y can't be linked with an x that differs from the middle in other shingles than y. So the two share

      - a shingle that both add and that is among the rarest of each (a prefix filter: of n shingles, p percent have to be
        shared, so a shared one is among the rarest n - p n / 100 + 1, in one order for all; only those of them that other
        nodes may have become rows), or
      - no shingle that both add: then they share no more than what the smaller one has of the middle, which has to do, and
        both lack a shingle. Few nodes pass that; the shingles that they lack are joined by a prefix filter as well.

      Pairs that share such a shingle are compared by what they add and lack.
    * A shingle that more than ``HOT`` nodes add is the mark of a group with a middle of its own. Nodes that such shingles
      connect are a cloud on the next level."""
    p = round(100 * threshold)
    for level in range(LEVELS):
        rows = joined.of(cloud)
        mixed = rows.groupBy("cloud").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2")
        mixed = written(mixed.select("cloud", "m"), "mixed")
        if mixed.isEmpty():
            return
        small = broadcast_if_small(mixed, BROADCAST_ROWS)
        members = written(cloud.join(small, "cloud").join(texts, "node").select("cloud", "node", "text"), "members")
        counts = written(_counted(members, words).groupBy("cloud", "g").agg(F.sum("n").alias("n")), "counts")
        middle = counts.join(small, "cloud").where("2 * n > m").groupBy("cloud").agg(F.collect_list("g").alias("middle"))
        middle = written(middle, "middle")
        size = middle.agg(F.sum(F.size("middle"))).first()[0] or 0
        rows = members.join(F.broadcast(middle) if size <= BROADCAST_SHINGLES else middle, "cloud", "left")
        apart = written(_compared(rows, words, p), "apart")
        hubs = written(apart.groupBy("cloud").agg(F.min(F.struct("e", "node")).alias("hub")), "hubs")
        central = broadcast_if_small(hubs, BROADCAST_ROWS)
        star = apart.join(central, "cloud").where("e + hub.e <= 0 and node <> hub.node")
        joined.add(written(star.select(F.col("node").alias("a"), F.col("hub.node").alias("b")), "links"))
        known = joined.of(joined.of(apart.join(central, "cloud").withColumn("_h", F.col("hub.node"))), "_h", "main")
        known = known.withColumn("far", F.expr("e + hub.e > 0 and label <> main"))
        settled = written(known.select("cloud", "node", "label", "far", "size", "e", "own", F.size("added").alias("n_added"),
                                       F.size("lacked").alias("n_lacked"), "middle_size", "added", "lacked"), "known")
        open_clouds = settled.groupBy("cloud").agg(F.max("far").alias("open")).where("open").select("cloud")
        open_clouds = written(open_clouds, "open")
        if open_clouds.isEmpty():
            return
        known = settled.join(broadcast_if_small(open_clouds, BROADCAST_ROWS), "cloud")
        pairs, hot = _sharing(known, counts, p, level == LEVELS - 1)
        pairs = written(pairs.union(_lacking(known, p)).distinct(), "pairs")
        side = lambda s: known.select(F.col("node").alias(s), F.col("e").alias(f"e{s}"), F.col("added").alias(f"added_{s}"),
                                      F.col("lacked").alias(f"lacked_{s}"), F.col("cloud"))
        shared = F.size(F.array_intersect("added_a", "added_b")) + F.size(F.array_intersect("lacked_a", "lacked_b"))
        met = pairs.join(side("a"), ["cloud", "a"]).join(side("b"), ["cloud", "b"]).where(F.col("ea") + F.col("eb") <= 2 * (100 + p) * shared)
        joined.add(written(met.select("a", "b"), "links"))
        if level == LEVELS - 1:
            return
        found = written(components(hot), "clouds")
        again = found.select("node", F.col("label").alias("cloud"))
        cloud = written(again.union(again.select("cloud", "cloud").distinct()), "clouds")
        for table in (mixed, counts, middle, apart, pairs, members, hubs, settled, open_clouds, found):
            discard(table)
        if cloud.isEmpty():
            return


def _counted(rows: DataFrame, words: int) -> DataFrame:
    """cloud, shingle g and the number of nodes that have it, added up within each batch."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for cloud, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(cloud, []).append(shingles(text, words))
            for cloud, sets in by.items():
                g, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), cloud, np.int64)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["cloud", "g", "n"])

    return map_batches(rows.select("cloud", "text"), fn, "cloud long, g long, n long")


def _compared(rows: DataFrame, words: int, p: int) -> DataFrame:
    """What each node adds to its cloud's middle, what it lacks of it (both ascending), what it has (own), and e."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, middle in zip(batch.column(2).to_pylist(), batch.column(3)):
                found = shingles(text, words).view(np.int64)
                middle = np.asarray(middle.values) if middle.is_valid else np.empty(0, np.int64)
                added, lacked = np.setdiff1d(found, middle, True), np.setdiff1d(middle, found, True)
                e = (100 + p) * (len(added) + len(lacked)) - (100 - p) * len(found)
                out.append((len(found), e, len(found) - len(added), len(middle), np.sort(added), np.sort(lacked)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([x[k] for x in out], pa.int64()) for k in range(4)],
                 *[pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (4, 5)]],
                names=["cloud", "node", "size", "e", "own", "middle_size", "added", "lacked"])

    return map_batches(rows.select("cloud", "node", "text", "middle"), fn,
                       "cloud long, node long, size long, e long, own long, middle_size long, added array<long>, lacked array<long>")


def _met(rows: DataFrame, which) -> DataFrame:
    """Pairs (cloud, a < b) of rows that share a shingle g, one of them far, of different components, where ``which`` of both holds."""
    one, two = rows.where("far").alias("x"), rows.alias("y")
    once = F.expr("not y.far or x.node < y.node")
    pairs = one.join(two, (F.col("x.cloud") == F.col("y.cloud")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.label") != F.col("y.label")) & once & which)
    return pairs.select("x.cloud", F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _place(cloud: np.ndarray | np.uint64, g: np.ndarray, size: int) -> np.ndarray:
    """The byte of a table of ``size`` bytes, a power of two, that stands for a shingle of a cloud."""
    return (_mixed((g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ cloud) & np.uint64(size - 1)).view(np.int64)


def _often(counts: DataFrame) -> bytes:
    """A table of bytes by ``_place``: at least the number of nodes that have a shingle, up to 255; 1 if none of its shingles has two. Tasks send
    the blocks that they set bytes in; the driver holds the table and one block."""
    several = counts.where("n > 1")
    size = min(SHARED_BYTES, 1 << max(16, (SHARED_EACH * several.count() - 1).bit_length()))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ones(size, np.uint8)
        for batch in batches:
            cloud, g, n = (c.to_numpy() for c in batch.columns)
            np.maximum.at(table, _place(cloud.view(np.uint64), g, size), np.minimum(n, 255).astype(np.uint8))
        for at in range(0, size, BLOCK):
            if (table[at:at + BLOCK] > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([table[at:at + BLOCK].tobytes()], pa.binary())], names=["at", "block"])

    table = np.ones(size, np.uint8)
    for r in map_batches(several.select("cloud", "g", "n").coalesce(8), fn, "at long, block binary").toLocalIterator():
        part = table[r["at"]:r["at"] + BLOCK]
        np.maximum(part, np.frombuffer(r["block"], np.uint8), out=part)
    return table.tobytes()


def _rarest(rows: DataFrame, often, p: int) -> DataFrame:
    """rows with ``rarest`` in place of ``added``: of a node's rarest added shingles, by the broadcast table ``often``, those that other nodes may have.

    A prefix filter takes any order that is the same for all nodes of a cloud; shingles that are surely no other node's come first in it."""
    rest = [f for f in rows.schema if f.name != "added"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", rarest array<long>"
    rows = rows.select(*[f.name for f in rest], "added")
    at = {f.name: k for k, f in enumerate(rest)}

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(often.value, np.uint8)
        for batch in batches:
            out = []
            for cloud, size, added in zip(batch.column(at["cloud"]).to_numpy(), batch.column(at["size"]).to_pylist(), batch.column(len(rest))):
                g = np.asarray(added.values)
                n = table[_place(cloud.view(np.uint64), g, len(table))]
                first = np.lexsort((g, n))[:size - -(-size * p // 100) + 1]
                out.append(g[first[n[first] > 1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int64()))], names=[*at, "rarest"])

    return map_batches(rows, fn, schema)


def _sharing(known: DataFrame, counts: DataFrame, p: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs that share one of their rarest shingles that isn't the middle's; and what shingles of many nodes connect (a, b)."""
    spark = known.sparkSession
    often = spark.sparkContext.broadcast(_often(counts))  # SHARED_BYTES at most
    each = known.select("cloud", "node", "label", "far", "size", "own", "n_added", "added")
    each = _rarest(each, often, p).select("cloud", "node", "label", "far", "size", "own", "n_added", F.explode("rarest").alias("g"))
    # a byte of the table may stand for several shingles, so what one node alone has goes here
    rare = each.join(counts, ["cloud", "g"]).where("n > 1")
    rare = written(rare.select("cloud", "g", "n", "node", "label", "far", "size", "own", "n_added"), "rare")
    often.unpersist()
    most = F.least("x.own", "y.own") + F.least("x.n_added", "y.n_added")
    which = (100 + p) * most >= p * (F.col("x.size") + F.col("y.size"))
    if last:
        return _met(rare, which), spark.createDataFrame([], "a long, b long")
    hot_one = F.col("n") > HOT
    marks = rare.where(hot_one).groupBy("cloud", "g").agg(F.min("node").alias("b"), F.max("far").alias("open")).where("open")
    hot = rare.where(hot_one).join(marks.select("cloud", "g", "b"), ["cloud", "g"]).select(F.col("node").alias("a"), "b").distinct()
    return _met(rare.where(~hot_one), which), hot


def _lacking(known: DataFrame, p: int) -> DataFrame:
    """Pairs that may be linked without a shingle that both add: what the smaller one has of the middle has to do."""
    size = known.groupBy("cloud").agg(F.min("size").alias("least"))
    some = known.join(broadcast_if_small(written(size, "sizes"), BROADCAST_ROWS), "cloud").where((100 + p) * F.col("own") >= p * (F.col("size") + F.col("least")))
    # of the middle, x and y both lack at least need(x) + need(y) - |middle| shingles
    some = some.withColumn("need", F.ceil(F.col("size") * p / (100 + p)) - 1 + F.col("n_lacked"))
    some = written(some.select("cloud", "node", "label", "far", "size", "own", "n_lacked", "middle_size", "need", "lacked"), "some")
    need = some.groupBy("cloud").agg(F.min("need").alias("any"), F.min(F.when(F.col("far"), F.col("need"))).alias("far_need")).where("far_need is not null")
    some = some.join(broadcast_if_small(written(need, "need"), BROADCAST_ROWS), "cloud")
    other = F.when(F.col("far"), F.col("any")).otherwise(F.col("far_need"))
    prefix = (F.col("n_lacked") - F.greatest(F.lit(1), F.col("need") + other - F.col("middle_size")) + 1).cast("int")
    each = some.where(prefix > 0).select("cloud", "node", "label", "far", "size", "own", F.explode(F.slice("lacked", F.lit(1), prefix)).alias("g"))
    which = (100 + p) * F.least("x.own", "y.own") >= p * (F.col("x.size") + F.col("y.size"))
    return _met(each, which)


def decisions(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    signed, firsts = _linked(docs, words, threshold)
    # the names of nodes without an id or a set are their own: they join with nothing
    rows = signed.select("doc_id", "h1", "h2", "n_shingles").join(firsts.select("h1", "h2", F.col("first.doc_id").alias("least")), ["h1", "h2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def kept_rows(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The first document of each component, with all its columns."""
    signed, firsts = _linked(docs, words, threshold)
    gone = signed.select("doc_id", "text_key", "h1", "h2").where("doc_id is not null").join(firsts, ["h1", "h2"]).where(
        "doc_id <> first.doc_id or text_key <> first.text_key").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key"))
    gone = broadcast_if_small(written(gone.distinct(), "gone"), BROADCAST_ROWS)
    out = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_gone")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
