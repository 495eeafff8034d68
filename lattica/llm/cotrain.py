"""Document quality by co-training of two views.

The *text view* sees only the content: shapes of characters, words and lines, repetition, and hashed words. The *metadata
view* sees only what is known about a document: its source, its language, its length. Each view has a logistic classifier.
Both start from labelled rows; in each round, each classifier labels the documents it is most sure of among those without
a label, and the other one learns from them. At the end each view is calibrated on labelled rows that it hasn't learned
from (Platt's sigmoid), and the calibrated log-odds are combined by a third sigmoid fitted on the same rows.

Fitting takes at most ``LABELLED`` labelled rows, chosen by a hash of the identifier, and all documents without a label:
their views are written once, and in each round a view labels at most the share ``TAKEN`` of them, the surest first. Which
ones follows from the rounds' weights and bounds, so executors find them again by these, and Newton's method adds up
gradients and Hessians of fixed size there. All unlabelled documents together weigh as much as ``POOL`` of them, or else they
would drown the labelled rows as the corpus grows. Every document is then scored whole.

Defined cases: a null text counts as empty, null metadata as a value of its own; labels that are null or without a
document are ignored, and of several labels of a document the largest counts; with labels of one class or none, every
score is that class's share (0.5 without labels); rows that repeat are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, map_batches, written

LABELLED, POOL, ROUNDS, TAKEN, KEEP_FROM = 4000, 4000, 5, 0.05, 0.5
#: Log-odds are counted in so many steps from -30 to 30 to find each round's bounds.
BINS = 6000
#: Tasks that add up the executors' sums, so that the driver gets so many at once whatever the corpus size.
ADDERS = 8
#: Up to so many labelled identifiers are broadcast; beyond that, views are shuffled, which are smaller than texts.
BROADCAST_ROWS = 500_000
HASHED = 256
_CLASS = np.full(256, 5, dtype=np.uint8)  # other letters (bytes of characters beyond ASCII)
for _chars, _k in ((range(65, 91), 0), (range(97, 123), 1), (range(48, 58), 2), ((9, 10, 11, 12, 13, 32), 3), ((*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)), 4)):
    _CLASS[list(_chars)] = _k
_MARKS = [ord(c) for c in ".,!?#$%&*|<>{}[]()\"'@_=-+/\\:;"]


def text_view(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    b = np.frombuffer(raw, dtype=np.uint8)
    n = max(1, len(b))
    byte = np.bincount(b, minlength=256)
    kind = np.array([byte[_CLASS == k].sum() for k in range(6)]) / n
    words = raw.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = raw.split(b"\n")
    hashed = np.zeros(HASHED)
    distinct = set(words)
    ended = sum(w[-1] in b".!?:,;" for w in words) / max(1, len(words))
    for w in distinct:
        hashed[zlib.crc32(w.lower()) % HASHED] += 1
    stats = [np.log1p(len(words)), sizes.mean() / 10, sizes.std() / 10, sizes.max() / 100, len(distinct) / max(1, len(words)),
             len(set(lines)) / len(lines), np.log1p(len(lines)), ended, len(zlib.compress(raw, 1)) / n if n > 64 else 1.0]
    return np.concatenate([kind, byte[_MARKS] / n * 10, stats, hashed / max(1.0, np.linalg.norm(hashed))]).astype(np.float32)


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(64 + 32 + 24, dtype=np.float32)
    out[zlib.crc32((source or "\0").encode()) % 64] = 1
    out[64 + zlib.crc32((lang or "\0").encode()) % 32] = 1
    out[96 + (min(22, int(np.log2(1 + max(0, n_chars)))) if n_chars is not None else 23)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights, the bias last, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The Hessian and, as its last row, the gradient of the log-likelihood."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([(x * (p * (1 - p) + 1e-6)[:, None]).T @ x, [x.T @ (y - p)]])


def _packed(sums: np.ndarray) -> np.ndarray:
    """A Hessian is symmetric, so half of it will do; the gradient follows. Counts are one row already."""
    return sums if sums.ndim == 1 else np.concatenate([sums[:-1][np.triu_indices(len(sums) - 1)], sums[-1]])


def _unpacked(flat: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    if len(shape) == 1:
        return flat
    half = np.zeros(shape)
    half[np.triu_indices(shape[1])] = flat[:-shape[1]]
    half[:-1] += np.triu(half[:-1], 1).T
    half[-1] = flat[-shape[1]:]
    return half


def _bin(odds: np.ndarray) -> np.ndarray:
    return np.clip(((odds + 30) * (BINS / 60)).astype(np.int64), 0, BINS - 1)


def _exchanged(views: list[np.ndarray], place: np.ndarray, rounds: list[list[tuple]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which documents are free after these rounds, and what each view has been taught of them (nan: nothing)."""
    free, taught = np.ones(len(place), bool), [np.full(len(place), np.nan) for _ in (0, 1)]
    for r, bounds in enumerate(rounds):
        taken = np.zeros(len(place), bool)
        for k, (w, top, top_share, bottom, bottom_share) in enumerate(bounds):
            odds, dice = _odds(views[k], w), place * 7919 * (2 * r + k + 1) % 1  # of equal odds, a share by hash
            at = _bin(odds)
            high = free & (odds > 2) & ((at > top) | (at == top) & (dice < top_share))  # labels of which the view is sure
            low = free & (odds < -2) & ((at < bottom) | (at == bottom) & (dice < bottom_share))
            taught[1 - k][high], taught[1 - k][low] = 1.0, 0.0
            taken |= high | low
        free &= ~taken
    return free, taught


def _counted(views: list[np.ndarray], place: np.ndarray, rounds: list, w: list[np.ndarray]) -> list[np.ndarray]:
    """How many free documents each view is sure of, by log-odds."""
    free, _ = _exchanged(views, place, rounds)
    odds = [_odds(v[free], x) for v, x in zip(views, w)]
    return [np.bincount(_bin(o[np.abs(o) > 2]), minlength=BINS).astype(float) for o in odds]


def _added(views: list[np.ndarray], place: np.ndarray, rounds: list, w: list[np.ndarray]) -> list[np.ndarray]:
    _, taught = _exchanged(views, place, rounds)
    return [_sums(v[~np.isnan(y)], y[~np.isnan(y)], x) for v, y, x in zip(views, taught, w)]


class Rows:
    """Unlabelled documents as arrays."""

    def __init__(self, views: list[np.ndarray]):
        self.views, self.n = views, len(views[0])
        self.place = (np.arange(self.n) + 0.5) / max(1, self.n)

    def sum(self, of, scaled, *args) -> list[np.ndarray]:
        return of(scaled(self.views), self.place, *args)


class Table:
    """Unlabelled documents as a table of place and views, which executors go through."""

    def __init__(self, rows: DataFrame):
        self.n = rows.count()
        # A task sends sums of fixed size in each of Newton's steps: as many tasks as there are cores, however many files there are.
        self.rows = rows.coalesce(max(ADDERS, rows.sparkSession.sparkContext.defaultParallelism))

    def sum(self, of, scaled, *args) -> list[np.ndarray]:
        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    views = [np.frombuffer(b"".join(batch.column(k).to_pylist()), t).reshape(batch.num_rows, -1) for k, t in ((1, np.float32), (2, np.uint8))]
                    part = of(scaled(views), batch.column(0).to_numpy(), *args)
                    total = part if total is None else [a + b for a, b in zip(total, part)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(t).tobytes()], pa.binary()) for t in total], names=["a", "b"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    part = [np.frombuffer(x) for x in row]
                    total = part if total is None else [a + b for a, b in zip(total, part)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in total], names=["a", "b"])

        parts = map_batches(map_batches(self.rows, fn, "a binary, b binary").repartition(ADDERS), add, "a binary, b binary").collect()
        shapes = [(BINS,)] * 2 if of is _counted else [(len(w) + 1, len(w)) for w in args[1]]
        return [sum((_unpacked(np.frombuffer(r[k]), s) for r in parts), np.zeros(s)) for k, s in enumerate(shapes)]


class Model:
    """Two views' classifiers, exchanged labels and all; how they are calibrated and combined."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray] | Table | None):
        self.constant = float(y.mean()) if len(y) and y.min() == y.max() else None if len(y) else 0.5
        if self.constant is not None:
            return
        self.mean = mean = [v.mean(axis=0) for v in views]
        self.scale = scale = [np.maximum(v.std(axis=0), 0.02) for v in views]
        scaled = lambda x: [(v - m) / s for v, m, s in zip(x, mean, scale)]
        views = scaled(views)
        if isinstance(pool, list):
            pool = Rows(pool)
        fold = np.arange(len(y)) % 3 == 0  # for calibration
        if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
            fold = np.ones(len(y), bool)
        train = ~fold if not fold.all() else fold
        self.w = [logistic(views[k][train], y[train]) for k in (0, 1)]
        share, rounds = y[train].mean(), []
        for _ in range(ROUNDS if pool.n else 0):
            counts = pool.sum(_counted, scaled, rounds, self.w)
            rounds.append([(self.w[k], *_bound(counts[k], TAKEN * share * pool.n, True), *_bound(counts[k], TAKEN * (1 - share) * pool.n, False)) for k in (0, 1)])
            if not sum(c.sum() for c in counts):
                break
            self.w = _taught(self.w, [v[train] for v in views], y[train], lambda w: [min(1.0, POOL / pool.n) * x for x in pool.sum(_added, scaled, rounds, w)])
        odds = [_odds(views[k][fold], self.w[k]) for k in (0, 1)]
        self.platt = [logistic(o[:, None], y[fold], 0.01) for o in odds]
        both = np.stack([_odds(o[:, None], p) for o, p in zip(odds, self.platt)], axis=1)
        self.joint = logistic(both, y[fold], 0.01)

    def score(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """The probabilities of the text view, the metadata view and both."""
        if self.constant is not None:
            return [np.full(len(views[0]), self.constant)] * 3
        odds = [_odds(_odds((v - m) / s, w)[:, None], p) for v, m, s, w, p in zip(views, self.mean, self.scale, self.w, self.platt)]
        return [1 / (1 + np.exp(-o)) for o in (*odds, _odds(np.stack(odds, axis=1), self.joint))]


def _bound(counts: np.ndarray, quota: float, top: bool) -> tuple[int, float]:
    """The step down to which the surest documents fill the quota, and the share of that step's documents to take."""
    half = BINS // 2
    side = counts[half:][::-1] if top else counts[:half]
    upto = np.cumsum(side)
    at = int(np.searchsorted(upto, quota))
    if at >= half:
        return (half, 1.0) if top else (half - 1, 1.0)
    return (BINS - 1 - at if top else at), float((quota - upto[at] + side[at]) / max(1.0, side[at]))


def _taught(w: list[np.ndarray], xs: list[np.ndarray], y: np.ndarray, added, ridge: float = 1.0, steps: int = 12) -> list[np.ndarray]:
    """Both views' weights by Newton's method, from labelled rows here and the sums of what they have been taught elsewhere."""
    w = [np.zeros_like(x) for x in w]  # from the last round's weights, where all are sure, steps would be far too long
    for _ in range(steps):
        largest = 0.0
        for k, sums in enumerate(added(w)):
            sums = sums + _sums(xs[k], y, w[k])
            penalty = np.full(len(w[k]), ridge)
            penalty[-1] = 1e-6
            step = np.linalg.solve(sums[:-1] + np.diag(penalty), sums[-1] - penalty * w[k])
            w[k] += step
            largest = max(largest, np.abs(step).max())
        if largest < 1e-6:
            break
    return w


def _views(columns: list[list]) -> list[np.ndarray]:
    text, source, lang, n_chars = columns
    return [np.stack([text_view(t) for t in text]), np.stack([metadata_view(*m) for m in zip(source, lang, n_chars)])]


_INPUTS = ("text", "source", "lang", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """Fit on a bounded sample of labelled rows and on all others; views are made, and others gone through, on the executors."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("double").alias("y"))
    part = min(1.0, 1.3 * LABELLED / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("cotrain")), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.select("doc_id", *_INPUTS).withColumn("place", place)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta = _views([c.to_pylist() for c in batch.columns[3:]])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v.tobytes() for v in text], pa.binary()), pa.array([v.astype(np.uint8).tobytes() for v in meta], pa.binary())],
                                                 names=["doc_id", "place", "y", "a", "b"])

    def viewed(chosen: DataFrame) -> DataFrame:
        return map_batches(chosen.select("doc_id", "place", "y", *_INPUTS), fn, "doc_id long, place double, y double, a binary, b binary")

    labelled = rows.where(F.col("place") < part).join(known, "doc_id")
    seen = sorted(map(tuple, viewed(labelled).drop("doc_id").collect()), key=lambda r: (r[0], r[2], r[3]))[:LABELLED]
    views = [np.stack([np.frombuffer(r[k], t) for r in seen]).astype(np.float32) if seen else None for k, t in ((2, np.float32), (3, np.uint8))]
    y = np.array([float(r[1] > 0) for r in seen])
    if len(set(y)) < 2:
        return Model(views, y, None)
    ids = written(known.select("doc_id"), "labelled")
    rows = rows.withColumn("y", F.lit(None).cast("double"))
    if ids.count() <= BROADCAST_ROWS:
        others = viewed(rows.join(F.broadcast(ids), "doc_id", "left_anti"))
    else:
        others = viewed(rows).join(ids, "doc_id", "left_anti")
    table = written(others.select("place", "a", "b"), "views")
    model = Model(views, y, Table(table))
    discard(table)
    discard(ids)
    return model


def score(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, text_score, meta_score, score (that the quality is good) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = shared.value.score(_views([c.to_pylist() for c in batch.columns[1:]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores), pa.array(scores[2] >= keep_from)],
                                                 names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return map_batches(docs.select("doc_id", *_INPUTS), fn, "doc_id long, text_score double, meta_score double, score double, kept boolean")
