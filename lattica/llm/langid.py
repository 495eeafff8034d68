"""Language identification by hierarchical discrimination.

A family is predicted first, by one-against-the-rest linear support vector machines; within the family, one-against-one
linear support vector machines tell its languages apart. Features are frequencies of byte 1- to 3-grams of the lower-cased
text, with everything but letters taken as space, hashed to ``BUCKETS`` and scaled to unit length.

The model is fitted on at most ``PER_LANGUAGE`` labelled rows of each language, chosen by a hash of the identifier; every
text is then scored whole. Languages that ``FAMILIES`` doesn't list are families of their own.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a label or with a null text
aren't learned from; with nothing to learn from, every row is ``und``; with one language, every text with a letter is of
that language; extra columns are carried by ``predict``, but for lang_pred and score, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches

#: Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg sr hr bs sl mk pl cs sk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "hellenic": "el",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi bn ur mr ne pa gu si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
    "sinitic": "zh yue",
    "japonic": "ja",
    "koreanic": "ko",
    "tai": "th lo",
    "austroasiatic": "vi km",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BUCKETS, PER_LANGUAGE, COST, SLOPE = 4096, 300, 10.0, 6.0
#: Bytes of text that are counted at once (about 40 bytes of memory for each).
GROUP = 1 << 20
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters become spaces; bytes of other characters stay.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _counted(raw: list[bytes]) -> np.ndarray:
    """The n-gram counts of some texts, one row each. What begins between two texts goes into a row of its own."""
    joined = np.frombuffer(b"\0\0".join(raw) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    row = np.stack([np.arange(len(raw)), np.full(len(raw), len(raw))], axis=1).ravel()
    doc = np.repeat(row, [n for r in raw for n in (len(r), 2)])[:-2] * BUCKETS
    one, two = joined[:-2], joined[:-2] * np.uint32(257) + joined[1:-1]
    three = two * np.uint32(263) + joined[2:]
    out = np.zeros((len(raw) + 1) * BUCKETS, np.int64)
    for salt, gram in ((0, one), (1, two), (2, three)):
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(salt * 40503)
        out += np.bincount(doc + (mixed >> np.uint32(20)), minlength=len(out))
    return out.reshape(len(raw) + 1, BUCKETS)[:-1]


def features(texts: list[str]) -> np.ndarray:
    """One row of unit length for each text. Texts are counted in groups of at most ``GROUP`` bytes, longer ones in parts."""
    raw = [text.lower().encode().translate(PLAIN) for text in texts]
    out, at = np.zeros((len(raw), BUCKETS), np.float32), 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= GROUP):
            size += len(raw[end])
            end += 1
        if size <= GROUP:
            out[at:end] = _counted(raw[at:end])
        else:  # one long text; a part has the two bytes after it, as the whole has at its end, and what these count for goes
            for k in range(0, size, GROUP):
                part = raw[at][k:k + GROUP + 2]
                out[at] += _counted([part])[0] - (_counted([part[GROUP:]])[0] if k + GROUP < size and len(part) > GROUP else 0)
        at = end
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = 12) -> np.ndarray:
    """Weights, the bias last, of a squared-hinge SVM, by dual coordinate descent that keeps the weights. y: 1 or -1."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    size = (x * x).sum(axis=1)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            ridge = 1 / (2 * cost * weight[i])
            step = max(-alpha[i], -(y[i] * (x[i] @ w) - 1 + ridge * alpha[i]) / (size[i] + ridge))
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w.astype(np.float32)


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.families: dict[str, list[str]] = {}
        for code in sorted(set(lang)):
            self.families.setdefault(FAMILY_OF.get(code, f"own:{code}"), []).append(code)
        family = np.array([FAMILY_OF.get(code, f"own:{code}") for code in lang])
        self.top = [linear_svm(x, np.where(family == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for codes in self.families.values():
            for a, b in combinations(codes, 2):
                both = (lang == a) | (lang == b)
                self.pairs[a, b] = linear_svm(x[both], np.where(lang[both] == a, 1, -1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.families else []
        for at in range(0, len(rows), 128):
            some = rows[at:at + 128]
            x = features([texts[i] for i in some])
            names = list(self.families)
            top = np.ones((len(some), 1))
            if self.top:
                w = np.stack(self.top)
                top = np.exp(SLOPE * (x @ w[:, :-1].T + w[:, -1]))
                top /= top.sum(axis=1, keepdims=True)
            best = top.argmax(axis=1)
            for f in set(best.tolist()):
                at_f, codes = np.flatnonzero(best == f), self.families[names[f]]
                votes = np.zeros((len(at_f), len(codes)))
                for (i, a), (j, b) in combinations(enumerate(codes), 2):
                    w = self.pairs[a, b]
                    p = 1 / (1 + np.exp(-SLOPE * (x[at_f] @ w[:-1] + w[-1])))
                    votes[:, i] += p
                    votes[:, j] += 1 - p
                votes = votes / (len(codes) - 1) if len(codes) > 1 else votes + 1
                for k, row in zip(at_f, votes):
                    found[some[k]] = codes[int(row.argmax())]
                    score[some[k]] = min(1.0, float(row.max() * top[k, f]))
        return found, score


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows that aren't held out and have a label and a text."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(np.zeros((0, BUCKETS), np.float32), np.array([], dtype=str))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * per_language / n)))])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows.select("lang", "text", place.alias("place")).where(F.col("place") < share[F.col("lang")])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = [row.astype(np.float16).tobytes() for at in range(0, len(texts), 128) for row in features(texts[at:at + 128])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["lang", "place", "x"])

    found = sorted(map(tuple, map_batches(chosen, fn, "lang string, place double, x binary").collect()))
    taken = {lang: [r for r in found if r[0] == lang][:per_language] for lang in counts}
    flat = [r for rows in taken.values() for r in rows]
    return Model(np.stack([np.frombuffer(r[2], np.float16) for r in flat]).astype(np.float32), np.array([r[0] for r in flat]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the number of languages allows, not the rows
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string", "score double"])
    text_at = kept.columns.index("text")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    return map_batches(kept, fn, schema)
