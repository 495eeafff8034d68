"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, decoding by the reversed byte table.

A vocabulary comes from a tokenizers JSON file or from a rank file. A rank file has no list of merges, so every split of
a token into two tokens becomes a merge, in the order of the ranks, which is what merging by rank does.

Texts of a batch are cut before each space, and each lone line break, that stands before a visible character. The split
pattern never matches across these places, so a piece has the same ids wherever it stands; nor does it match a letter
with a mark after it. Cutting and finding the distinct pieces are column functions. Of a piece that is a word of letters,
maybe with ASCII marks after it, word and marks are looked up each by itself, so the library encodes a word once whatever
marks follow it; ids are kept in tables of bounded size. A word of letters alone is one match of the pattern, so the
library gets such words without having to search for it.

Offsets are found from the ids: the byte length of each token gives its byte span, and counting the bytes that begin a
character gives its character span. A token that holds part of a character spans that whole character.

Defined cases: a null text counts as empty and has no ids; lone surrogates can't occur in Spark's strings; special
tokens' strings in a text are ordinary text; extra columns are carried by ``encode``; empty tables give empty results.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lattica.llm.common import env_threads, map_batches, on_leaving

#: Distinct words, and other pieces, whose ids a worker keeps (about 200 bytes each), unless it is told otherwise; fuller tables are emptied.
PIECES = 400_000
#: Bytes of text that are cut into pieces at once.
PORTION = 2 << 20

CUT = re.compile(r" (?=\S)")
#: ASCII marks that never share a match of the pattern with a letter (an apostrophe may). A run of them is one match.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below U+02B0 are letters in any version of Unicode that a library may have.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
WORD = f"^(?P<line>\n?)(?P<stem>[{LATIN}]+)(?P<marks>[{re.escape(MARKS)}]*)$"
#: Words that the library gets in one string.
BLOCK = 200
#: In place of a place: a piece that isn't in the table, and one whose text is cut otherwise.
NEW, ODD = -1, -2


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    own = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [own[b] for b in range(256)]


def rank_tokenizer(path: str, pattern: str):
    """A tokenizers.Tokenizer that gives the ids of a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    char = byte_characters()
    text = {t: "".join(map(char.__getitem__, t)) for t in ranks}
    merges = [(text[t[:k]], text[t[k:]]) for t in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(t))
              if t[:k] in ranks and t[k:] in ranks]
    out = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"),
                                                 pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def plain_tokenizer(tokenizer):
    """The same model for words of visible byte characters between spaces."""
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer(tokenizer.model)
    out.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
    return out


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def looked_up(table: dict[str, int], names: list[str]) -> np.ndarray:
    return np.fromiter(map(table.get, names, repeat(NEW)), np.int64, len(names))


def joined(ids: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ids that begin at these places, one after the other."""
    ends = np.cumsum(counts)
    return ids[np.repeat(begins - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Codec:
    """Encodes texts to ids and decodes ids to bytes. Built once a worker; see ``codec``."""

    def __init__(self, tokenizer, pieces: int | None = None):
        self.tokenizer, self.pieces = tokenizer, pieces or PIECES
        byte = {c: b for b, c in enumerate(byte_characters())}
        size = max(tokenizer.get_vocab().values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in tokenizer.get_vocab().items():
            self.bytes[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.plain = plain_tokenizer(tokenizer)
        self.space = byte_characters()[32]
        self.visible = np.array([" " if b == 32 else c for b, c in enumerate(byte_characters())]).view("<u4")
        self._forget()

    def _forget(self) -> None:
        """Empty the tables. A place tells where ids stand; place 0 has none."""
        self.known: dict[str, int] = {"": ODD}  # words and other pieces after a space, or that begin with a line break
        self.first: dict[str, int] = {"": 0}  # where no space stands before
        self.marks: dict[str, int] = {"": 0}  # after letters
        self.odd: dict[str, int] = {}  # parts of texts with other white space, the space before them included
        self.ids, self.begins, self.counts = np.empty(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.n_ids, self.places = 0, 1

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The places of new pieces, whose ids follow each other."""
        n, m = self.places + len(counts), self.n_ids + len(ids)
        if n > len(self.begins):
            self.begins, self.counts = (np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), np.int64)]) for x in (self.begins, self.counts))
        if m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(m - len(self.ids), len(self.ids) // 2), "<u4")])
        self.ids[self.n_ids:m] = ids
        self.counts[self.places:n] = counts
        self.begins[self.places:n] = self.n_ids + np.cumsum(counts) - counts
        out, self.places, self.n_ids = np.arange(self.places, n), n, m
        return out

    def _library(self, pieces: list[str]) -> list[int]:
        """The places of pieces, each encoded by itself."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return self._add(np.array([i for x in ids for i in x], dtype="<u4"), np.array([len(x) for x in ids], dtype=np.int64)).tolist()

    def _blocks(self, tokenizer, blocks: list[str], sizes: np.ndarray) -> list[int]:
        """The places of words, many in one string, which no token and no match of the pattern joins. sizes: the bytes of each word."""
        found = [np.array(e.ids, dtype="<u4") for at in range(0, len(blocks), 200)
                 for e in tokenizer.encode_batch_fast(blocks[at:at + 200], add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, "<u4")
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), side="right")
        return self._add(ids, np.diff(ends, prepend=0)).tolist()

    def _spaced(self, words: list[str]) -> list[int]:
        """The places of words that stand after a space: no match reaches over a cut."""
        blocks = [" " + " ".join(words[k:k + BLOCK]) for k in range(0, len(words), BLOCK)]
        return self._blocks(self.tokenizer, blocks, np.array([len(w.encode()) + 1 for w in words], dtype=np.int64))

    def _lettered(self, words: pa.Array, table: dict[str, int], space: str) -> np.ndarray:
        """The places of words of letters, by a table that is added to; the library gets new ones in strings of visible byte characters."""
        coded = words.dictionary_encode()
        names = strings(coded.dictionary)
        place = looked_up(table, names)
        if len(new := np.flatnonzero(place == NEW)):
            fresh = [names[k] for k in new.tolist()]
            blocks = []
            for k in range(0, len(fresh), BLOCK):
                shown = self.visible[np.frombuffer(" ".join(fresh[k:k + BLOCK]).encode(), np.uint8)].tobytes().decode("utf-32-le")
                blocks.append(space + shown.replace(" ", " " + space))
            sizes = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[new].astype(np.int64) + len(space)
            found = self._blocks(self.plain, blocks, sizes)
            table.update(zip(fresh, found))
            place[new] = found
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def _others(self, names: list[str], table: dict[str, int]) -> np.ndarray:
        """The places of distinct pieces that aren't words of letters; ODD stands for what has white space at an end or is nothing else."""
        new = [w for w in names if w not in table]
        table.update((w, ODD) for w in new)
        fit = [w for w in new if (q := w[w[:1] == "\n":]) and not q[0].isspace() and not q[-1].isspace()]
        alone = fit if table is self.first else [w for w in fit if w[0] == "\n"]
        spaced = [] if table is self.first else [w for w in fit if w[0] != "\n"]
        table.update(zip(alone, self._library(alone)))
        table.update(zip(spaced, self._spaced(spaced)))
        return looked_up(table, names)

    def _placed(self, pieces: pa.Array, table: dict[str, int]) -> np.ndarray:
        """Three places of each distinct piece (a line break, letters or what else there is, marks), by the table known or first."""
        parts = pc.extract_regex(pieces, WORD)
        regular = parts.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(pieces), 3), dtype=np.int64)
        out[~regular, 1] = self._others(strings(pieces.filter(pa.array(~regular))), table)
        line, stem, marks = (x.filter(pa.array(regular)) for x in parts.flatten())
        broken = pc.equal(line, "\n").to_numpy(zero_copy_only=False)
        if broken.any() and "\n" not in self.marks:
            self.marks["\n"] = self._library(["\n"])[0]
        bare = broken | (table is self.first)
        word = np.empty(len(stem), dtype=np.int64)
        word[bare] = self._lettered(stem.filter(pa.array(bare)), self.first, "")
        word[~bare] = self._lettered(stem.filter(pa.array(~bare)), self.known, self.space)
        coded = marks.dictionary_encode()
        runs = strings(coded.dictionary)
        new = [r for r in runs if r not in self.marks]
        self.marks.update(zip(new, self._library(new)))
        out[regular] = np.stack([np.where(broken, self.marks.get("\n", 0), 0), word,
                                 looked_up(self.marks, runs)[coded.indices.to_numpy(zero_copy_only=False)]], axis=1)
        return out

    def _parts(self, text: str) -> list[int]:
        """The places of the parts of a text where white space is more than lone spaces and line breaks."""
        head, *rest = CUT.split(text)
        parts = [head, *[" " + w for w in rest]]  # a first part never begins as the others do
        if head not in self.odd:
            self.odd[head] = self._library([head])[0]
        new = list({w for w in parts if w not in self.odd})
        self.odd.update(zip(new, self._spaced([w[1:] for w in new])))
        return [self.odd[w] for w in parts]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if not len(texts):
            return []
        if self.places > self.pieces:
            self._forget()
        whole = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        cut = pc.split_pattern(pc.replace_substring(whole, "\n", " \n"), " ")
        begins, coded = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        heads = coded.take(pa.array(begins[:-1])).dictionary_decode().dictionary_encode()
        places = np.concatenate([self._placed(coded.dictionary, self.known), self._placed(heads.dictionary, self.first)])
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at[begins[:-1]] = heads.indices.to_numpy(zero_copy_only=False) + len(coded.dictionary)
        sizes = np.diff(begins)
        odd = np.flatnonzero(np.logical_or.reduceat((places[:, 1] == ODD)[at], begins[:-1]))
        if len(odd):
            each, more = np.split(at, begins[1:-1]), []
            n = len(places)
            for k in odd.tolist():
                own = self._parts(whole[k].as_py())
                each[k] = np.arange(n, n := n + len(own))
                more += own
            at, sizes = np.concatenate(each), np.array([len(x) for x in each])
            places = np.concatenate([places, np.stack([np.zeros(len(more), np.int64), more, np.zeros(len(more), np.int64)], axis=1)])
        places[places[:, 1] == ODD, 1] = 0
        # The ids of each distinct piece, then those of the texts.
        counts = self.counts[places]
        ids, n = joined(self.ids, self.begins[places].ravel(), counts.ravel()), counts.sum(axis=1)
        ids = joined(ids, (np.cumsum(n) - n)[at], n[at])
        return np.split(ids, np.cumsum(n[at])[np.cumsum(sizes) - 1][:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode_pieces(self, ids: np.ndarray) -> list[str]:
        """The text that each id completes; a character split over ids is given with the id that ends it."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.bytes[i]) for i in ids.tolist()]
        if out:
            out[-1] += reader.decode(b"", True)
        return out

    def offsets(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.lengths[ids])
        return char_of[end - self.lengths[ids]], char_of[end - 1] + 1

    def ids_text(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str | None], Codec] = {}
on_leaving(_codecs.clear)


def codec(path: str, pattern: str | None = None, pieces: int | None = None) -> Codec:
    """The codec of a rank file (with its split pattern) or of a tokenizers JSON file (without). pieces: how many distinct ones it keeps."""
    if (path, pattern) not in _codecs:
        env_threads()
        _codecs[path, pattern] = Codec(rank_tokenizer(path, pattern) if pattern else json_tokenizer(path), pieces)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str | None = None, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """docs with the arrays ids and, if asked for, starts and ends (characters). A column of one of these names is replaced."""
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    kept = docs.drop(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} array<int>" for n in names])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ids = own.encode(texts)
            columns = [[x.astype(np.int32) for x in ids]]
            if offsets:
                spans = [own.offsets(i, t or "") if len(i) else (i, i) for i, t in zip(ids, texts)]
                columns += [[s[k].astype(np.int32) for s in spans] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.list_(pa.int32())) for c in columns]],
                                             names=[*batch.schema.names, *names])

    return map_batches(kept, fn, schema)


def portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """All rows in their order, in batches of at most PORTION bytes of text, or of one row: a text's pieces take many times its size."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for k, more in enumerate(n.tolist()):
            if k > start and size + more > PORTION:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += more
        if start < batch.num_rows:
            yield batch.slice(start)


def digests(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in portions(batches, 1):
            ids = own.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(own.ids_text(x).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
