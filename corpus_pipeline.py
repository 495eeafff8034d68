"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next one.

language ID → exact dedup → MinHash near-dedup → benchmark decontamination → byte-level BPE.

The first four return the columns of documents and drop rows; the last returns the ids of each document that is left.

What holds in all stages: columns are kept as they are, whatever their names (operators keep a row as one value, or join by names of
their own); an empty table gives an empty one; texts are read whole, however long; rows that repeat an identifier and a text are
decided alike. Each stage's docstring says what happens to nulls and ties.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontam, exact_dedup, langid, near_dedup
from lattica.llm.common import table, written

#: A document is rejected if its language is undetermined or scored below this. Two languages alike give 0.5 within a family, so with
#: the few languages of a small model no score is that low, and only documents without a letter go.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or no language that is likely. The model is fitted on this stage's own
    labelled rows; a null label isn't learned from, a null text is dropped, a null identifier doesn't matter. Of languages that score
    alike the first in order counts; without any label every document is dropped, as no language is known. Repeated rows all stay."""
    found = langid.predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), langid.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id stays; a null identifier is larger than all others,
    a null text is an empty one, and of rows that repeat identifier and text one stays."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity of 0.8 or more), the smallest doc_id stays. Null and empty texts
    and rows with a null identifier are linked with nothing and stay; of equal identifiers with other texts the one whose text has the
    smaller hash stays; rows that repeat the one that stays, stay as well."""
    return near_dedup.kept_rows(docs, words=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts are clean; a null identifier is decided by its text; null items and
    empty ones are held by nothing; repeated rows go or stay together."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left: one row for each row, a null identifier included; a
    null text is an empty one and has no ids."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("bpe", tokenise),
]

#: Language identification, near-duplicate search and BPE have no SQL; tests/llm/test_pipeline.py states each stage by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
