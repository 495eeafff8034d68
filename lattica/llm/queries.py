"""The queries of this subpackage, one for each operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, chat, cotrain, decontam, exact_dedup, grammar, langid, near_dedup, pii, style_tree
from lattica.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")))


def op5_grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = grammar.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return grammar.read_documents(spark, path)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.decisions(table(spark, sf_dir, "documents"), words=2, threshold=0.8)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.examples(chat.with_hostile(table(spark, sf_dir, "conversations"))))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_main_text": op2_main_text,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_quality": op4_quality,
    "op5_grammar_shards": op5_grammar_shards,
    "op6_near_dedup": op6_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_personal_data": op10_personal_data,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents),
             g as (select body, min(doc_id) as keep_id, count(*) as group_size from n group by body)
        select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.body) as text_sha256
        from n join g using (body)""",
    "op9_chat_format": r"""
        with raw as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t as (
            select *, 20 + length(regexp_replace(role, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g'))
                         + length(regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g')) as chars,
                   row_number() over w as pos, count(*) over (partition by conv_id) as n
            from raw window w as (partition by conv_id order by turn nulls first, role, text)),
        s as (select *, sum(chars) over (partition by conv_id order by pos) as upto from t)
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
               coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
               (sum(upto) filter (where role = 'assistant' or pos = n))::bigint as formatted_chars
        from s group by conv_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
