"""Queries over the tables for the text operators, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm import line_dedup, ngram, quality
from loamgrid.llm.bpe import token_digests
from loamgrid.llm.common import table
from loamgrid.llm.exact_dedup import exact_groups
from loamgrid.llm.html_text import extract
from loamgrid.llm.langid import predict_held_out
from loamgrid.llm.packing import pack
from loamgrid.llm.simhash import near_groups
from loamgrid.llm.toxicity import score_held_out

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_held_out(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_held_out(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_toxicity, op3_language_id, op4_quality_rules, op5_bpe, op6_simhash, op7_exact_dedup, op8_line_dedup, op9_packing, op10_lm_score)}

ORACLE_SQL = {
    "op4_quality_rules": quality.oracle(),
    "op8_line_dedup": line_dedup.oracle(),
    "op7_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
""",
}
