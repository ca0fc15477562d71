"""Stages of the corpus pipeline: (spark, docs, sf_dir) to the documents that stay, with the columns of documents.

Null and empty texts go at the first stage, as no language can be told. Rows that repeat are judged alike by the first two stages and
become one in the third. Texts of any length are judged whole. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import langid, packing, toxicity
from loamgrid.llm.common import table
from loamgrid.llm.exact_dedup import OWN, exact_dedup
from loamgrid.llm.similar import similar_dedup

#: A document goes if no language has at least this share of its words: one that is a mixture, or has no words.
MAIN_LANGUAGE = 0.5


def beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame], own: Iterable[str]) -> DataFrame:
    """work(docs), which keeps docs' columns, with those of the operator's own names put aside meanwhile."""
    own = {x.lower() for x in own}
    aside = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in own}
    return work(docs.withColumnsRenamed(aside)).withColumnsRenamed({v: k for k, v in aside.items()})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language, whichever it is: one that has at least half of the words."""

    def work(d: DataFrame) -> DataFrame:
        found = langid.identify(d, langid.fit(d), d.columns)
        return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MAIN_LANGUAGE)).select(*d.columns)

    return beside(docs, work, [f.name for f in langid.PREDICTED])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted as toxic; the model learns from the labels of those that have come so far."""

    def work(d: DataFrame) -> DataFrame:
        model = toxicity.fit(d, table(spark, sf_dir, "labels"))
        return toxicity.score(d, model, d.columns).where("predicted = 0").select(*d.columns)

    return beside(docs, work, [f.name for f in toxicity.SCORED])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return beside(docs, exact_dedup, OWN)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest id stays."""
    return beside(docs, similar_dedup, ["_keep"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
