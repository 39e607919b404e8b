"""A corpus pipeline: quality rules, quality classifier, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. As a stage's result is
written before the next begins, each stage first removes the tables that earlier ones wrote on their way.

Defined cases: a null or empty text fails the quality rules, so its row goes with the first stage; a null or unknown lang
has its character classes held against those of all languages together; rows that repeat (and ties) are one group of near-duplicates, of which one
row stays; a row without a doc_id stays if its text is its own; very long texts are taken whole; an empty table gives
an empty one of the same columns at every stage; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import bounded_groups, documents, made, release, shipped, written
from kindred.llm.near_copies import drop_near_copies
from kindred.llm.neighbour_votes import fit_votes, keep_quality
from kindred.llm.packing import pack_sequences
from kindred.llm.quality_rules import keep_good
from kindred.llm.recompression import drop_repeats


_LEFT: list[str] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Removes what the stage before has written on its way, and notes what this one writes."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT)
        shipped(spark)
        bounded_groups(spark)
        before = set(made())
        out = function(spark, docs, sf_dir)
        _LEFT.extend(p for p in made() if p not in before)
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language's references go."""
    return keep_good(docs)


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half go. Labelled rows are learnt from as they stand in the
    documents table, so that the rejected ones of earlier stages still teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, fit_votes(documents(spark, sf_dir).select("doc_id", "text"), labels))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles alike to 0.8) stays, that of the smallest doc_id."""
    return drop_near_copies(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of a smaller doc_id has are cut out of the text."""
    return drop_repeats(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: The classifier and the packing can't be expressed in SQL; tests hold the operators, and the stage of near-duplicates,
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0], keep=True)
