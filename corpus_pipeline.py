"""A training corpus in five stages: language ID, exact dedup, near-duplicates, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, exact_dedup, jaccard_join, language, packing
from tessera.llm.common import discard, load, materialize, passing, without


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go."""
    found = language.identify_documents(docs)
    return without(docs, found.where("not kept").select("doc_id"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return without(docs, exact_dedup.content_sort_dedup(docs).where("not kept").select("doc_id"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id (five-word shingles, 0.8 or more)."""
    found = jaccard_join.jaccard_join(docs, gram=5, percent=80)
    return without(docs, found.where("doc_id <> component_id").select("doc_id"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontamination.find_leaks(docs, load(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


#: (name, function); each function takes (spark, docs, sf_dir), and its result is the next one's ``docs``.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", leak_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the text model or the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored in the shared folder and read again."""
    docs = load(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = docs
        with passing() as keep:  # what a stage holds besides its result is freed
            docs = keep(materialize(stage(spark, before, sf_dir), name))
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
