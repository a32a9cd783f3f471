"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes all that the one before it kept.  The first four return the columns of
``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmetrics.llm.common import materialise, table, tidy
from maskmetrics.llm.decontamination import decontaminate
from maskmetrics.llm.language import fit, held_out, with_a_language
from maskmetrics.llm.packing import pack_documents, packing_digest
from maskmetrics.llm.passages import cut_passages, repeated_passages
from maskmetrics.llm.queries import CAPACITY, END_ID, word_tokenizer
from maskmetrics.llm.simhash import drop_copies

#: Words that a worker remembers; fewer than by default, as the earlier stages' memory is still with the executors.
MEMO_WORDS = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which one language prevails; those without letters or without such a language go."""
    return with_a_language(docs, fit(docs.where(~held_out(F.col("doc_id")))))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return drop_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; documents of which nothing is left go."""
    return cut_passages(docs, materialise(repeated_passages(docs), "passages"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing_digest(*pack_documents(docs, word_tokenizer(), END_ID, CAPACITY, memo_words=MEMO_WORDS))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each one's result written and read again; what a stage writes besides goes with it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with tidy(spark) as kept:
            docs = materialise(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
