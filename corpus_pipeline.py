"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. Its output is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import jaccard, mixing, packing, substrings, toxicity
from sievework.llm.base import Scratch, table

#: Documents at or above this probability of being toxic go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the given labels, does not call toxic."""
    chain = toxicity.fit_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.label_categories())
    scored = toxicity.score_documents(docs, chain, prefix="_p_")
    return scored.filter(F.col("_p_toxic") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return jaccard.one_per_group(Scratch(spark), docs, size=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents that held nothing else go."""
    cleaned = substrings.remove_repeats(Scratch(spark), docs)
    left = cleaned.filter((F.col("_removed_words") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        count = F.when(F.col("_removed_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        left = left.withColumn("n_chars", F.coalesce(count, "n_chars"))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mixed_rows(Scratch(spark), docs, weights=[5, 2, 1])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(Scratch(spark), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models, set similarity and tokenizers have no SQL form; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is dropped once the next one is written."""
    store, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        later = store.keep(stage(spark, docs, sf_dir))
        store.drop(docs)
        docs = later
    return STAGES[-1][1](spark, docs, sf_dir)
