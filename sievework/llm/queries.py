"""The registered queries of the dealt operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, filter_audit, graph, html, jaccard, language, mixing, packing, sharding, substrings, token_counts, toxicity
from .base import Scratch, table

CAPACITY = 2048


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after removal, and what was removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = substrings.remove_repeats(Scratch(spark), docs)
    return cleaned.select(
        "doc_id", "text", F.col("_removed_words").alias("removed_words"), F.col("_removed_runs").alias("removed_runs")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document, and whether it counts as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.score_documents(docs, chain).drop("text").withColumn("toxic", F.col("p_toxic") >= 0.5)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = language.fit_centroids(docs, learn=third != 1)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), F.col("_lang_pred").alias("lang_pred"),
        F.col("_lang_score").alias("score"), F.col("_lang_rejected").alias("rejected"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(Scratch(spark), table(spark, sf_dir, "documents"), shards=16, seed=4)
    return shards.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(Scratch(spark), table(spark, sf_dir, "documents"), weights=[5, 2, 1])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(
        "page_id", "url", F.col("_main_text").alias("text"), F.length("_main_text").cast("long").alias("n_chars")
    )


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(Scratch(spark), vectors, lambda vec_id: F.pmod(vec_id, F.lit(100)) == 0, k=10)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, and the recall that the audit found."""
    found, recall = graph.near_duplicates(Scratch(spark), table(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.withColumns({"kept": F.col("vec_id") == F.col("component_id"), "recall": F.lit(float(recall))})


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_documents(Scratch(spark), table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(Scratch(spark), table(spark, sf_dir, "documents"), CAPACITY)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and how many pre-tokens the shortcut covered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.prove("byte_bpe_50k"))
    return counted.select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"),
        (F.col("_n_tokens") > 512).alias("over_limit"), F.col("_n_whole").alias("n_whole"), F.col("_n_merged").alias("n_merged"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizations of every document."""
    return alignment.align_documents(Scratch(spark), table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter does at each step of all 120 orders, by language."""
    return filter_audit.filter_interactions(Scratch(spark), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_language, op4_sharding, op5_mixing, op6_html, op7_nearest, op8_jaccard_join, op9_packing, op10_near_vectors, op11_token_counts, op12_alignment, op13_filter_audit)
}
ORACLES: dict[str, str] = {"op13_filter_audit": filter_audit.ORACLE}
