"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, attached, code_point_order, numbered

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(
    scratch: Scratch, sizes: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``(source, source_size, source_docs, target)`` from ``(source, source_size, source_docs)``.

    Sources in the order of their code points, NULL last, get the weights in
    turn. Targets share ``share`` of all sizes by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by
    weight. The common level only rises, so each pass stops at least one more
    source; a pass is one aggregation that returns three numbers.
    """
    place = F.pmod("_rank", F.lit(len(weights))) + 1
    ranked = scratch.keep(
        numbered(scratch, sizes.withColumn("_order", code_point_order("source")), ["_order"], "_rank")
        .withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place.cast("int")).cast("long"))
        .withColumn("_most", F.col("source_size") * most)
        .drop("_order", "_rank")
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("_weight") * level > F.col("_most") if stopped >= 0 else F.lit(False)
        now, used, open_weight = ranked.agg(
            F.count_if(full), F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if now == stopped or not open_weight:
            break
        stopped, level = now, (total * share - (used or 0.0)) / open_weight
    target = F.least(F.col("_weight") * F.lit(level), F.col("_most"))
    return ranked.select("source", "source_size", "source_docs", target.cast("double").alias("target"))


def mix_documents(
    scratch: Scratch,
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How often each document enters the mix: one row per row of ``docs``.

    Within a source each document expects ``target / source size`` copies. Their
    prefix sums, plus one random offset per source, cross whole numbers; a
    document is taken once per crossing, so never more than ``ceil(most)`` times.
    Documents stand in the order of their size, so the words taken miss the
    target by about the largest document at most. Sums are not passed from task
    to task: a document's place in its source follows from its global number.

    NULL texts and texts without words have size 0 and are drawn like others.
    Sources whose size is 0 have target 0, and nothing is taken. Rows that agree
    in id, size and text hash are interchangeable. An empty table stays empty.
    """
    narrow = docs.select(
        F.col(source).alias("source"),
        F.col(key).alias("_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.col(text)).alias("_text"),
    ).withColumn("_source", code_point_order("source")).withColumn("_shuffled", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_key").cast("string"))))
    rows = numbered(scratch, narrow, ["_source", "_size", "_shuffled", "_text"], "_row").drop("_source", "_shuffled")
    kept = scratch.keep(rows)
    sources = scratch.keep(
        kept.groupBy("source")
        .agg(F.sum("_size").alias("source_size"), F.count("*").alias("source_docs"), F.min("_row").alias("_first"))
    )
    targets = source_targets(scratch, sizes=sources.drop("_first"), weights=weights, share=share, most=most)
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.col("source"))), 1, 8), 16, 10)
    rates = (
        targets.join(sources.select(F.col("source").alias("_s"), "_first"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_offset", offset.cast("double") / F.lit(2.0**32))
        .withColumnRenamed("source", "_s")
    )
    crossed = lambda at: F.floor(at * F.col("_rate") + F.col("_offset"))
    place = F.col("_row") - F.col("_first")
    copies = F.least(crossed(place + 1) - crossed(place), F.ceil("_rate"))
    return (
        kept.join(rates, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", copies.cast("int"))
        .select(
            F.col("_key").alias(key), "source", F.col("_size").alias("size"), "source_size", "target", "copies",
            (F.col("copies") * F.col("_size")).cast("long").alias("taken"), F.col("_text").alias("text_hash"),
        )
    )


def mixed_rows(
    scratch: Scratch, docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: int = 0,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    Rows that agree in key, text and source are taken as one row, as often as all of them together.
    """
    mixed = mix_documents(scratch, docs, weights, share, most, seed, key, text, source)
    decided = scratch.keep(
        mixed.groupBy(F.col(key).alias("_k"), F.col("text_hash").alias("_t"), F.col("source").alias("_s"))
        .agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0")
    )
    named = docs.withColumn("_hash", F.xxhash64(F.col(text)))
    same = (F.col("_hash") == F.col("_t")) & F.col(key).eqNullSafe(F.col("_k")) & F.col(source).eqNullSafe(F.col("_s"))
    rows = attached(named.join(decided, same), decided, [key, "_hash", source])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
