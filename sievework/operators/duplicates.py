"""Exact-duplicate detection and identifier collisions, pre-aggregated before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import attach_by_key


def mark_exact_duplicates(
    df: DataFrame, digest: str, order: str, identity: Column, out: str = "exact_duplicate_of"
) -> DataFrame:
    """Point each row at the first row (by ``order``) with the same digest; NULL for the first.

    Only digests that occur more than once take part in the join.
    """
    firsts = (
        df.groupBy(digest)
        .agg(
            F.min(order).alias("_first"),
            F.min_by(identity, F.col(order)).alias("_first_id"),
            F.count(F.lit(1)).alias("_copies"),
        )
        .filter(F.col("_copies") > 1)
    )
    joined = attach_by_key(df, firsts, [digest], "_copies", F.col(order))
    return joined.withColumn(
        out, F.when(F.col(order) > F.col("_first"), F.col("_first_id"))
    ).drop("_first", "_first_id", "_copies")


def mark_shared_ids(
    df: DataFrame,
    keys: list[str],
    spread: Column,
    out: str = "is_duplicate_id",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Flag every row whose key occurs on more than one row. Blank keys are no collision.

    ``counted`` may name an earlier table with the same keys, so that counting
    them does not repeat the joins that led to ``df``.
    """
    filled = None
    for key in keys:
        present = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
        filled = present if filled is None else filled & present
    shared = (
        (df if counted is None else counted)
        .filter(filled)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_uses"))
        .filter(F.col("_uses") > 1)
    )
    joined = attach_by_key(df, shared, keys, "_uses", spread, unmatched=~filled)
    return joined.withColumn(out, F.col("_uses").isNotNull()).drop("_uses")


def split_preferred_copies(
    df: DataFrame, digest: str, preference: list[str], identity: str
) -> tuple[DataFrame, DataFrame]:
    """Keep one row per digest, the least by ``preference``; return (kept, rejected).

    ``identity`` is unique per row. Rejected rows carry ``related_accession``,
    the identity of the row that was kept.
    """
    order = F.struct(*preference, identity)
    winners = df.groupBy(digest).agg(
        F.min_by(identity, order).alias("_kept"), F.count(F.lit(1)).alias("_copies")
    ).filter("_copies > 1")
    joined = attach_by_key(df, winners, [digest], "_copies", F.col(identity))
    kept = joined.filter(F.col("_kept").isNull() | (F.col(identity) == F.col("_kept"))).drop("_kept", "_copies")
    rejected = joined.filter(F.col(identity) != F.col("_kept")).drop("_copies")
    return kept, rejected.withColumnRenamed("_kept", "related_accession")
