"""Histograms whose last bin is closed, zero-filled over the whole bin domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _zero_fill(counts: DataFrame, bins: int) -> DataFrame:
    domain = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return domain.join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n")
    )


def fixed_width(df: DataFrame, column: str, start: int, stop: int, width: int) -> DataFrame:
    """Bins from ``start`` to the last edge below ``stop``; values outside are dropped."""
    edges = range(start, stop, width)
    bins = len(edges) - 1
    value = F.col(column)
    index = F.least(F.floor((value - edges[0]) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (
        df.filter((value >= edges[0]) & (value <= edges[-1]))
        .groupBy(index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _zero_fill(counts, bins).withColumn("lower", (F.lit(start) + F.col("bin") * width).cast("bigint"))


def equal_width(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bins`` bins between the least and greatest value; one value widens by a half each way."""
    limits = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    spread = F.col("hi") > F.col("lo")
    lo = limits.select(F.when(spread, F.col("lo")).otherwise(F.col("lo") - 0.5)).scalar()
    hi = limits.select(F.when(spread, F.col("hi")).otherwise(F.col("hi") + 0.5)).scalar()
    value = F.col(column).cast("double")
    index = (F.least(F.width_bucket(value, lo, hi, F.lit(bins)), F.lit(bins)) - 1).cast("int")
    counts = df.filter(value.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _zero_fill(counts, bins)


def occupancy(
    coordinates: DataFrame, state: str, identity: str, states: int, insertion: str | None = None
) -> DataFrame:
    """Distinct identities per state ``1..states``; unset states and insertions do not count."""
    rows = coordinates.filter(F.col(state).isNotNull())
    if insertion is not None:
        rows = rows.filter(~F.col(insertion))
    counts = rows.groupBy(F.col(state).cast("int").alias("state")).agg(
        F.count_distinct(identity).alias("n")
    )
    domain = coordinates.sparkSession.range(1, states + 1).select(
        F.col("id").cast("int").alias("state")
    )
    return domain.join(counts, "state", "left").select(
        "state", F.coalesce("n", F.lit(0)).alias("n")
    )
