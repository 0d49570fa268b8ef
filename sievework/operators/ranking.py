"""Exact ranks over very large groups without one task seeing a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256


def tie_key(seed: int, *columns) -> F.Column:
    """SHA-256 of ``seed:value[:value…]``: a seeded order that any engine can repeat."""
    return sha256(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def bucketed_rank(
    df: DataFrame,
    groups: list[str],
    digest: str,
    out: str,
    prefix: int = 4,
    group_table: DataFrame | None = None,
) -> DataFrame:
    """Zero-based rank of each row by a hexadecimal ``digest`` within ``groups``.

    Digests are uniform, so their first characters cut every group into even
    buckets. Ranks are counted per bucket, and a running sum over at most
    ``16 ** prefix`` bucket counts per group gives each bucket its offset.
    ``group_table`` (one row per group) is joined to the offsets, not to the rows.
    """
    keyed = df.withColumn("_bucket", F.left(F.col(digest), F.lit(prefix)))
    keys = [*groups, "_bucket"]
    within = Window.partitionBy(*keys).orderBy(digest)
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        keyed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    if group_table is not None:
        offsets = offsets.join(group_table, groups)
    ranked = keyed.withColumn("_local", F.row_number().over(within))
    return (
        ranked.join(offsets, keys)
        .withColumn(out, (F.col("_offset") + F.col("_local") - 1).cast("bigint"))
        .drop("_bucket", "_local", "_offset")
    )


def seeded_rank(df: DataFrame, identity: list[str], seed: int, out: str = "rank") -> DataFrame:
    """A seeded permutation rank, computed from row identities alone."""
    keyed = df.withColumn("_tie", tie_key(seed, *[F.col(c) for c in identity]))
    return bucketed_rank(keyed, [], "_tie", out).drop("_tie")
