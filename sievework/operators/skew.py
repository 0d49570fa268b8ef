"""Join rows back to a per-key table when one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# At most SHARES keys can each hold more than 1/SHARES of all rows, so the list
# of hot keys is bounded at any data size.
SHARES = 4096


def attach_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    spread: Column,
    how: str = "left",
    unmatched: Column | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` on ``keys``; ``table`` has one row per key.

    ``weight`` in ``table`` counts the rows of a key. A hot key's rows spread
    over so many tasks, by the hash of ``spread``, that each gets at most
    1/SHARES of all rows; its one table row is copied as often. Rows for which
    ``unmatched`` holds cannot find a partner and spread in the same way.
    """
    table = materialise(table)
    size = table.agg(F.sum(weight).alias("total"), F.max(weight).alias("peak")).first()
    total = size["total"] or 0
    limit = max(1, total // SHARES)
    hot_keys = (size["peak"] or 0) > limit
    if not hot_keys and unmatched is None:
        return rows.join(table, keys, how)

    salt = F.lit(0)
    if hot_keys:
        copies = F.least(F.ceil(F.col(weight) * SHARES / F.lit(total)), F.col(weight)).cast("int")
        table = table.withColumn("_salts", F.when(F.col(weight) > limit, copies).otherwise(1))
        hot = table.filter(F.col(weight) > limit).select(*keys, "_salts")
        rows = rows.join(F.broadcast(hot), keys, "left")
        salt = F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")
        table = table.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
        ).drop("_salts")
    else:
        table = table.withColumn("_salt", F.lit(0))
    if unmatched is not None:
        salt = F.when(unmatched, F.pmod(F.xxhash64(spread), F.lit(SHARES)).cast("int")).otherwise(salt)
    joined = rows.withColumn("_salt", salt).drop("_salts").join(table, [*keys, "_salt"], how)
    return joined.drop("_salt")
