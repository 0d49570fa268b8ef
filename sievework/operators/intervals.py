"""Positions labelled by the strongest interval that covers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a level are this many bits wider than those of the level before.
STEP = 2


def _level(length: Column) -> Column:
    """The least level whose cells, ``2 ** level`` positions each, are as long as the interval."""
    bits = F.when(length > 1, F.length(F.bin(length - 1))).otherwise(0)
    return (F.ceil(bits / STEP) * STEP).cast("int")


def strongest_cover(
    points: DataFrame, intervals: DataFrame, keys: list[str], position: str, start: str, end: str, rank: Column
) -> DataFrame:
    """``(*keys, position, rank)`` of the points that an interval covers, with the least rank.

    An interval lies in one or two cells of its level, however long it is. A
    point lies in one cell of each level that occurs, and there are no more than 32 of
    them. So points and intervals meet by equal cells, and a filter removes those that only share a cell.
    """
    spans = (
        intervals.filter(F.col(start) <= F.col(end))
        .groupBy(*keys, F.col(start).cast("bigint").alias("_from"), F.col(end).cast("bigint").alias("_to"))
        .agg(F.min(rank).alias("rank"))
        .withColumn("_level", _level(F.col("_to") - F.col("_from") + 1))
    )
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    cells = spans.withColumn(
        "_cell", F.explode(F.expr("array_distinct(array(shiftright(_from, _level), shiftright(_to, _level)))"))
    )
    places = points.select(*keys, F.col(position).cast("bigint").alias("_at")).filter("_at is not null").distinct()
    levelled = places.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    met = levelled.withColumn("_cell", F.expr("shiftright(_at, _level)")).join(cells, [*keys, "_level", "_cell"])
    place = F.col("_at").cast(points.schema[position].dataType)
    return met.filter("_at between _from and _to").groupBy(*keys, place.alias(position)).agg(F.min("rank").alias("rank"))


def label_by_interval(
    rows: DataFrame,
    position: str,
    intervals: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    label: str,
    priority: list[str],
    default: str,
    out: str,
) -> DataFrame:
    """Give each row the first label in ``priority`` whose interval covers its position.

    Intervals with another label, or that end before they start, cover nothing.
    """
    names = F.array(*[F.lit(p) for p in priority])
    known = intervals.filter(F.col(label).isin(*priority))
    covered = strongest_cover(rows, known, keys, position, start, end, F.array_position(names, F.col(label)))
    joined = rows.join(covered, [*keys, position], "left")
    return joined.withColumn(
        out, F.coalesce(F.try_element_at(names, F.col("rank").cast("int")), F.lit(default))
    ).drop("rank")
