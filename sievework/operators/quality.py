"""Quality flags, ordered cohorts and summary statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cohort names, in order of precedence.
EXCLUDED = "excluded_sequence_qc"
PARTIAL_AND_CONFLICT = "sensitivity_partial_and_type_conflict"
PARTIAL = "sensitivity_partial"
CONFLICT = "sensitivity_type_conflict"
PRIMARY = "primary"

# Cohort names and the labels shown for them, in display order.
COHORT_LABELS = {
    PRIMARY: "primary",
    PARTIAL: "partial",
    CONFLICT: "type conflict",
    PARTIAL_AND_CONFLICT: "partial+type",
    EXCLUDED: "excluded",
}


def cohort(excluded: Column, partial: Column, conflict: Column) -> Column:
    return (
        F.when(excluded, EXCLUDED)
        .when(partial & conflict, PARTIAL_AND_CONFLICT)
        .when(partial, PARTIAL)
        .when(conflict, CONFLICT)
        .otherwise(PRIMARY)
    )


def length_statistics(df: DataFrame, length: str, eligible: Column) -> DataFrame:
    """One row: min, max, mean and population deviation over eligible rows; NULL when none."""
    value = F.when(eligible, F.col(length))
    return df.agg(
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("population_std"),
    )


def mark_length_outliers(
    df: DataFrame, length: str, eligible: Column, sigmas: float = 3.0, out: str = "is_length_outlier"
) -> DataFrame:
    """Flag all rows strictly outside mean ± ``sigmas`` deviations of the eligible rows."""
    stats = length_statistics(df, length, eligible)
    lower = stats.select(F.col("mean") - sigmas * F.col("population_std")).scalar()
    upper = stats.select(F.col("mean") + sigmas * F.col("population_std")).scalar()
    flag = (F.col(length) < lower) | (F.col(length) > upper)
    return df.withColumn(out, F.coalesce(flag, F.lit(False)))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def domain_counts(
    df: DataFrame, column: str, labels: dict[str, str]
) -> DataFrame:
    """Counts for every name of a fixed domain, zeros included, with its display label."""
    spark = df.sparkSession
    domain = spark.createDataFrame(
        [(i, name, label) for i, (name, label) in enumerate(labels.items())],
        f"position int, {column} string, label string",
    )
    return (
        domain.join(counts_by(df, column), column, "left")
        .select("position", column, "label", F.coalesce("n", F.lit(0)).alias("n"))
    )


def unknown_values(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """Values outside a fixed domain, with their counts."""
    return counts_by(df.filter(~F.col(column).isin(*labels) | F.col(column).isNull()), column)


def first_where(df: DataFrame, order: str, checks: dict[str, Column], columns: list[str]) -> DataFrame:
    """For each named predicate the first row by ``order``; NULL columns if no row fits.

    One pass with map-side combining, whatever the number of predicates.
    """
    picked = df.agg(
        *[
            F.min_by(F.struct(*columns), F.when(predicate, F.col(order))).alias(name)
            for name, predicate in checks.items()
        ]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("row")) for n in checks])
    return picked.select(F.inline(pairs)).select("check", "row.*")
