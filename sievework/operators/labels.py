"""Admissibility of tri-state labels and the report per sample group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constraints import all_violations, check_all, unique_key


def label_violations(labels: DataFrame, statuses: DataFrame, key: str = "internal_id") -> DataFrame:
    """Labels and statuses must pair one to one, and a label needs a verified success."""
    left = labels.select(
        key,
        F.col("scan_status").alias("_label_state"),
        F.col("label").alias("_label"),
        F.col("detected").alias("_detected"),
    )
    right = statuses.select(key, "submitted", "scan_status", "result_present", "parse_status")
    pair = left.withColumn("_l", F.lit(True)).join(right.withColumn("_s", F.lit(True)), key, "full_outer")
    present = F.col("_l").isNotNull() & F.col("_s").isNotNull()
    verified = (
        (F.col("scan_status") == "success")
        & F.col("submitted") & F.col("result_present") & (F.col("parse_status") == "success")
    )
    labelled = F.col("_label").isNotNull()
    rules = [
        ("Status/label ID mismatch", ~present),
        ("Status/label inconsistency", present & (
            ~F.col("_label_state").eqNullSafe(F.col("scan_status"))
            | ~F.col("_label").eqNullSafe(F.col("_detected")))),
        ("Label without verified successful result", present & labelled & ~(
            F.coalesce(verified, F.lit(False)) & F.col("_label").isin(0, 1))),
        ("Successful classification cannot have blank label",
         present & (F.col("scan_status") == "success") & ~labelled),
    ]
    return all_violations(
        [check_all(pair, F.col(key), rules), unique_key(labels, [key], "duplicate label"), unique_key(statuses, [key], "duplicate status")]
    )


def group_summary(rows: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """Counts per group from (group, submitted, state, label); empty groups give zero rows.

    ``submitted = scan_success + pending_or_failed`` and
    ``scan_success = positive + not_detected`` hold by the way labels are counted.
    """
    spark = rows.sparkSession
    submitted = F.col("submitted")
    counted = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(submitted).alias("submitted"),
        F.count_if(submitted & (F.col("label") == 1)).alias("positive"),
        F.count_if(submitted & (F.col("label") == 0)).alias("not_detected"),
        F.count_if(submitted & F.col("label").isNull()).alias("pending_or_failed"),
        F.count_if(~submitted).alias("not_submitted"),
        F.count_if(submitted & (F.col("scan_status") == "needs_review")).alias("needs_review"),
    )
    domain = spark.createDataFrame([(g,) for g in groups], f"{group} string")
    names = [c for c in counted.columns if c != group]
    filled = domain.join(counted, group, "left").select(
        group, *[F.coalesce(c, F.lit(0)).alias(c) for c in names]
    )
    success = F.col("positive") + F.col("not_detected")
    balanced = F.col("submitted") == success + F.col("pending_or_failed")
    return filled.withColumn(
        "scan_success",
        F.when(balanced, success).otherwise(
            F.raise_error(F.lit("group counts do not add up")).cast("bigint")
        ),
    ).select(
        group, "selected", "submitted", "scan_success", "positive", "not_detected",
        "pending_or_failed", "not_submitted", "needs_review",
    )
