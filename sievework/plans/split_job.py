"""From eligible records and cluster pairs to a split manifest and its summary."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import constraints as c
from ..operators import split as s
from ..operators.digests import table_digest
from ..session import materialise
from ..sources.delimited import cluster_violations, eligible_violations

# Columns of the manifest.
MANIFEST_FIELDS = [
    "internal_id", "sequence_id", "analysis_cohort", "primary_analysis_eligible",
    "homology_cluster", "split",
]


@dataclass(frozen=True)
class SplitResult:
    manifest: DataFrame
    assignment: DataFrame
    summary: dict[str, Any]


def split_eligible(
    eligible: DataFrame, pairs: DataFrame, ratios: dict[str, float], seed: int
) -> SplitResult:
    """Check the clusters, allocate them, and describe every member.

    ``eligible`` has unique internal ids; ``pairs`` are (cluster, member) rows.
    Leakage is computed from the manifest, never assumed.
    """
    c.enforce(eligible_violations(eligible))
    expected = eligible.select(F.col("internal_id").alias("member"))
    c.require_rows(pairs, "No clusters found")
    c.enforce(cluster_violations(pairs, expected))
    members = pairs.select("cluster", F.col("member").alias("internal_id"))
    sizes = materialise(s.cluster_sizes(members, "cluster"))
    assignment = s.allocate_clusters(sizes, ratios, seed)
    assigned = s.assign_members(members, assignment, "cluster", F.col("internal_id"))
    manifest = materialise(
        assigned.join(
            eligible.select(
                "internal_id", "sequence_id", "analysis_cohort", "primary_analysis_eligible"
            ),
            "internal_id",
        )
        .withColumnRenamed("cluster", "homology_cluster")
        .select(*MANIFEST_FIELDS)
    )
    return SplitResult(manifest, assignment, summarise(manifest, members, ratios, seed))


def summarise(
    manifest: DataFrame, pairs: DataFrame, ratios: dict[str, float], seed: int
) -> dict[str, Any]:
    """Counts per split, as a small document. Splits that received nothing are absent."""
    primary = F.lower(F.col("primary_analysis_eligible").cast("string")) == "true"
    rows = s.split_counts(manifest, "homology_cluster", primary).collect()
    cohorts: dict[str, dict[str, int]] = {}
    counted = manifest.groupBy("split", "analysis_cohort").agg(F.count(F.lit(1)).alias("n"))
    for row in counted.orderBy("split", "analysis_cohort").collect():
        cohorts.setdefault(row["split"], {})[row["analysis_cohort"]] = row["n"]
    leaking = s.leaking_clusters(manifest, "homology_cluster", "split")
    cluster_digest = table_digest(pairs, ["cluster", "internal_id"]).first()["content_sha256"]
    return {
        "schema_version": "1.0",
        "split_version": f"homology-{cluster_digest[:10]}-s{seed}",
        "method": "whole-homology-cluster greedy allocation",
        "seed": seed,
        "target_ratios": ratios,
        "sequence_counts": {r["split"]: r["n_sequences"] for r in rows},
        "cluster_counts": {r["split"]: r["n_clusters"] for r in rows},
        "primary_sequence_counts": {r["split"]: r["n_primary"] for r in rows if r["n_primary"]},
        "cohort_counts_by_split": cohorts,
        "total_sequences": sum(r["n_sequences"] for r in rows),
        "total_clusters": sum(r["n_clusters"] for r in rows),
        "cluster_pairs_sha256": cluster_digest,
        "split_manifest_sha256": table_digest(manifest, MANIFEST_FIELDS).first()["content_sha256"],
        "cluster_leakage": not leaking.isEmpty(),
    }


def threshold_sensitivity(frozen: DataFrame, settings: dict[str, DataFrame]) -> DataFrame:
    """How clusterings at other thresholds change the split.

    ``frozen`` and each manifest have (internal_id, homology_cluster, split).
    One row per setting: clusters, the largest, singletons, and the share of
    members that keep their frozen split.
    """
    frames = []
    for name, manifest in settings.items():
        sizes = s.cluster_sizes(manifest, "homology_cluster")
        agreement = s.split_agreement(
            manifest.select("internal_id", "split", F.lit(1).alias("w")), frozen, "internal_id", "w"
        )
        # Both sides are single rows, so this pairs one row with one row.
        pair = s.cluster_statistics(sizes).withColumn("name", F.lit(name)).join(
            agreement.withColumn("name", F.lit(name)), "name"
        )
        frames.append(pair)
    return c.all_violations(frames)
