"""Tables behind the figures, and spot checks that show one row per rule."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import constraints as c
from ..operators import histograms as h
from ..operators import quality as q
from ..operators.split import cluster_sizes
from ..sinks.tables import markdown_table


def cohort_table(metadata: DataFrame) -> DataFrame:
    """Counts of all known cohorts. An unknown cohort is an error, never left out."""
    c.require_rows(metadata, "Empty metadata")
    unknown = q.unknown_values(metadata, "analysis_cohort", q.COHORT_LABELS)
    c.enforce(c.violation(unknown, "unknown analysis_cohort", F.col("analysis_cohort"), ""))
    return q.domain_counts(metadata, "analysis_cohort", q.COHORT_LABELS)


def figure_tables(
    metadata: DataFrame, pairs: DataFrame, status: DataFrame, coordinates: DataFrame, states: int
) -> dict[str, DataFrame]:
    """The plotted values: cohorts, lengths, cluster sizes, splits, states and occupancy."""
    return {
        "cohort_counts": cohort_table(metadata),
        "length_distribution": h.fixed_width(
            metadata.withColumn("length", F.col("sequence_length").cast("int")), "length", 50, 185, 5
        ),
        "cluster_sizes": h.equal_width(cluster_sizes(pairs, "cluster"), "size", 30),
        "splits": q.counts_by(status, "split"),
        "status": q.counts_by(status, "status"),
        "hmm_occupancy": h.occupancy(coordinates, "hmm_match_state", "internal_id", states, "is_insertion"),
        "filter_flow": metadata.agg(
            F.count(F.lit(1)).alias("candidates"), F.count_if("sequence_qc_eligible").alias("eligible")
        ),
    }


def plotted_equals_source(plotted: DataFrame, metadata: DataFrame) -> DataFrame:
    """Plotted cohort values that differ from a fresh count of the rows."""
    fresh = q.counts_by(metadata, "analysis_cohort").withColumnRenamed("n", "fresh")
    return plotted.join(fresh, "analysis_cohort", "full_outer").filter(
        F.coalesce("n", F.lit(0)) != F.coalesce("fresh", F.lit(0))
    )


# What each spot check shows, and what it means that no row was found.
CHECKS = {
    "primary": ("A QC-eligible row marked primary.", "No primary row."),
    "partial": ("The partial flag comes from annotation text.", "No row that is only partial."),
    "type_conflict": ("Another member type keeps the row out of primary.", "No row with only a type conflict."),
    "partial_and_type_conflict": ("Both flags put the row into its own cohort.", "No row with both flags."),
    "nonstandard_or_excluded": ("The exclusion is explicit.", "No excluded row."),
    "length_outlier": ("Outliers are flagged, not dropped.", "No length outlier under the rule."),
}


def spot_checks(metadata: DataFrame) -> DataFrame:
    """The first row per rule by internal id, or a NULL row, from one pass over the metadata."""
    predicates = {
        "primary": F.col("analysis_cohort") == q.PRIMARY,
        "partial": F.col("is_partial_any_member") & ~F.col("has_type_conflict"),
        "type_conflict": F.col("has_type_conflict") & ~F.col("is_partial_any_member"),
        "partial_and_type_conflict": F.col("analysis_cohort") == q.PARTIAL_AND_CONFLICT,
        "nonstandard_or_excluded": ~F.col("sequence_qc_eligible"),
        "length_outlier": F.col("is_length_outlier"),
    }
    rows = q.first_where(metadata, "internal_id", predicates, ["internal_id", "sequence_id"])
    texts = F.create_map(*[F.lit(x) for n, (yes, no) in CHECKS.items() for x in (n, f"{yes}|{no}")])
    both = F.split(F.element_at(texts, F.col("check")), r"\|")
    return rows.withColumn(
        "conclusion", F.when(F.col("internal_id").isNotNull(), both[0]).otherwise(both[1])
    )


def coordinate_spot_checks(coordinates: DataFrame, metadata: DataFrame, status: DataFrame) -> DataFrame:
    """One aligned residue against its sequence, one record with deletions, one insertion."""
    order = F.struct("internal_id", "domain_number", "raw_position")
    ordered = coordinates.withColumn("_order", order)
    picks = q.first_where(
        ordered, "_order",
        {"hmm_residue_identity": ~F.col("is_insertion"), "hmm_insertion": F.col("is_insertion")},
        ["internal_id", "raw_position", "residue"],
    )
    deleted = q.first_where(
        status, "internal_id", {"hmm_deletion": F.col("n_deleted_match_states") > 0}, ["internal_id"]
    )
    everything = picks.unionByName(deleted, allowMissingColumns=True)
    # Three rows at most, so the sequences are looked up by a broadcast of these rows.
    joined = metadata.select("internal_id", "sequence_id", "sequence").join(
        F.broadcast(everything), "internal_id", "right"
    )
    same = F.substring(F.col("sequence"), F.col("raw_position"), F.lit(1)) == F.col("residue")
    return joined.select(
        "check", "internal_id", "sequence_id",
        F.when(F.col("internal_id").isNull(), "none found")
        .when((F.col("check") == "hmm_residue_identity") & ~same, "residue disagrees with the sequence")
        .when(F.col("check") == "hmm_residue_identity", "residue agrees with the sequence")
        .otherwise("found").alias("conclusion"),
    )


def structure_spot_checks(residues: DataFrame) -> DataFrame:
    """One residue with a model and a match state, and one without a model, from a residue map as text."""
    modelled = F.col("modeled") == "True"
    ordered = residues.withColumn("_order", F.struct("structure", F.col("deposited_position").try_cast("int")))
    picks = q.first_where(
        ordered, "_order",
        {"structure_modeled": modelled & (F.col("hmm_match_state") != ""), "structure_unmodeled": ~modelled},
        ["structure", "deposited_position", "residue", "pdb_residue_number", "hmm_match_state"],
    )
    place = F.concat(F.lit("position "), "deposited_position", F.lit(" ("), "residue", F.lit(")"))
    with_model = F.concat(place, F.lit(": model residue "), "pdb_residue_number", F.lit(", match state "), "hmm_match_state")
    return picks.select(
        "check", F.col("structure").alias("internal_id"), F.col("structure").alias("sequence_id"),
        F.when(F.col("structure").isNull(), "none found").when(F.col("check") == "structure_modeled", with_model)
        .otherwise(F.concat(place, F.lit(": no model"))).alias("conclusion"),
    )


def render_spot_checks(rows: list[dict[str, Any]], dataset: str, split: str) -> str:
    lines = ["# Spot checks", "", f"Dataset `{dataset}`, split `{split}`.", ""]
    lines += markdown_table(rows, ["check", "internal_id", "sequence_id", "conclusion"])
    return "\n".join([*lines, ""])


def render_validation(errors: list[str], notes: list[str], sensitivity: list[dict[str, Any]]) -> str:
    """Errors, notes and the threshold table of a release, as Markdown."""
    listed = lambda items: [f"- {item}" for item in items] or ["- None."]
    lines = ["# Release check", "", "## Notes", "", *listed(notes), "", "## Errors", "", *listed(errors), ""]
    if sensitivity:
        columns = ["name", "n_clusters", "max_cluster_size", "n_singletons", "agreement"]
        lines += ["## Threshold sensitivity", "", *markdown_table(sensitivity, columns), ""]
    return "\n".join(lines)
