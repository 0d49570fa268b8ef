"""Annotation of records from profile-search hits: states, coordinates and coverage.

The search itself is an outside program. Its hits enter as tables with the
schema below, one row per record and search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as al
from ..functions import rules
from ..operators import constraints as c

# Fields of a hit and of its domains.
HIT_SCHEMA = """
    internal_id string, score_bits double, evalue double, included boolean, reported boolean,
    domains array<struct<score_bits: double, i_evalue: double, included: boolean,
      reported: boolean, hmm_from: int, hmm_to: int, target_from: int, target_to: int,
      hmm_sequence: string, target_sequence: string>>"""

MAPPED = ("accepted", "multi_hit")


@dataclass(frozen=True)
class ProfileModel:
    """Length and cutoffs of one profile. ``boundary`` is a distance in bits."""

    length: int
    sequence_cutoff: float
    domain_cutoff: float
    boundary: float = 2.0

    def __post_init__(self):
        if not self.boundary >= 0 or self.boundary == float("inf"):
            raise ValueError("boundary distance must be finite and nonnegative")


def hit_violations(hits: DataFrame, records: DataFrame) -> DataFrame:
    """One hit per record and search, and no hit for an unknown record."""
    unknown = hits.select("internal_id").join(records.select("internal_id"), "internal_id", "left_anti")
    return c.all_violations(
        [
            c.unique_key(hits, ["internal_id"], "duplicate hit"),
            c.violation(unknown, "unknown record", F.col("internal_id"), ""),
        ]
    )


def _aligned(sequence: Column, model: ProfileModel) -> Column:
    """Included domains with their number, coordinates and first broken rule."""
    included = F.filter(F.coalesce("cutoff_domains", F.array()), lambda d: d["included"])
    return al.aligned_domains(included, sequence, model.length)


def scan_records(
    records: DataFrame, cutoff_hits: DataFrame, permissive_hits: DataFrame, model: ProfileModel
) -> DataFrame:
    """State and aligned domains per record. Two joins on unique ids; the rest is row-local,

    so a record with a broken alignment fails alone and leaves no coordinates behind.
    """
    joined = records.join(
        cutoff_hits.select(
            "internal_id", F.lit(True).alias("has_cutoff_hit"),
            F.col("score_bits").alias("cutoff_score"), F.col("domains").alias("cutoff_domains"),
        ),
        "internal_id", "left",
    ).join(
        permissive_hits.select(
            "internal_id", F.col("score_bits").alias("permissive_score"),
            F.array_max(F.transform("domains", lambda d: d["score_bits"])).alias("permissive_best"),
        ),
        "internal_id", "left",
    )
    located = joined.withColumn("domains", _aligned(F.col("sequence"), model))
    first_error = F.array_compact(F.transform("domains", lambda d: d["error"]))
    state = rules.classify_hit(
        F.coalesce("has_cutoff_hit", F.lit(False)), F.size("domains"),
        F.col("permissive_score"), F.col("permissive_best"),
        model.sequence_cutoff, model.domain_cutoff, model.boundary,
    )
    judged = located.withColumn("_state", state).withColumn(
        "failure_reason",
        F.when(F.col("_state").isin(*MAPPED), F.try_element_at(first_error, F.lit(1))),
    )
    kept = judged.withColumn(
        "status", F.when(F.col("failure_reason").isNotNull(), "failed").otherwise(F.col("_state"))
    ).withColumns(
        {
            "n_ga_domains": F.size("domains"),
            "mapped": F.when(F.col("status").isin(*MAPPED), F.col("domains")).otherwise(
                F.filter("domains", lambda d: F.lit(False))
            ),
        }
    )
    cells = F.flatten(F.transform("mapped", lambda d: d["cells"]))
    positions = F.array_distinct(F.transform(cells, lambda x: x["raw_position"]))
    states = al.match_states(cells)
    deleted = F.array_distinct(F.flatten(F.transform("mapped", lambda d: d["deleted"])))
    counted = kept.withColumns(
        {
            "ga_sequence_bits": F.lit(model.sequence_cutoff),
            "ga_domain_bits": F.lit(model.domain_cutoff),
            "best_score_bits": F.coalesce("cutoff_score", "permissive_score"),
            "n_mapped_residues": F.size(positions),
            "n_match_states": F.size(states),
            "n_deleted_match_states": F.size(deleted),
        }
    )
    share = lambda n, total: F.when(F.col(n) > 0, F.col(n) / total)
    return counted.withColumns(
        {
            "residue_coverage": share("n_mapped_residues", F.length("sequence")),
            "hmm_coverage": share("n_match_states", F.lit(model.length)),
            "is_partial_or_conflict": ~F.col("primary_analysis_eligible"),
        }
    )


# Columns of the status table and of the coordinate map.
STATUS_FIELDS = [
    "internal_id", "sequence_sha256", "split", "analysis_cohort", "is_partial_or_conflict", "status",
    "ga_sequence_bits", "ga_domain_bits", "best_score_bits", "n_ga_domains", "n_mapped_residues",
    "n_match_states", "n_deleted_match_states", "residue_coverage", "hmm_coverage",
]
COORDINATE_FIELDS = [
    "internal_id", "sequence_sha256", "split", "analysis_cohort", "domain_number", "raw_position",
    "residue", "hmm_match_state", "is_insertion",
]


def status_table(scanned: DataFrame) -> DataFrame:
    return scanned.select(*STATUS_FIELDS)


def coordinate_map(scanned: DataFrame) -> DataFrame:
    """One row per aligned residue of every record that kept its domains."""
    head = ["internal_id", "sequence_sha256", "split", "analysis_cohort"]
    domains = scanned.select(*head, F.explode("mapped").alias("d"))
    cells = domains.select(*head, F.col("d.number").alias("domain_number"), F.inline("d.cells"))
    return cells.withColumnRenamed("match_state", "hmm_match_state").select(*COORDINATE_FIELDS)


def failures(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("failure_reason").isNotNull()).select(
        "internal_id", F.col("failure_reason").alias("reason")
    )


def raw_hits(cutoff_hits: DataFrame, permissive_hits: DataFrame) -> DataFrame:
    """Both searches as nested rows for a JSON-lines sink."""

    def tagged(hits: DataFrame, search: str) -> DataFrame:
        fields = [f for f in hits.columns if f != "internal_id"]
        return hits.select("internal_id", F.lit(search).alias("search"), F.struct(*fields).alias("hit"))

    return tagged(cutoff_hits, "gathering").unionByName(tagged(permissive_hits, "permissive_T0_domT0"))


def scan_summary(scanned: DataFrame) -> DataFrame:
    """Records per split and state."""
    return scanned.groupBy("split", "status").agg(F.count(F.lit(1)).alias("n"))


def coverage_summary(scanned: DataFrame) -> DataFrame:
    """Mapped residues, occupied states and all residues, summed per split."""
    return scanned.groupBy("split").agg(
        F.sum("n_mapped_residues").alias("accepted_residues"),
        F.sum("n_match_states").alias("accepted_match_states"),
        F.sum(F.length("sequence")).alias("sequence_residues"),
    )


def reconciled(statuses: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Counts of the status table against the coordinate map, one row per record."""
    details = {
        "n_mapped_residues": coordinates.select("internal_id", "raw_position"),
        "n_match_states": coordinates.select("internal_id", "hmm_match_state"),
    }
    return c.reconcile_counts(statuses, details, "internal_id")


def finished_violations(
    statuses: DataFrame, coordinates: DataFrame, records: DataFrame, states: int, splits: tuple[str, ...]
) -> DataFrame:
    """What is wrong with a finished scan: its records, states, residues and counts."""
    name = F.col("internal_id")
    owners = statuses.filter(F.col("status").isin(*MAPPED)).select("internal_id")
    wrong = reconciled(statuses, coordinates).filter("state <> 'agrees'")
    return c.all_violations(
        [
            c.unique_key(statuses, ["internal_id"], "status key"),
            c.set_difference(statuses, records, "internal_id"),
            c.agreement(statuses, records, "internal_id", ["sequence_sha256"]),
            c.check(statuses, "split name", F.col("split").isNull() | ~F.col("split").isin(*splits), name),
            c.violation(
                coordinates.select("internal_id").distinct().join(owners, "internal_id", "left_anti"),
                "coordinates without a mapped record", name, "",
            ),
            c.coordinate_integrity(
                coordinates, records, "internal_id", "raw_position", "residue", "sequence",
                ["internal_id", "domain_number"], "hmm_match_state", states,
            ),
            c.check(
                coordinates, "insertion flag", F.col("is_insertion") != F.col("hmm_match_state").isNull(),
                F.concat_ws(":", "internal_id", F.col("raw_position").cast("string")),
            ),
            c.violation(wrong, "stored counts", name, F.col("state")),
        ]
    )


def handoff_violations(
    metadata: DataFrame, fasta: DataFrame, manifest: DataFrame, splits: tuple[str, ...]
) -> DataFrame:
    """Every rule the inputs of a scan must keep, as one table of violations."""
    eligible = metadata.filter("sequence_qc_eligible")
    described = eligible.join(
        fasta.select("internal_id", F.col("sequence").alias("fasta_sequence")), "internal_id"
    )
    leaking = (
        manifest.groupBy(F.col("homology_cluster").alias("cluster"))
        .agg(F.min("split").alias("a"), F.max("split").alias("b"))
        .filter("a <> b")
    )
    name = F.col("internal_id")
    return c.all_violations(
        [
            c.unique_key(metadata, ["internal_id"], "metadata key"),
            c.unique_key(fasta, ["internal_id"], "FASTA key"),
            c.set_difference(eligible, fasta, "internal_id"),
            c.sequence_identity(eligible, "internal_id", "sequence", "sequence_length", "sequence_sha256"),
            c.check(described, "sequence identity", ~F.col("sequence").eqNullSafe(F.col("fasta_sequence")), name, "FASTA"),
            c.partition_coverage(eligible, manifest, "internal_id"),
            c.check(
                manifest, "split name or cluster",
                F.col("split").isNull() | ~F.col("split").isin(*splits)
                | (F.coalesce("homology_cluster", F.lit("")) == ""), name,
            ),
            c.agreement(manifest, eligible, "internal_id", ["analysis_cohort", "primary_analysis_eligible"]),
            c.leakage(leaking),
        ]
    )
