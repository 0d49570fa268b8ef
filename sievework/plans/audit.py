"""Audit of nested records: flags, duplicates, cohorts, outliers and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import constraints as c
from ..operators import quality as q
from ..operators.duplicates import mark_exact_duplicates, mark_shared_ids

# The fields a record must have.
REQUIRED = [
    "unique_sequence_id", "sequence", "representative_annotation",
    "cluster_statistics", "redundant_members_details",
]

RECORD_SCHEMA = (
    "unique_sequence_id string, sequence string, "
    "representative_annotation map<string,string>, "
    "cluster_statistics map<string,string>, "
    "redundant_members_details array<map<string,string>>"
)

# A JSON null in a text field is written as this word, as the audit always has.
NULL_WORD = "None"


@dataclass(frozen=True)
class AuditProfile:
    """What the audited family is called. ``family`` names the type columns."""

    id_prefix: str
    family: str
    target_type: str
    watched_type: str
    partial_word: str = "partial"
    alphabet: str = t.CANONICAL_RESIDUES
    sigmas: float = 3.0

    @property
    def types_field(self) -> str:
        return f"{self.family}_types"

    def metadata_fields(self) -> list[str]:
        # Column names and their order.
        return [
            "internal_id", "sequence_id", "accession", "sequence", "sequence_length",
            "sequence_sha256", "organism", "description", "source_file", "representative_gene",
            f"representative_{self.family}_types", "member_count", "redundant_member_count",
            f"member_{self.family}_types", "is_partial_representative", "is_partial_any_member",
            "has_type_conflict", f"has_{self.watched_type.lower()}_member", "source_missing",
            "organism_missing", "nonstandard_residues", "is_exact_duplicate",
            "exact_duplicate_of", "is_length_outlier", "sequence_qc_eligible",
            "primary_analysis_eligible", "analysis_cohort", "exclusion_reason",
        ]

    def member_fields(self) -> list[str]:
        # Column names and their order.
        return [
            "representative_internal_id", "representative_sequence_id", "member_id",
            "organism", "description", "source_file", "gene", f"{self.family}_types",
            "is_partial",
        ]


def parse_records(raw: DataFrame, record: str = "record") -> DataFrame:
    """Parse (ordinal, JSON text) rows; annotations become maps, so open fields survive. Other columns stay."""
    return raw.select(
        *[name for name in raw.columns if name != record],
        F.json_object_keys(record).alias("present"),
        F.from_json(record, RECORD_SCHEMA).alias("r"),
    ).select("*", "r.*").drop("r")


def _count(stats: Column, name: str) -> Column:
    return F.try_element_at(stats, F.lit(name)).try_cast("int")


def record_violations(records: DataFrame) -> DataFrame:
    """Missing fields, fields of the wrong kind and counts that disagree with the members."""
    has = {name: F.coalesce(F.array_contains("present", name), F.lit(False)) for name in REQUIRED}
    members, stats = F.col("redundant_members_details"), F.col("cluster_statistics")
    total, redundant = _count(stats, "total_original_sequences"), _count(stats, "redundant_count")
    rules = [(f"missing required field {name}", ~has[name]) for name in REQUIRED]
    rules += [
        (f"{name} must be an object", has[name] & F.col(name).isNull())
        for name in ("representative_annotation", "cluster_statistics")
    ]
    rules += [
        (
            "redundant_members_details must be a list of objects",
            has["redundant_members_details"]
            & (members.isNull() | F.exists(members, lambda m: m.isNull())),
        ),
        ("invalid cluster statistics", stats.isNotNull() & (total.isNull() | redundant.isNull())),
        (
            "cluster statistics disagree with redundant_members_details",
            (total != F.size(members) + 1) | (redundant != F.size(members)),
        ),
    ]
    return c.check_all(records, F.col("ordinal"), rules)


def field(annotation: Column, name: str) -> Column:
    """A field as text: absent gives an empty string, JSON null gives the null word."""
    value = F.try_element_at(annotation, F.lit(name))
    present = F.coalesce(F.map_contains_key(annotation, name), F.lit(False))
    return F.coalesce(value, F.when(present, F.lit(NULL_WORD)), F.lit(""))


def _unset(annotation: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(annotation, F.lit(name)), F.lit("")) == ""


def is_partial(annotation: Column, word: str) -> Column:
    text = F.concat_ws(" ", field(annotation, "description"), field(annotation, "full_header"))
    return t.has_word(text, word)


def _identity(profile: AuditProfile) -> list[Column]:
    return [
        t.ordinal_id(profile.id_prefix, F.col("ordinal")).alias("internal_id"),
        t.strip_text(F.coalesce("unique_sequence_id", F.lit(NULL_WORD))).alias("sequence_id"),
    ]


def audit_records(records: DataFrame, profile: AuditProfile) -> DataFrame:
    """One typed row per record with every flag. ``records`` comes from ``parse_records``.

    ``ordinal`` is unique. Flags are row-local, but for repeated digests and
    identifiers: these are found on (ordinal, digest, identifier) alone, and the
    rows they name are attached in one join. The outlier limits are scalars.
    """
    p = profile
    rep, members = F.col("representative_annotation"), F.col("redundant_members_details")
    raw_types = lambda a: F.try_element_at(a, F.lit(p.types_field))
    flagged = records.select(
        "ordinal",
        *_identity(p),
        t.normalise_sequence(F.coalesce("sequence", F.lit(NULL_WORD))).alias("sequence"),
        *[
            t.strip_text(field(rep, source)).alias(name)
            for name, source in [
                ("accession", "id"), ("organism", "organism"), ("description", "description"),
                ("source_file", "source_file"), ("representative_gene", "gene"),
            ]
        ],
        t.split_types(raw_types(rep)).alias("representative_types"),
        _count(F.col("cluster_statistics"), "total_original_sequences").alias("member_count"),
        _count(F.col("cluster_statistics"), "redundant_count").alias("redundant_member_count"),
        t.split_type_set(F.transform(F.concat(F.array(rep), members), raw_types)).alias("member_types"),
        is_partial(rep, p.partial_word).alias("is_partial_representative"),
        F.exists(members, lambda m: is_partial(m, p.partial_word)).alias("_partial_member"),
        (_unset(rep, "source_file") | F.exists(members, lambda m: _unset(m, "source_file"))).alias(
            "source_missing"
        ),
        _unset(rep, "organism").alias("organism_missing"),
        F.size(members).alias("member_rows"),
    ).withColumns(
        {
            "sequence_length": F.length("sequence"),
            "sequence_sha256": t.sha256(F.col("sequence")),
            "nonstandard_residues": t.outside_alphabet(F.col("sequence"), p.alphabet),
            "is_partial_any_member": F.col("is_partial_representative") | F.col("_partial_member"),
            "has_type_conflict": F.exists(
                "member_types", lambda x: F.lower(x) != p.target_type.lower()
            ),
            "has_watched_member": F.exists(
                "member_types", lambda x: F.lower(x) == p.watched_type.lower()
            ),
        }
    )
    first_id = F.when(F.col("sequence_id") != "", F.col("sequence_id")).otherwise(
        F.concat(F.lit("record_"), F.col("ordinal"))
    )
    narrow = flagged.select("ordinal", "sequence_id", "sequence_sha256")
    found = mark_shared_ids(
        mark_exact_duplicates(narrow, "sequence_sha256", "ordinal", first_id),
        ["sequence_id"], F.col("ordinal"), "is_duplicate_id", counted=narrow,
    ).filter(F.col("exact_duplicate_of").isNotNull() | F.col("is_duplicate_id"))
    marked = flagged.join(
        found.select("ordinal", "exact_duplicate_of", "is_duplicate_id"), "ordinal", "left"
    ).withColumn("is_duplicate_id", F.coalesce("is_duplicate_id", F.lit(False)))
    copy = F.col("exact_duplicate_of").isNotNull()
    no_id, empty = F.col("sequence_id") == "", F.col("sequence") == ""
    odd = F.col("nonstandard_residues") != ""
    excluded = odd | no_id | empty | copy | F.col("is_duplicate_id")
    judged = marked.withColumns(
        {
            "is_exact_duplicate": copy,
            "sequence_qc_eligible": ~excluded,
            "analysis_cohort": q.cohort(
                excluded, F.col("is_partial_any_member"), F.col("has_type_conflict")
            ),
            "exclusion_reason": t.join_reasons(
                [
                    (no_id, "missing_sequence_id"),
                    (empty, "empty_sequence"),
                    (odd, F.concat(F.lit("nonstandard_residues:"), F.col("nonstandard_residues"))),
                    (copy, F.concat(F.lit("exact_duplicate_of:"), F.col("exact_duplicate_of"))),
                    (F.col("source_missing"), "source_missing"),
                    (F.col("is_duplicate_id"), "duplicate_sequence_id"),
                ],
                ";",
            ),
        }
    ).withColumn("primary_analysis_eligible", F.col("analysis_cohort") == q.PRIMARY)
    return judged.drop("_partial_member")


def with_outliers(audited: DataFrame, profile: AuditProfile) -> DataFrame:
    """Add the length-outlier flag. Materialise ``audited`` first: it is read twice."""
    return q.mark_length_outliers(
        audited, "sequence_length", F.col("sequence_qc_eligible"), profile.sigmas
    )


def metadata_table(audited: DataFrame, profile: AuditProfile) -> DataFrame:
    """The metadata table as text columns, ready for a strict CSV."""
    flags = {name for name, kind in audited.dtypes if kind == "boolean"}
    special = {
        f"representative_{profile.family}_types": F.array_join("representative_types", "|"),
        f"member_{profile.family}_types": F.array_join("member_types", "|"),
        f"has_{profile.watched_type.lower()}_member": t.bool_text(F.col("has_watched_member")),
    }

    def cell(name: str) -> Column:
        if name in special:
            return special[name]
        if name in flags:
            return t.bool_text(F.col(name))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return audited.select(*[cell(name).alias(name) for name in profile.metadata_fields()])


def member_table(records: DataFrame, profile: AuditProfile) -> DataFrame:
    """One row per redundant member, straight from the parsed records: row-local, without a shuffle."""
    m = F.col("m")
    return records.select(*_identity(profile), F.explode("redundant_members_details").alias("m")).select(
        F.col("internal_id").alias("representative_internal_id"),
        F.col("sequence_id").alias("representative_sequence_id"),
        t.strip_text(field(m, "id")).alias("member_id"),
        *[t.strip_text(field(m, n)).alias(n) for n in ("organism", "description", "source_file", "gene")],
        F.array_join(t.split_types(F.try_element_at(m, F.lit(profile.types_field))), "|").alias(
            profile.types_field
        ),
        t.bool_text(is_partial(m, profile.partial_word)).alias("is_partial"),
    )


def audit_summary(audited: DataFrame, profile: AuditProfile) -> DataFrame:
    """Every count of the audit in one pass over the typed rows; one row.

    Only ``sequence_id`` needs a distinct count: internal identifiers follow from the
    unique ordinals, and every digest has one row that is no copy.
    """
    flag = lambda name: F.count_if(F.col(name)).alias(name)
    eligible = F.col("sequence_qc_eligible")
    length = F.when(eligible, F.col("sequence_length"))
    return audited.agg(
        F.count(F.lit(1)).alias("candidate_records"),
        F.sum("member_count").alias("total_original_sequence_records"),
        F.sum("member_rows").alias("redundant_member_records"),
        F.count_distinct("sequence_id").alias("unique_sequence_ids"),
        F.count("internal_id").alias("unique_internal_ids"),
        F.count_if(~F.col("is_exact_duplicate")).alias("unique_sequence_hashes"),
        flag("sequence_qc_eligible"),
        F.count_if(F.col("analysis_cohort") == q.PRIMARY).alias("primary_cohort"),
        *[
            F.count_if(F.col("analysis_cohort") == name).alias(f"cohort_{name}")
            for name in q.COHORT_LABELS
        ],
        F.count_if("is_partial_representative").alias("partial_representative"),
        F.count_if("is_partial_any_member").alias("partial_any_member"),
        F.count_if("has_type_conflict").alias("type_conflict"),
        F.count_if("has_watched_member").alias("watched_member"),
        flag("source_missing"),
        flag("organism_missing"),
        F.count_if(F.col("nonstandard_residues") != "").alias("nonstandard_sequence"),
        F.count_if("is_exact_duplicate").alias("exact_duplicate_sequence"),
        F.count_if("is_duplicate_id").alias("duplicate_sequence_id_records"),
        F.min(length).alias("length_minimum"),
        F.max(length).alias("length_maximum"),
        F.avg(length).alias("length_mean"),
        F.stddev_pop(length).alias("length_population_std"),
        F.count_if("is_length_outlier").alias("length_outlier_count"),
    ).withColumns(
        {
            "outlier_lower_exclusive": F.col("length_mean") - profile.sigmas * F.col("length_population_std"),
            "outlier_upper_exclusive": F.col("length_mean") + profile.sigmas * F.col("length_population_std"),
        }
    )
