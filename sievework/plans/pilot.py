"""Pilot selection, parsing of scan results under frozen rules, and the group report."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t
from ..operators import constraints as c
from ..operators import selection as sel
from ..operators.duplicates import split_preferred_copies
from ..operators.labels import group_summary, label_violations
from ..operators.ranking import seeded_rank
from ..session import materialise
from .audit import _unset, field, is_partial

PASSED = "pass_pilot_screen"
NOT_PARTIAL = "not_detected_not_proof_of_completeness"


@dataclass(frozen=True)
class PilotProfile:
    """Names of the family and of the three sample groups: clear, conflicting, background."""

    family: str
    target_tag: str
    groups: tuple[str, str, str]
    id_prefix: str = "PILOT_"
    shortest: int = 40
    longest: int = 800
    alphabet: str = t.CANONICAL_RESIDUES


RECORD_SCHEMA = (
    "unique_sequence_id string, sequence string, representative_annotation map<string,string>, "
    "redundant_members_details array<map<string,string>>"
)


def parse_records(raw: DataFrame) -> DataFrame:
    return raw.select(
        "input", "ordinal", F.json_object_keys("record").alias("present"),
        F.from_json("record", RECORD_SCHEMA).alias("r"),
    ).select("input", "ordinal", "present", "r.*")


def schema_violations(records: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "input", F.col("ordinal").cast("string"))
    has = lambda name: F.coalesce(F.array_contains("present", name), F.lit(False))
    members = F.col("redundant_members_details")
    bad_members = has("redundant_members_details") & (
        members.isNull() | F.exists(members, lambda m: m.isNull())
    )
    return c.check_all(
        records, key,
        [
            ("unsupported schema", ~has("sequence") | ~has("representative_annotation")),
            ("invalid annotation object/list",
             (has("representative_annotation") & F.col("representative_annotation").isNull()) | bad_members),
            ("sequence must be string", has("sequence") & F.col("sequence").isNull()),
        ],
    )


def field_names(records: DataFrame) -> DataFrame:
    """The union of top-level and annotation keys per input."""
    top = records.select("input", F.lit("record").alias("level"), F.explode("present").alias("name"))
    inner = records.select(
        "input", F.lit("annotation").alias("level"),
        F.explode(F.map_keys("representative_annotation")).alias("name"),
    )
    return top.unionByName(inner).distinct()


def _tags(annotation: Column, family: str) -> Column:
    types = F.coalesce(F.try_element_at(annotation, F.lit(f"{family}_types")), F.lit(""))
    text = F.concat_ws(" ", types, field(annotation, "gene"), field(annotation, "description"))
    return t.mine_type_tags(text, family)


def screen(records: DataFrame, profile: PilotProfile, background: Column) -> DataFrame:
    """Ordered screening reasons per record. Sequences are judged as they are, never repaired."""
    p = profile
    rep = F.col("representative_annotation")
    members = F.coalesce("redundant_members_details", F.array().cast("array<map<string,string>>"))
    everyone = F.concat(F.array(rep), members)
    seq = F.col("sequence")
    odd = t.outside_alphabet(seq, p.alphabet)
    prepared = records.select(
        F.when(t.non_blank(F.col("unique_sequence_id")), F.col("unique_sequence_id"))
        .otherwise(F.coalesce(F.try_element_at(rep, F.lit("id")), F.lit("")))
        .alias("original_accession"),
        F.col("input").alias("input_json"),
        F.col("ordinal").alias("source_record_index"),
        "sequence",
        F.coalesce(F.try_element_at(rep, F.lit("source_file")), F.lit("")).alias("source_file"),
        F.coalesce(F.try_element_at(rep, F.lit("organism")), F.lit("")).alias("organism"),
        F.length(seq).alias("sequence_length"),
        F.coalesce(F.try_element_at(rep, F.lit("description")), F.lit("")).alias("original_annotation"),
        t.sha256(seq).alias("sequence_sha256"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(everyone, lambda a: _tags(a, p.family))))).alias("tags"),
        F.exists(everyone, lambda a: is_partial(a, "partial")).alias("_partial"),
        (_unset(rep, "organism") | _unset(rep, "source_file")).alias("_unset"),
        background.alias("_background"),
        odd.alias("_odd"),
        t.is_low_complexity(seq).alias("_low"),
    )
    alone = (F.size("tags") == 1) & F.array_contains("tags", p.target_tag)
    ambiguous = F.array_contains("tags", p.target_tag) | (F.size("tags") != 1)
    reasons = t.join_reasons(
        [
            (F.col("sequence") == "", "empty_sequence"),
            (F.col("_odd") != "", F.concat(F.lit("invalid_residues:'"), F.col("_odd"), F.lit("'"))),
            (~F.col("sequence_length").between(p.shortest, p.longest), "pilot_length_outside_40_800"),
            (F.col("_partial"), "partial_in_representative_or_member"),
            ((F.col("original_accession") == "") | F.col("_unset") | (F.size("tags") == 0),
             "insufficient_annotation"),
            (F.col("_low"), "low_complexity_single_residue_over_60_percent"),
            (F.col("_background") & ambiguous, "background_not_unambiguous_nonA"),
        ],
        "|",
    )
    return prepared.withColumns(
        {
            "sample_group": F.when(F.col("_background"), p.groups[2])
            .when(alone, p.groups[0]).otherwise(p.groups[1]),
            "partial_status": F.when(F.col("_partial"), "detected").otherwise(NOT_PARTIAL),
            "source_types": F.array_join("tags", "|"),
            "qc_status": F.lit(PASSED),
            "reason": reasons,
        }
    ).drop("tags", "_partial", "_unset", "_background", "_odd", "_low")


def select_pilot(
    screened: DataFrame, profile: PilotProfile, targets: tuple[int, int, int], seed: int
) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, excluded rows). Fails if nothing is usable.

    Ranks come from a seeded hash of (input, ordinal), so pools of any size work alike.
    """
    if min(targets) < 0 or not sum(targets):
        raise ValueError("Targets must be nonnegative with nonzero total")
    passed = screened.filter(F.col("reason") == "").drop("reason")
    identity = F.concat_ws("#", "input_json", F.col("source_record_index").cast("string"))
    passed = passed.withColumn("row_id", identity)
    ranked = seeded_rank(passed, ["row_id"], seed)
    ranked = materialise(ranked.withColumn("_later", F.col("sample_group") == profile.groups[2]))
    kept, copies = split_preferred_copies(ranked, "sequence_sha256", ["_later", "rank"], "row_id")
    quotas = dict(zip(profile.groups, targets))
    columns = sel.PoolColumns(identity="row_id")
    chosen, rejected = sel.diversity_select(kept, quotas, columns)
    if chosen.isEmpty():
        raise ValueError("No usable sequences selected")
    described = passed.join(chosen.withColumnRenamed("identity", "row_id").drop("grp"), "row_id")
    manifest = described.withColumns(
        {
            "internal_id": t.ordinal_id(profile.id_prefix, F.col("selection_order"), 4),
            "selection_reason": F.lit(
                "seeded diversity across organism/type/25aa bins/source; "
                "passed approximate near-duplicate screen"
            ),
        }
    ).drop("row_id", "selection_order")
    names = passed.select(F.col("row_id").alias("related"), F.col("original_accession").alias("related_accession"))
    why = rejected.select(F.col("identity").alias("row_id"), "reason", F.col("related_accession").alias("related")).unionByName(
        copies.select("row_id", F.lit(sel.DUPLICATE).alias("reason"), F.col("related_accession").alias("related"))
    )
    unselected = passed.join(why, "row_id").join(names, "related", "left").select(
        "original_accession", "input_json", "source_record_index", "reason",
        F.when(F.col("reason") == sel.DUPLICATE, F.col("sequence_sha256"))
        .when(F.col("reason") == sel.NEAR, "matching_blocks/min_length>=0.9;min_length/max_length>=0.8")
        .otherwise("near-duplicate status not exhaustively assessed").alias("evidence"),
        F.coalesce("related_accession", F.lit("")).alias("related_accession"),
    )
    failed = screened.filter(F.col("reason") != "").select(
        "original_accession", "input_json", "source_record_index", "reason",
        F.col("original_annotation").alias("evidence"), F.lit("").alias("related_accession"),
    )
    return manifest, failed.unionByName(unselected)


def pilot_violations(manifest: DataFrame, fasta: DataFrame) -> DataFrame:
    """Manifest and FASTA must pair one to one with equal, distinct, canonical sequences."""
    joined = manifest.select("internal_id", "sequence_length", "sequence_sha256").join(
        fasta, "internal_id"
    )
    return c.all_violations(
        [
            c.unique_key(manifest, ["internal_id"], "manifest id"),
            c.set_difference(manifest, fasta, "internal_id"),
            c.sequence_identity(joined, "internal_id", "sequence", "sequence_length", "sequence_sha256"),
            c.check(joined, "alphabet", ~t.only_alphabet(F.col("sequence")), F.col("internal_id")),
            c.unique_key(manifest, ["sequence_sha256"], "duplicate selected sequence"),
        ]
    )


def _whole(col: Column) -> Column:
    return col.try_cast("int")


def parse_hits(
    proteins: DataFrame, manifest: DataFrame, rules: r.HitRules, accession: str, database: str,
    version: str, kind: str = "hmmer3",
) -> DataFrame:
    """Per submitted record: result present, its first parse error, and its judged hits.

    Matches are judged inside the row; only the join to the manifest shuffles.
    """
    found = proteins.select(F.explode("xref._id").alias("internal_id"), "sequence", "matches").withColumn(
        "result_present", F.lit(True)
    )
    joined = manifest.select(
        "internal_id", F.col("sequence").alias("expected"), "sample_group", "qc_status",
        "partial_status", "sequence_sha256",
    ).join(found, "internal_id", "left")
    text = F.coalesce(t.strip_text(F.col("sequence._VALUE")), F.lit(""))
    listed = F.col("matches").getField(f"{kind}-match")
    matches = F.coalesce(listed, F.array())
    size = F.length("expected")

    def release(m: Column) -> Column:
        return m["signature"]["signature-library-release"]

    wrong_release = lambda m: ~(
        F.coalesce(F.upper(release(m)["_library"]) == database.upper(), F.lit(False))
        & F.coalesce(release(m)["_version"] == version, F.lit(False))
    )
    target = F.filter(matches, lambda m: m["signature"]["_ac"] == accession)
    locations = lambda m: m["locations"].getField(f"{kind}-location")

    def hit(m: Column, loc: Column) -> Column:
        start, end = _whole(loc["_start"]), _whole(loc["_end"])
        hs, he, hl = (_whole(loc[f"_hmm-{x}"]) for x in ("start", "end", "length"))
        has_hmm = (
            loc["_hmm-start"].isNotNull() & loc["_hmm-end"].isNotNull() & loc["_hmm-length"].isNotNull()
        )
        hmm_coverage = F.when(has_hmm, r.coverage(hs, he, hl))
        length = r.interval_length(start, end)
        reasons = r.review_reasons(
            r.parse_nonnegative(m["_evalue"]), r.parse_nonnegative(loc["_evalue"]), hmm_coverage,
            length, rules,
        )
        problem = (
            F.when(~r.inside(start, end, size), "Invalid residue coordinates")
            .when(r.bad_number(m["_evalue"]) | r.bad_number(loc["_evalue"]),
                  "Invalid nonnegative numeric field")
            .when(has_hmm & ~r.inside(hs, he, hl), "Invalid HMM coordinates")
        )
        return F.struct(
            m["signature"]["_ac"].alias("signature_accession"),
            F.coalesce(m["signature"]["_name"], F.lit("")).alias("signature_name"),
            F.coalesce(m["signature"]["entry"]["_ac"], F.lit("")).alias("interpro_accession"),
            start.alias("start"), end.alias("end"),
            F.coalesce(m["_score"], F.lit("")).alias("score"),
            F.coalesce(m["_evalue"], F.lit("")).alias("evalue"),
            F.coalesce(loc["_evalue"], F.lit("")).alias("domain_evalue"),
            length.alias("hit_length"), r.coverage(start, end, size).alias("sequence_coverage"),
            hmm_coverage.alias("hmm_coverage"), r.hit_status(reasons).alias("hit_status"),
            reasons.alias("review_reason"), problem.alias("problem"),
        )

    hits = F.flatten(
        F.transform(target, lambda m: F.transform(F.coalesce(locations(m), F.array()), lambda x: hit(m, x)))
    )
    judged = joined.withColumn("hits", hits)
    digest = F.coalesce(F.lower("sequence._md5"), F.lit(""))
    error = (
        F.when((text != F.col("expected")) | ((digest != "") & (digest != F.md5(text))),
               "XML sequence or MD5 differs from submitted input")
        .when(F.col("matches").isNull(), "Missing matches container; completeness unknown")
        .when(F.exists(matches, lambda m: m["signature"].isNull()), "Missing signature")
        .when(F.exists(matches, wrong_release), "Unexpected or mixed signature database/version")
        .when(F.exists(target, lambda m: F.coalesce(F.size(locations(m)), F.lit(0)) <= 0),
              "Target signature has no locations")
        .otherwise(
            F.try_element_at(
                F.array_compact(F.transform("hits", lambda h: h["problem"])), F.lit(1)
            )
        )
    )
    present = F.coalesce("result_present", F.lit(False))
    return judged.withColumns(
        {"result_present": present, "parse_error": F.when(present, error)}
    ).withColumn(
        "hits",
        F.when(F.col("result_present") & F.col("parse_error").isNull(), F.col("hits")).otherwise(
            F.filter("hits", lambda h: F.lit(False))
        ),
    )


def xref_violations(proteins: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every protein has an id, and each id is known and used once."""
    ids = proteins.select(F.explode("xref._id").alias("internal_id"))
    unknown = ids.join(manifest.select("internal_id"), "internal_id", "left_anti")
    return c.all_violations(
        [
            c.check(proteins, "protein missing ID", F.coalesce(F.size("xref"), F.lit(0)) <= 0, F.lit("")),
            c.violation(unknown, "unknown XML ID", F.col("internal_id"), ""),
            c.unique_key(ids, ["internal_id"], "duplicate XML ID"),
        ]
    )


def global_state(receipt: dict[str, Any], result_exists: bool) -> str:
    """The state that an unfinished run gives to all its records; '' if it finished."""
    if receipt.get("submitted") is not True:
        return "not_submitted"
    if receipt.get("exit_code") != 0 or receipt.get("scan_status") != "completed":
        return "failed"
    return "" if result_exists else "result_missing"


POSITIVE = "accepted under frozen computational rules"
NEGATIVE = "no qualified hit under this tool, database version and these frozen rules"


def label_records(parsed: DataFrame, error: str = "") -> DataFrame:
    """State, label and reason per record; a blank label is not a negative."""
    hits = F.size("hits")
    review = F.size(F.filter("hits", lambda h: h["hit_status"] == "needs_review"))
    eligible = (F.col("qc_status") == PASSED) & (F.col("partial_status") == NOT_PARTIAL)
    state = r.scan_state(
        F.lit(error), F.col("result_present"), F.col("parse_error").isNotNull(), review, hits, eligible
    )
    labelled = parsed.withColumns({"scan_status": state, "submitted": F.lit(error != "not_submitted")})
    label = r.tri_state_label(F.col("scan_status"), hits)
    reason = t.first_match(
        [
            (F.lit(error != ""), error),
            ((F.col("scan_status") == "success") & (hits > 0), POSITIVE),
            (F.col("scan_status") == "success", NEGATIVE),
            (F.col("scan_status") == "parse_failed", F.col("parse_error")),
            ((F.col("scan_status") == "needs_review") & (review > 0), "uncertain_target_match"),
            (F.col("scan_status") == "needs_review", "input_not_eligible_for_negative"),
        ],
        F.col("scan_status"),
    )
    return labelled.withColumns(
        {
            "label": label, "detected": label, "label_reason": reason,
            "parse_status": r.parse_status(F.col("scan_status")),
            "needs_review": F.col("scan_status") != "success",
        }
    )


def unparsed_records(manifest: DataFrame, error: str) -> DataFrame:
    """Labels for a run without a readable result: every record has the state of the run."""
    bare = manifest.select(
        "internal_id", "sample_group", "qc_status", "partial_status", "sequence_sha256",
        F.lit(False).alias("result_present"), F.lit(None).cast("string").alias("parse_error"),
        F.array().cast("array<struct<hit_status: string>>").alias("hits"),
    )
    return label_records(bare, error)


def hit_table(labelled: DataFrame, database: str, reference: str) -> DataFrame:
    return labelled.select(
        "internal_id", F.lit(database).alias("signature_database"),
        F.length("expected").alias("sequence_length"), F.inline("hits"),
    ).drop("problem").withColumn("raw_result_reference", F.lit(reference))


def group_report(labelled: DataFrame, groups: list[str]) -> DataFrame:
    """The checked report per sample group."""
    c.enforce(label_violations(labelled, labelled))
    return group_summary(labelled, "sample_group", groups)
