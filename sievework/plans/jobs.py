"""Whole jobs: read inputs, enforce the rules, write tables, receipts and summaries."""

from __future__ import annotations

import re
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import HitRules
from ..functions.text import bool_text
from ..operators import constraints as c
from ..operators.digests import table_digest
from ..operators.labels import group_summary, label_violations
from ..operators.quality import COHORT_LABELS
from ..session import materialise
from ..sinks import fasta as fasta_sink
from ..sinks.runs import guarded_folder, implementation, receipt
from ..sinks.storage import Place
from ..sinks.tables import markdown_table, write_csv, write_document, write_json_lines
from ..sources import archives, delimited, documents, matches
from ..sources.fasta import fasta_violations, headless_files, read_fasta
from . import audit, pilot, scan, split_job

# Columns of the pilot tables.
PILOT_MANIFEST = (
    "internal_id original_accession source_file source_record_index organism sequence_length "
    "sample_group original_annotation partial_status sequence_sha256 selection_reason qc_status "
    "input_json source_types"
).split()
PILOT_EXCLUDED = (
    "original_accession input_json source_record_index reason evidence related_accession"
).split()
PILOT_STATUS = (
    "internal_id submitted scan_status result_present parse_status failure_reason tool_name "
    "tool_version database_name database_version run_date"
).split()
PILOT_HITS = (
    "internal_id signature_database signature_accession signature_name interpro_accession start end "
    "score evalue domain_evalue sequence_length hit_length sequence_coverage hmm_coverage hit_status "
    "review_reason raw_result_reference"
).split()
def pilot_label_fields(accession: str) -> list[str]:
    return [
        "internal_id", "sample_group", "scan_status", f"{accession.lower()}_detected", "label",
        "label_reason", "needs_review", "sequence_sha256",
    ]


def content_digest(df: DataFrame) -> str:
    return table_digest(df, df.columns).first()["content_sha256"]


def _capital_flags(df: DataFrame) -> DataFrame:
    flags = [name for name, kind in df.dtypes if kind == "boolean"]
    return df.withColumns({name: bool_text(F.col(name), capital=True) for name in flags}) if flags else df


def run_audit(
    spark: SparkSession, archive: str, member: str, out: str, profile: audit.AuditProfile, version_prefix: str
) -> dict[str, Any]:
    """One archive, or several by a pattern, to metadata, members, FASTA, summary and manifest."""
    with guarded_folder(out) as folder:
        parsed = materialise(audit.parse_records(archives.read_zip_records(spark, archive, member)))
        records = archives.continuous_ordinals(parsed)
        c.enforce(c.unique_key(records, ["ordinal"], "record number not unique"))
        c.enforce(audit.record_violations(records))
        audited = materialise(audit.audit_records(records, profile))
        full = audit.with_outliers(audited, profile)
        metadata, members = audit.metadata_table(full, profile), audit.member_table(records, profile)
        eligible = audited.filter("sequence_qc_eligible").select("internal_id", "sequence")
        write_csv(metadata, f"{folder}/metadata", profile.metadata_fields(), ["internal_id"])
        write_csv(members, f"{folder}/members", profile.member_fields(), ["representative_internal_id"])
        fasta_sink.write_fasta(eligible, f"{folder}/sequences_for_clustering", "internal_id", "sequence")
        source = archives.source_summary(archives.read_zip_provenance(spark, archive, member))
        counts = audit.audit_summary(full, profile).first().asDict()
        cohorts = {n: counts.pop(f"cohort_{n}") for n in COHORT_LABELS}
        summary = {
            "schema_version": "1.0",
            "dataset_version": f"{version_prefix}-{source['source_member_sha256'][:12]}",
            "source": source,
            **counts,
            "cohort_counts": {n: k for n, k in sorted(cohorts.items()) if k},
            "label_status": "unlabelled_no_function_classes",
            "output_sha256": {
                "metadata.csv": content_digest(metadata),
                "members.csv": content_digest(members),
                "sequences_for_clustering.fasta": content_digest(eligible),
            },
        }
        write_document(folder / "audit_summary.json", summary, canonical=True)
        manifest = {
            "schema_version": "1.0",
            "dataset_version": summary["dataset_version"],
            "function_labels_present": False,
            "sequence_qc_rule": "canonical amino acids; non-empty unique sequence ID; exact-sequence representative",
            "primary_analysis_rule": "sequence QC eligible; no partial annotation; no other member type",
            "audit_summary_sha256": (folder / "audit_summary.json").digest(),
        }
        write_document(folder / "dataset_manifest.json", manifest, canonical=True)
        return summary


def run_split(
    spark: SparkSession, metadata: str, clusters: str, out: str, ratios: dict[str, float], seed: int
) -> dict[str, Any]:
    required = {"internal_id", "sequence_id", "sequence_qc_eligible", "analysis_cohort", "primary_analysis_eligible"}
    with guarded_folder(out) as folder:
        table = delimited.read_csv(spark, metadata, required)
        eligible = materialise(delimited.eligible_rows(table))
        result = split_job.split_eligible(
            eligible, materialise(delimited.read_cluster_pairs(spark, clusters)), ratios, seed
        )
        write_csv(
            result.manifest, f"{folder}/split_manifest", split_job.MANIFEST_FIELDS,
            ["homology_cluster", "internal_id"],
        )
        summary = {**result.summary, "metadata_sha256": content_digest(table)}
        write_document(folder / "split_summary.json", summary)
        return summary


def _typed_metadata(spark: SparkSession, path: str) -> DataFrame:
    table = delimited.read_csv(
        spark, path,
        {"internal_id", "sequence", "sequence_length", "sequence_sha256", "sequence_qc_eligible",
         "primary_analysis_eligible", "analysis_cohort"},
    )
    return table.withColumns(
        {
            "sequence_length": F.col("sequence_length").try_cast("int"),
            "sequence_qc_eligible": F.col("sequence_qc_eligible") == "true",
            "primary_analysis_eligible": F.col("primary_analysis_eligible") == "true",
        }
    )


def run_scan(
    spark: SparkSession, metadata: str, fasta: str, manifest: str, cutoff_hits: str,
    permissive_hits: str, model: scan.ProfileModel, out: str,
    splits: tuple[str, ...] = ("discovery", "validation"), bound: dict[str, str] | None = None,
) -> dict[str, Any]:
    """Check the handoff, then turn the hits of the outside search into states and coordinates.

    ``bound`` are digests of further inputs, such as the profile and its download receipt.
    """
    with guarded_folder(out) as folder:
        described = materialise(_typed_metadata(spark, metadata))
        sequences = materialise(read_fasta(spark, fasta))
        c.enforce(headless_files(spark, fasta))
        c.enforce(fasta_violations(sequences))
        parts = delimited.read_csv(
            spark, manifest,
            {"internal_id", "split", "homology_cluster", "analysis_cohort", "primary_analysis_eligible"},
        ).withColumn("primary_analysis_eligible", F.col("primary_analysis_eligible") == "true")
        parts = materialise(parts)
        c.enforce(scan.handoff_violations(described, sequences, parts, splits))
        records = described.filter("sequence_qc_eligible").select(
            "internal_id", "sequence", "sequence_sha256", "analysis_cohort", "primary_analysis_eligible"
        ).join(parts.select("internal_id", "split"), "internal_id")
        strict = spark.read.schema(scan.HIT_SCHEMA).json(cutoff_hits)
        loose = spark.read.schema(scan.HIT_SCHEMA).json(permissive_hits)
        for hits in (strict, loose):
            c.enforce(scan.hit_violations(hits, records))
        scanned = materialise(scan.scan_records(records, strict, loose, model))
        statuses, coordinates = scan.status_table(scanned), scan.coordinate_map(scanned)
        write_csv(_capital_flags(statuses), f"{folder}/per_sequence_status", scan.STATUS_FIELDS, ["internal_id"])
        write_csv(
            _capital_flags(coordinates), f"{folder}/hmm_coordinate_map", scan.COORDINATE_FIELDS,
            ["internal_id", "domain_number", "raw_position"],
        )
        write_json_lines(scan.raw_hits(strict, loose), f"{folder}/raw_hits")
        write_json_lines(scan.failures(scanned), f"{folder}/failures")
        by_split: dict[str, dict[str, int]] = {name: {} for name in splits}
        counts: dict[str, int] = {}
        for row in scan.scan_summary(scanned).collect():
            by_split[row["split"]][row["status"]] = row["n"]
            counts[row["status"]] = counts.get(row["status"], 0) + row["n"]
        coverage = {r["split"]: r.asDict() for r in scan.coverage_summary(scanned).collect()}
        totals = coordinates.agg(
            F.count(F.lit(1)).alias("n_coordinate_rows"), F.count_if("is_insertion").alias("n_insertions"),
            F.count_distinct("internal_id").alias("n_distinct_mapped_sequences"),
        ).first().asDict()
        summary = receipt(
            {"metadata.csv": content_digest(described), "sequences.fasta": content_digest(sequences),
             "split_manifest.csv": content_digest(parts), **(bound or {})},
            {"per_sequence_status.csv": content_digest(statuses),
             "hmm_coordinate_map.csv": content_digest(coordinates)},
            hmm={"length": model.length, "ga_sequence_bits": model.sequence_cutoff,
                 "ga_domain_bits": model.domain_cutoff},
            parameters={"boundary_distance_bits": model.boundary, "validation_used_for_conservation": False},
            n_sequences=sum(counts.values()), counts=counts, by_split=by_split,
            per_split_coverage=coverage, **totals,
            coordinate_convention="1-based full natural sequence position; insertion has null HMM match state",
            limitations=["No hit is a functional negative label", "Only included domains receive coordinates"],
        )
        write_document(folder / "scan_summary.json", summary)
        return summary


def run_verify(
    spark: SparkSession, scan_dir: str, metadata: str, fasta: str, out: str,
    splits: tuple[str, ...] = ("discovery", "validation"),
) -> dict[str, Any]:
    """Check a finished scan against its records, and its tables against the receipt."""
    with guarded_folder(out) as folder:
        stored = documents.load_object(Place(scan_dir) / "scan_summary.json")
        described = _typed_metadata(spark, metadata).filter("sequence_qc_eligible").select("internal_id", "sequence_sha256")
        records = materialise(described.join(read_fasta(spark, fasta), "internal_id"))
        text = delimited.read_csv(spark, f"{scan_dir}/per_sequence_status", set(scan.STATUS_FIELDS))
        statuses = materialise(text.withColumns({n: F.col(n).try_cast("int") for n in ("n_mapped_residues", "n_match_states")}))
        cells = delimited.read_csv(spark, f"{scan_dir}/hmm_coordinate_map", set(scan.COORDINATE_FIELDS))
        numbers = {n: F.col(n).try_cast("int") for n in ("domain_number", "raw_position", "hmm_match_state")}
        coordinates = materialise(cells.withColumns({**numbers, "is_insertion": F.col("is_insertion") == "True"}))
        found = materialise(
            scan.finished_violations(statuses, coordinates, records, int(stored["hmm"]["length"]), splits)
        )
        write_csv(found, f"{folder}/violations", ["rule", "key", "detail"], ["rule", "key"])
        write_csv(
            scan.reconciled(statuses, coordinates), f"{folder}/counts_per_record",
            ["internal_id", "n_mapped_residues", "n_mapped_residues_stored", "n_match_states", "n_match_states_stored", "state"],
            ["internal_id"],
        )
        counts = {r["status"]: r["n"] for r in statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = coordinates.count()
        summary = {
            "records": records.count(), "coordinate_rows": rows,
            "counts_agree": counts == stored["counts"] and rows == stored["n_coordinate_rows"],
            "violations": {r["rule"]: r["n"] for r in found.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()},
        }
        write_document(folder / "verification.json", summary)
        return summary


def run_select(
    spark: SparkSession, inputs: list[str], out: str, profile: pilot.PilotProfile,
    targets: tuple[int, int, int], seed: int,
) -> dict[str, Any]:
    """Screen and select a pilot. The first input is the main source; others are background."""
    if len(inputs) != len(set(inputs)):
        raise ValueError("Duplicate input specifications")
    with guarded_folder(out) as folder:
        screened, sources = None, []
        for number, spec in enumerate(inputs):
            parsed = materialise(pilot.parse_records(archives.read_record_array(spark, spec)))
            records = archives.continuous_ordinals(parsed).withColumn("input", F.lit(spec))
            c.enforce(pilot.schema_violations(records))
            names = pilot.field_names(records).orderBy("level", "name").collect()
            part = pilot.screen(records, profile, F.lit(number > 0))
            screened = part if screened is None else screened.unionByName(part)
            digest = table_digest(records, ["ordinal", "unique_sequence_id", "sequence"]).first()
            sources.append(
                {
                    "path": spec, "records": digest["n_rows"], "content_sha256": digest["content_sha256"],
                    "top_level_fields": [r["name"] for r in names if r["level"] == "record"],
                    "annotation_fields": [r["name"] for r in names if r["level"] == "annotation"],
                }
            )
        screened = materialise(screened)
        manifest, excluded = pilot.select_pilot(screened, profile, targets, seed)
        manifest, excluded = materialise(manifest), materialise(excluded)
        write_csv(manifest, f"{folder}/pilot_manifest", PILOT_MANIFEST, ["internal_id"], strict=False)
        write_csv(excluded, f"{folder}/excluded_or_qc_sequences", PILOT_EXCLUDED)
        fasta_sink.write_fasta(manifest, f"{folder}/pilot_sequences", "internal_id", "sequence", width=None)
        c.enforce(pilot.pilot_violations(manifest, manifest.select("internal_id", "sequence")))
        groups = manifest.groupBy("sample_group").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("organism").alias("organisms"),
        ).collect()
        summary = receipt(
            {spec["path"]: spec["content_sha256"] for spec in sources},
            {"pilot_manifest.csv": content_digest(manifest)},
            seed, sources=sources, target_counts=dict(zip(profile.groups, targets)),
            actual_counts={r["sample_group"]: r["n"] for r in groups},
            organisms={r["sample_group"]: r["organisms"] for r in groups},
            passed_basic_qc=screened.filter("reason = ''").count(),
            exclusion_reasons={
                r["reason"]: r["n"]
                for r in excluded.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()
            },
            limitations="Not a random prevalence sample; the near screen is approximate.",
        )
        # what a run receipt has to repeat
        summary["bound_inputs"] = bound_inputs(spark, str(folder), None)
        write_document(folder / "selection_summary.json", summary)
        return summary


def bound_inputs(spark: SparkSession, pilot_dir: str, rules_file: str | None) -> dict[str, str]:
    """Digests that tie a run to what it was given: the stored manifest and sequences, and the rules file."""
    found = {
        "manifest_sha256": content_digest(delimited.read_csv(spark, f"{pilot_dir}/pilot_manifest")),
        "fasta_sha256": content_digest(read_fasta(spark, f"{pilot_dir}/pilot_sequences").select("internal_id", "sequence")),
    }
    return {**found, "rules_sha256": Place(rules_file).digest()} if rules_file else found


def run_parse(
    spark: SparkSession, pilot_dir: str, run_dir: str, rules: HitRules, database: str, accession: str, out: str,
    rules_file: str | None = None,
) -> dict[str, int]:
    """Results of a scan to states, hits and labels. ``run_dir`` holds run_receipt.json and raw/pilot.xml.

    The run receipt must name the digests of ``bound_inputs``: results of other inputs are refused.
    """
    run = documents.load_object(Place(run_dir) / "run_receipt.json")
    xml = Place(run_dir) / "raw" / "pilot.xml"
    with guarded_folder(out) as folder:
        bound = bound_inputs(spark, pilot_dir, rules_file)
        if other := sorted(name for name, digest in bound.items() if run.get(name) != digest):
            raise ValueError(f"the run receipt belongs to other inputs: {', '.join(other)}")
        manifest = delimited.read_csv(spark, f"{pilot_dir}/pilot_manifest")
        sequences = materialise(read_fasta(spark, f"{pilot_dir}/pilot_sequences"))
        c.enforce(headless_files(spark, f"{pilot_dir}/pilot_sequences"))
        c.enforce(fasta_violations(sequences))
        manifest = materialise(
            manifest.withColumn("sequence_length", F.col("sequence_length").try_cast("int"))
            .join(sequences, "internal_id")
        )
        c.enforce(pilot.pilot_violations(manifest.drop("sequence"), sequences))
        error, cause = pilot.global_state(run, xml.exists()), ""
        if not error:
            try:
                if run.get("xml_sha256") != xml.digest():
                    raise ValueError("Raw XML hash mismatch")
                root = matches.root_attributes(spark, str(xml))
                if root.get("interproscan-version") != run.get("tool_version") or not run.get("database_version"):
                    raise ValueError("Missing or mismatched tool/database version")
                proteins = materialise(matches.read_proteins(spark, str(xml)))
                ids = spark.createDataFrame([(i,) for i in run.get("ids", [])], "internal_id string")
                c.enforce(c.set_difference(ids, manifest, "internal_id"))
                c.enforce(pilot.xref_violations(proteins, manifest))
            except (ValueError, OSError, AnalysisException) as problem:  # A result that is wrong, unreadable or no XML.
                error, cause = "parse_failed", str(problem)
                (folder / "parse_error.log").write_text(cause)
            except (PySparkException, Py4JJavaError) as problem:  # Broken XML; a lost executor stays an error.
                if not re.search("MALFORMED|FAILED_READ_FILE", str(problem)):
                    raise
                error, cause = "parse_failed", str(problem)
                (folder / "parse_error.log").write_text(cause)
        if error:
            labelled = pilot.unparsed_records(manifest, error)
        else:
            labelled = pilot.label_records(
                pilot.parse_hits(proteins, manifest, rules, accession, database, run["database_version"])
            )
        labelled = materialise(labelled)
        statuses = labelled.withColumns(
            {
                "failure_reason": F.when(F.col("scan_status") == "success", "").otherwise(F.col("label_reason")),
                "tool_name": F.lit("InterProScan"), "tool_version": F.lit(run.get("tool_version", "")),
                "database_name": F.lit(database), "database_version": F.lit(run.get("database_version", "")),
                "run_date": F.lit(run.get("run_date", "")),
            }
        )
        write_csv(_capital_flags(statuses), f"{folder}/pilot_scan_status", PILOT_STATUS, ["internal_id"], strict=False)
        detected = f"{accession.lower()}_detected"
        write_csv(
            _capital_flags(labelled.withColumnRenamed("detected", detected)), f"{folder}/pilot_labels",
            pilot_label_fields(accession), ["internal_id"], strict=False,
        )
        if not error:
            hits = pilot.hit_table(labelled, database, str(xml))
            write_csv(hits, f"{folder}/pilot_hits", PILOT_HITS, ["internal_id", "start"])
        rows = labelled.groupBy("scan_status").agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {r["scan_status"]: r["n"] for r in rows}
        inputs = {**bound, "run_receipt_sha256": (Place(run_dir) / "run_receipt.json").digest()}
        if xml.exists():
            inputs["xml_sha256"] = xml.digest()
        outputs = {"pilot_scan_status": content_digest(statuses), "pilot_labels": content_digest(labelled)}
        write_document(folder / "parse_provenance.json", receipt(inputs, outputs, counts=counts, implementation=implementation()))
        return counts


def run_report(
    spark: SparkSession, parsed_dir: str, groups: list[str], accession: str, out: str
) -> list[dict[str, Any]]:
    """The checked group summary as CSV and Markdown."""
    flag = lambda name: F.col(name) == "True"
    labels = delimited.read_csv(spark, f"{parsed_dir}/pilot_labels").withColumnRenamed(
        f"{accession.lower()}_detected", "detected"
    )
    statuses = delimited.read_csv(spark, f"{parsed_dir}/pilot_scan_status")
    typed_labels = labels.withColumns(
        {n: F.when(F.col(n) != "", F.col(n).try_cast("int")) for n in ("label", "detected")}
    )
    typed_statuses = statuses.withColumns({n: flag(n) for n in ("submitted", "result_present")})
    with guarded_folder(out) as folder:
        c.enforce(label_violations(typed_labels, typed_statuses))
        joined = typed_labels.join(typed_statuses.select("internal_id", "submitted"), "internal_id")
        table = group_summary(joined, "sample_group", groups).withColumnRenamed(
            "positive", f"{accession.lower()}_positive"
        )
        rows = [r.asDict() for r in table.collect()]
        write_csv(table, f"{folder}/pilot_group_summary", table.columns)
        lines = ["# Pilot report", "", *markdown_table(rows, table.columns), ""]
        lines.append("A blank label is not a negative. Pending and reviewed records are not successes.")
        (folder / "pilot_scan_report.md").write_text("\n".join(lines) + "\n")
        return rows

