"""Jobs around a finished scan: structures on the profile, figure data with spot checks, stored files against receipts."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as al
from ..functions.rules import artifact_status
from ..operators import constraints as c
from ..operators import receipts as rc
from ..session import materialise
from ..sinks.runs import guarded_folder, implementation, receipt
from ..sinks.storage import Place
from ..sinks.tables import canonical_json, write_csv, write_document
from ..sources import delimited, documents, structures
from . import release, report, scan, structure
from .jobs import _capital_flags, content_digest

#: Files up to this size are hashed in tasks, where one file is one value; larger ones as a stream of the JVM.
WHOLE = 1 << 30

STRUCTURE_FIELDS = [
    "structure", "deposited_position", "pdb_residue_number", "pdb_insertion_code", "residue", "modeled",
    "secondary_structure", "hmm_match_state", "is_hmm_insertion", "hmm_aligned",
]
ARTIFACT_FIELDS = ["artifact", "location", "source", "expected_sha256", "actual_sha256", "status", "line_ends"]


def check_download(spark: SparkSession, path: str, receipt_path: str, url: str) -> str:
    """The digest of a fetched file, after its download receipt has been found to name it, its address and a time."""
    digest = Place(path).digest()
    body = Place(receipt_path).read_bytes().decode("utf-8")
    rows = spark.createDataFrame([(path, body)], "file string, body string")
    entries = release.source_entries(rows.select("file", F.parse_json("body").alias("receipt")))
    broken = rc.broken_rules(entries, "file", release.source_rules(digest, url)).orderBy("position").collect()
    if broken:
        raise ValueError(f"{receipt_path}: " + "; ".join(r["error"] for r in broken))
    return digest


def load_profile(
    spark: SparkSession, path: str, receipt_path: str, url: str, accession: str, boundary: float = 2.0
) -> tuple[scan.ProfileModel, dict[str, str]]:
    """Length and cutoffs from the profile file itself, and the digests that bind a run to it."""
    digest = check_download(spark, path, receipt_path, url)
    length, sequence, domain = documents.profile_cutoffs(
        documents.profile_header(Place(path).read_bytes().decode("utf-8"), accession)
    )
    bound = {"profile": digest, "profile_receipt": Place(receipt_path).digest()}
    return scan.ProfileModel(length, sequence, domain, boundary), bound


def structure_name(file: str) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1)


def aligned_structures(deposited: DataFrame, hits: DataFrame, chain: str, length: int) -> DataFrame:
    """``(file, raw_position, match_state, is_insertion, error)``: the one included domain of each structure.

    A hit belongs to the structure whose name and chain, as ``name_chain``, it carries. A structure
    without a hit, or with another number of included domains than one, gives one row with an error.
    """
    residues = F.transform(F.array_sort(F.collect_list(F.struct("deposited_position", "residue"))), lambda x: x["residue"])
    chains = deposited.groupBy("file").agg(F.array_join(residues, "").alias("sequence"))
    named = chains.withColumn("internal_id", F.concat(structure_name("file"), F.lit(f"_{chain}")))
    included = F.filter("domains", lambda d: d["included"])
    joined = named.join(hits.select("internal_id", "domains"), "internal_id", "left").withColumn(
        "domains", F.coalesce(included, F.array())
    )
    located = joined.withColumn("d", al.aligned_domains(F.col("domains"), F.col("sequence"), length))
    error = F.when(
        F.size("domains") != 1, F.concat(F.size("domains").cast("string"), F.lit(" included domains instead of one"))
    ).otherwise(F.col("d")[0]["error"])
    judged = located.select("file", error.alias("error"), F.when(error.isNull(), F.col("d")[0]["cells"]).alias("cells"))
    return judged.select("file", "error", F.inline_outer("cells"))


def run_structure(
    spark: SparkSession, path: str, chain: str, hits: str, model: scan.ProfileModel, out: str, bound: dict[str, str] | None = None
) -> list[dict[str, Any]]:
    """Deposited residues of one structure file, or many by a pattern, joined to models and match states."""
    with guarded_folder(out) as folder:
        lines = materialise(structures.read_lines(spark, path))
        c.require_rows(lines, "no structure file")
        headless = lines.filter("n = 0 and not startswith(line, 'HEADER')")
        c.enforce(c.violation(headless, "structure without a header", F.col("file"), ""))
        deposited = materialise(structures.deposited_residues(lines, chain))
        silent = lines.select("file").distinct().join(deposited.select("file"), "file", "left_anti")
        c.enforce(c.violation(silent, "chain without deposited residues", F.col("file"), ""))
        modelled = materialise(structures.modelled_residues(lines, chain))
        c.enforce(structures.numbering_violations(deposited, modelled))
        found = spark.read.schema(scan.HIT_SCHEMA).json(hits)
        c.enforce(c.unique_key(found, ["internal_id"], "duplicate hit"))
        aligned = materialise(aligned_structures(deposited, found, chain, model.length))
        c.enforce(c.violation(aligned.filter("error is not null"), "structure not aligned", F.col("file"), F.col("error")))
        aligned = aligned.filter("raw_position is not null").drop("error")
        c.enforce(structure.alignment_violations(aligned))
        mapped = materialise(structure.structure_map(deposited, modelled, aligned))
        table = mapped.withColumn("structure", structure_name("file")).drop("file")
        counts = structure.structure_summary(mapped).withColumn("structure", structure_name("file")).drop("file")
        write_csv(_capital_flags(table), f"{folder}/residue_map", STRUCTURE_FIELDS, ["structure", "deposited_position"])
        write_csv(counts, f"{folder}/structure_counts", counts.columns, ["structure"])
        total = counts.agg(*[F.sum(n).alias(n) for n in counts.columns if n.startswith("n_") and "distinct" not in n], F.count("*").alias("structures"))
        summary = total.first().asDict()
        note = receipt(
            {"structure_lines": content_digest(lines), "hits": content_digest(found.select("internal_id", F.to_json("domains").alias("domains"))), **(bound or {})},
            {"residue_map": content_digest(table)}, chain=chain, implementation=implementation(),
            profile={"length": model.length, "ga_sequence_bits": model.sequence_cutoff, "ga_domain_bits": model.domain_cutoff},
            counts=summary,
        )
        write_document(folder / "structure_summary.json", note)
        return summary


def _flags(table: DataFrame, *names: str) -> DataFrame:
    return table.withColumns({n: F.lower(n) == "true" for n in names})


def run_figures(
    spark: SparkSession, metadata: str, clusters: str, scan_dir: str, out: str, dataset: str, split: str,
    residue_map: str | None = None,
) -> dict[str, int]:
    """The values behind every figure as CSV, checked against fresh counts, and one spot check per rule as Markdown."""
    with guarded_folder(out) as folder:
        rows = materialise(_flags(
            delimited.read_csv(spark, metadata), "sequence_qc_eligible", "primary_analysis_eligible", "is_partial_any_member",
            "has_type_conflict", "is_length_outlier",
        ))
        pairs = delimited.read_cluster_pairs(spark, clusters)
        stored = documents.load_object(Place(scan_dir) / "scan_summary.json")
        statuses = delimited.read_csv(spark, f"{scan_dir}/per_sequence_status", set(scan.STATUS_FIELDS)).withColumn(
            "n_deleted_match_states", F.col("n_deleted_match_states").try_cast("int")
        )
        numbers = {n: F.col(n).try_cast("int") for n in ("domain_number", "raw_position", "hmm_match_state")}
        cells = delimited.read_csv(spark, f"{scan_dir}/hmm_coordinate_map", set(scan.COORDINATE_FIELDS))
        coordinates = materialise(_flags(cells.withColumns(numbers), "is_insertion"))
        tables = report.figure_tables(rows, pairs, statuses, coordinates, int(stored["hmm"]["length"]))
        for name, table in tables.items():
            write_csv(table, f"{folder}/{name}", table.columns)
        plotted = delimited.read_csv(spark, f"{folder}/cohort_counts").withColumn("n", F.col("n").try_cast("long"))
        c.enforce(c.violation(report.plotted_equals_source(plotted, rows), "plotted cohort", F.col("analysis_cohort"), ""))
        shown = [report.spot_checks(rows), report.coordinate_spot_checks(coordinates, rows, statuses)]
        if residue_map:
            shown.append(report.structure_spot_checks(delimited.read_csv(spark, residue_map, set(STRUCTURE_FIELDS))))
        checks = [r.asDict() for part in shown for r in part.orderBy("check").collect()]  # one row per rule
        blank = [{k: "" if v is None else v for k, v in r.items()} for r in checks]
        (folder / "spot_checks.md").write_text(report.render_spot_checks(blank, dataset, split))
        if wrong := [r["check"] for r in checks if "disagrees" in r["conclusion"]]:
            raise ValueError(f"spot checks failed: {', '.join(wrong)}")
        return {name: table.count() for name, table in tables.items()}


def wanted_artifacts(listing: Iterable[dict[str, Any]], loaded: dict[str, dict[str, Any]]) -> list[dict[str, str]]:
    """Artifact, location, source and expected digest of each entry, the digest taken from its receipt.

    An entry names ``artifact``, ``location``, ``receipt`` and ``field``, the path of the digest in that receipt.
    """
    found = []
    for entry in listing:
        value: Any = loaded[entry["receipt"]]
        for part in entry["field"]:
            value = value.get(part) if isinstance(value, dict) else None
        source = ".".join((entry["receipt"], *entry["field"]))
        if not isinstance(value, str):
            raise ValueError(f"no digest at {source}")
        found.append({"artifact": entry["artifact"], "location": entry["location"], "source": source, "expected_sha256": value})
    return found


def artifact_digests(spark: SparkSession, locations: list[str]) -> DataFrame:
    """``(location, actual_sha256, lf_sha256, crlf_sha256)`` of the files that are there.

    The last two are the digests with all line ends made LF or CRLF; NULL for files above ``WHOLE``.
    """
    schema = "location string, actual_sha256 string, lf_sha256 string, crlf_sha256 string"
    there = {at: place.size() for at in dict.fromkeys(locations) if (place := Place(at)).is_file()}
    small = [at for at, size in there.items() if 0 < size <= WHOLE]  # the reader of whole files skips empty ones
    large = [(at, Place(at).digest(), None, None) for at in there if at not in small]
    streamed = spark.createDataFrame(large, schema)
    if not small:
        return streamed
    paths = {at: Place(at).qualified() for at in small}
    names = spark.createDataFrame(list(paths.items()), "location string, path string")
    text = F.decode("content", "ISO-8859-1")
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    hashed = lambda value: F.sha2(F.encode(value, "ISO-8859-1"), 256)
    read = spark.read.format("binaryFile").load([Place(at).literal() for at in sorted(set(paths.values()))]).select(
        "path", F.sha2("content", 256).alias("actual_sha256"), hashed(lf).alias("lf_sha256"),
        hashed(F.replace(lf, F.lit("\n"), F.lit("\r\n"))).alias("crlf_sha256"),
    )
    return names.join(read, "path").drop("path").unionByName(streamed)


def artifact_states(wanted: DataFrame, digests: DataFrame) -> DataFrame:
    """Every wanted artifact with its state; a mismatch also says which line ends would make it match."""
    expected = F.col("expected_sha256")
    state = artifact_status(F.col("actual_sha256"), expected)
    ends = F.when(F.col("lf_sha256") == expected, "LF").when(F.col("crlf_sha256") == expected, "CRLF")
    return wanted.join(digests, "location", "left").withColumns(
        {"status": state, "line_ends": F.when(state == "mismatch", ends)}
    ).select(*ARTIFACT_FIELDS)


def run_artifacts(spark: SparkSession, listing: str, receipts: dict[str, str], out: str) -> dict[str, int]:
    """Files named in receipts against what is stored: match, mismatch or missing; nothing is fetched or changed."""
    with guarded_folder(out) as folder:
        loaded = {name: documents.load_object(path) for name, path in receipts.items()}
        entries = documents.load_object(listing)["artifacts"]
        if unknown := {e["receipt"] for e in entries} - loaded.keys():
            raise ValueError(f"no such receipts: {sorted(unknown)}")
        rows = wanted_artifacts(entries, loaded)
        wanted = spark.createDataFrame(
            [tuple(r.values()) for r in rows], "artifact string, location string, source string, expected_sha256 string"
        )
        states = materialise(artifact_states(wanted, artifact_digests(spark, [r["location"] for r in rows])))
        write_csv(states, f"{folder}/artifact_states", ARTIFACT_FIELDS, ["artifact", "location"])
        counts = {r["status"]: r["n"] for r in states.groupBy("status").agg(F.count("*").alias("n")).collect()}
        (folder / "artifact_audit.json").write_bytes(canonical_json(receipt(
            {name: Place(path).digest() for name, path in receipts.items()}, {"artifact_states": content_digest(states)},
            counts=counts, read_only=True,
        )))
        return counts
