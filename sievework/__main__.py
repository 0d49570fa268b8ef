"""Command line: ``python -m sievework <job> …``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .operators.split import parse_ratios
from .plans import evidence, jobs, release
from .plans.audit import AuditProfile
from .plans.pilot import PilotProfile
from .plans.scan import ProfileModel
from .sinks.storage import Place
from .sources.delimited import read_csv
from .sources.documents import load_object, load_rules

# As many wrong rows of a manifest are printed; the exit code counts all of them.
SHOWN = 100


def _ratios(text: str) -> dict[str, float]:
    try:
        return parse_ratios(text)
    except ValueError as error:
        raise argparse.ArgumentTypeError(str(error)) from error


def _profile_options(job: argparse.ArgumentParser) -> None:
    """A profile by its file and download receipt, or by three numbers."""
    for name in ("profile", "profile-receipt", "profile-url", "accession"):
        job.add_argument(f"--{name}")
    job.add_argument("--profile-length", type=int)
    job.add_argument("--sequence-cutoff", type=float)
    job.add_argument("--domain-cutoff", type=float)
    job.add_argument("--boundary-bits", type=float, default=2.0)


def _profile(spark: SparkSession, o) -> tuple[ProfileModel, dict[str, str]]:
    file = (o.profile, o.profile_receipt, o.profile_url, o.accession)
    numbers = (o.profile_length, o.sequence_cutoff, o.domain_cutoff)
    if all(file) and numbers == (None, None, None):
        return evidence.load_profile(spark, *file, o.boundary_bits)
    if None in numbers or any(file):
        raise ValueError("give the profile, its receipt, url and accession, or else its length and both cutoffs")
    return ProfileModel(*numbers, o.boundary_bits), {}


def _scan(spark: SparkSession, o) -> dict:
    model, bound = _profile(spark, o)
    return jobs.run_scan(
        spark, o.metadata, o.fasta, o.split_manifest, o.cutoff_hits, o.permissive_hits, model, o.output_dir, bound=bound
    )


def _structure(spark: SparkSession, o) -> dict:
    model, bound = _profile(spark, o)
    if o.structure_receipt:
        digest = evidence.check_download(spark, o.structures, o.structure_receipt, o.structure_url)
        bound = {**bound, "structure": digest, "structure_receipt": Place(o.structure_receipt).digest()}
    return evidence.run_structure(spark, o.structures, o.chain, o.hits, model, o.output_dir, bound)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sievework", description=__doc__)
    sub = top.add_subparsers(dest="job", required=True)

    a = sub.add_parser("audit", help="nested records to metadata, members, FASTA and summary")
    a.add_argument("--input-zip", required=True)
    a.add_argument("--member", required=True)
    a.add_argument("--output-dir", required=True)
    a.add_argument("--id-prefix", required=True)
    a.add_argument("--family", required=True, help="names the type columns")
    a.add_argument("--target-type", required=True)
    a.add_argument("--watched-type", required=True)
    a.add_argument("--version-prefix", required=True)
    a.set_defaults(run=lambda spark, o: jobs.run_audit(
        spark, o.input_zip, o.member, o.output_dir,
        AuditProfile(o.id_prefix, o.family, o.target_type, o.watched_type), o.version_prefix))

    s = sub.add_parser("split", help="whole clusters to splits")
    s.add_argument("--metadata", required=True)
    s.add_argument("--clusters-tsv", required=True)
    s.add_argument("--output-dir", required=True)
    s.add_argument("--ratios", type=_ratios, default="discovery=0.7,validation=0.3")
    s.add_argument("--seed", type=int, default=42)
    s.set_defaults(run=lambda spark, o: jobs.run_split(
        spark, o.metadata, o.clusters_tsv, o.output_dir, o.ratios, o.seed))

    n = sub.add_parser("scan", help="search hits to states and coordinates")
    for name in ("metadata", "fasta", "split-manifest", "cutoff-hits", "permissive-hits", "output-dir"):
        n.add_argument(f"--{name}", required=True)
    _profile_options(n)
    n.set_defaults(run=_scan)

    t = sub.add_parser("structure", help="deposited residues of structures to models and match states")
    for name in ("structures", "chain", "hits", "output-dir"):
        t.add_argument(f"--{name}", required=True)
    _profile_options(t)
    t.add_argument("--structure-receipt", help="download receipt of a single structure file")
    t.add_argument("--structure-url")
    t.set_defaults(run=_structure)

    f = sub.add_parser("figures", help="the values behind the figures, and spot checks")
    for name in ("metadata", "clusters-tsv", "scan-dir", "output-dir", "dataset", "split"):
        f.add_argument(f"--{name}", required=True)
    f.add_argument("--residue-map", help="residue_map of a structure run")
    f.set_defaults(run=lambda spark, o: evidence.run_figures(
        spark, o.metadata, o.clusters_tsv, o.scan_dir, o.output_dir, o.dataset, o.split, o.residue_map))

    e = sub.add_parser("artifacts", help="stored files against the digests in receipts")
    e.add_argument("--listing", required=True, help="JSON object with artifacts: artifact, location, receipt, field")
    e.add_argument("--receipt", action="append", required=True, metavar="NAME=FILE")
    e.add_argument("--output-dir", required=True)
    e.set_defaults(run=lambda spark, o: evidence.run_artifacts(
        spark, o.listing, dict(item.split("=", 1) for item in o.receipt), o.output_dir))

    p = sub.add_parser("select", help="screen and select a pilot")
    p.add_argument("--input-json", required=True)
    p.add_argument("--background-json", action="append", default=[])
    p.add_argument("--output-dir", required=True)
    p.add_argument("--seed", type=int, default=20260908)
    p.add_argument("--targets", type=int, nargs=3, default=[30, 15, 15])
    p.add_argument("--family", required=True)
    p.add_argument("--target-tag", required=True)
    p.add_argument("--groups", nargs=3, required=True, help="clear, conflicting, background")
    p.set_defaults(run=lambda spark, o: jobs.run_select(
        spark, [o.input_json, *o.background_json], o.output_dir,
        PilotProfile(o.family, o.target_tag, tuple(o.groups)), tuple(o.targets), o.seed))

    r = sub.add_parser("parse", help="scan results to labels under frozen rules")
    for name in ("pilot-dir", "run-dir", "rules", "database", "accession", "output-dir"):
        r.add_argument(f"--{name}", required=True)
    r.set_defaults(run=lambda spark, o: jobs.run_parse(
        spark, o.pilot_dir, o.run_dir, load_rules(o.rules, o.database, o.accession),
        o.database, o.accession, o.output_dir, o.rules))

    g = sub.add_parser("report", help="group summary of parsed labels")
    g.add_argument("--parsed-dir", required=True)
    g.add_argument("--groups", nargs="+", required=True)
    g.add_argument("--accession", required=True)
    g.add_argument("--output-dir", required=True)
    g.set_defaults(run=lambda spark, o: jobs.run_report(
        spark, o.parsed_dir, o.groups, o.accession, o.output_dir))

    w = sub.add_parser("verify", help="a finished scan against its records and receipt")
    for name in ("scan-dir", "metadata", "fasta", "output-dir"):
        w.add_argument(f"--{name}", required=True)
    w.set_defaults(run=lambda spark, o: jobs.run_verify(spark, o.scan_dir, o.metadata, o.fasta, o.output_dir))

    v = sub.add_parser("validate", help="release receipts against frozen values; exit 1 on errors")
    for name in ("audit", "mmseqs", "split", "frozen"):
        v.add_argument(f"--{name}", required=True)
    v.add_argument("--manifest", help="split manifest as CSV")
    v.add_argument("--receipt", action="append", default=[], metavar="NAME=FILE", help="a handed-over receipt")
    v.add_argument("--rules", help="JSON object with a table of rules per receipt name")
    v.set_defaults(run=_validate)
    return top


def _validate(spark: SparkSession, o) -> list[str]:
    """What is wrong with the receipts, the handed-over ones and the manifest; rules are few, so are their errors."""
    paths = {"audit": o.audit, "mmseqs": o.mmseqs, "split": o.split}
    given = dict(item.split("=", 1) for item in o.receipt)
    if clash := given.keys() & paths.keys():
        raise ValueError(f"receipt names already taken: {sorted(clash)}")
    own = load_object(o.rules) if o.rules else {}
    if unknown := given.keys() - own.keys() - release.HANDED_OVER.keys():
        raise ValueError(f"no rules for receipts {sorted(unknown)}")
    loaded, frozen = release.load_documents(spark, paths | given), load_object(o.frozen)
    problems = list(loaded.first()["load_errors"])
    problems += [r["error"] for r in release.validate_release(loaded, frozen).orderBy("position").collect()]
    if given:
        tables = {name: own.get(name) for name in given}
        problems += [r["error"] for r in release.validate_handover(loaded, frozen, tables).orderBy("position").collect()]
    if o.manifest:
        shown = release.manifest_errors(read_csv(spark, o.manifest, {"homology_cluster", "split"})).orderBy("error").limit(SHOWN + 1)
        lines = [r["error"] for r in shown.collect()]
        problems += lines[:SHOWN] + ["manifest: and more"] * (len(lines) > SHOWN)
    return problems


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"sievework-{options.job}").getOrCreate()
    try:
        result = options.run(spark, options)
    except (ValueError, OSError, PySparkException) as error:
        print(f"ERROR: {error}", file=sys.stderr)
        return 2
    if options.job == "validate":
        for line in result:
            print(line, file=sys.stderr)
        return 1 if result else 0
    print(json.dumps(result, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
