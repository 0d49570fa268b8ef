import copy
import json

import pytest
from pyspark.sql import functions as F

from sievework.__main__ import main
from sievework.operators import receipts as rc
from sievework.plans import release, report

A, B, C, D, E = ("abcde"[i] * 64 for i in range(5))
FROZEN = {
    "dataset_version": "data-1", "split_version": "split-1", "candidate_records": 10, "unique_internal_ids": 10,
    "sequence_qc_eligible": 9, "primary_cohort": 7, "input_sequences": 9, "output_clusters": 4, "total_sequences": 9,
    "total_clusters": 4, "discovery_sequences": 6, "validation_sequences": 3, "discovery_clusters": 3, "validation_clusters": 1,
}
GOOD = {
    "audit": {"dataset_version": "data-1", "candidate_records": 10, "sequence_qc_eligible": 9, "primary_cohort": 7,
              "unique_internal_ids": 10,
              "output_sha256": {"metadata.csv": A, "members.csv": B, "sequences_for_clustering.fasta": C},
              "source": {"source_member_sha256": D, "source_zip_sha256": E}},
    "mmseqs": {"status": "ok", "mmseqs_version": "15", "input_sequences": 9, "output_clusters": 4, "min_sequence_identity": 0.8,
               "coverage": 0.8, "coverage_mode": 1, "input_fasta_sha256": C, "mmseqs_cluster_tsv_sha256": D},
    "split": {"split_version": "split-1", "schema_version": "1.0", "seed": 0, "cluster_leakage": False, "total_sequences": 9,
              "total_clusters": 4, "sequence_counts": {"discovery": 6, "validation": 3},
              "cluster_counts": {"discovery": 3, "validation": 1}, "metadata_sha256": A, "mmseqs_cluster_tsv_sha256": D,
              "split_manifest_sha256": E},
}
REPRODUCED = {
    **GOOD,
    "b_data": {"dataset_version": "data-1", "status": "ok", "counts": {"candidate_records": 10, "sequence_qc_eligible": 9,
               "primary": 7, "homology_clusters": 4}, "outputs": {"metadata_sha256": A, "members_sha256": B, "clustering_fasta_sha256": C},
               "source": {"source_member_sha256": D}},
    "b_split": {"dataset_version": "data-1", "status": "ok", "cluster_leakage": False, "sequence_counts": {"discovery": 6, "validation": 3},
                "cluster_counts": {"discovery": 3, "validation": 1}, "mmseqs2_version": "x", "split_manifest_sha256": E,
                "comparison": {"counts_match_frozen": True, "split_manifest_hash_matches_frozen": True}},
}
STRUCTURE = {"pdb_id": "1ABC", "chain": "N", "hmm": {"length": 39, "accession": "PX1.2", "sha256": A}, "pdb_sha256": B,
             "coordinate_map_sha256": C, "n_deposited_residues": 8, "n_modeled_residues": 5, "n_unmodeled_residues": 3,
             "n_distinct_hmm_match_states": 39, "purpose": "mapping, not Functional labels"}
EXPECTED = {"pdb_id": "1ABC", "chain": "N", "hmm_length": 39, "accession": "PX1", "n_deposited_residues": 8,
            "n_modeled_residues": 5, "n_unmodeled_residues": 3, "n_distinct_hmm_match_states": 39}
SCAN = {"schema_version": "1.0", "n_sequences": 9, "counts": {}, "by_split": {}, "hmm": {"sha256": A}, "purpose": "p",
        "parameters": {"validation_used_for_conservation": False}}


def run(spark, cases, rules):
    """Errors per case; all cases are checked in one pass, as many releases would be."""
    names = sorted({n for case in cases for n in case})
    rows = [(i, *[None if case.get(n) is None else json.dumps(case[n]) for n in names]) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, ", ".join(["release int", *[f"{n} string" for n in names]]))
    df = df.select("release", *[F.parse_json(n).alias(n) for n in names])
    found = rc.broken_rules(df, "release", rules).orderBy("release", "position").collect()
    return [[r["error"] for r in found if r["release"] == i] for i in range(len(cases))]


def changed(base, *path, value="DELETE"):
    case = copy.deepcopy(base)
    node = case
    for part in path[:-1]:
        node = node[part]
    if value == "DELETE":
        del node[path[-1]]
    else:
        node[path[-1]] = value
    return case


def test_release_rules(spark):
    cases = [
        (GOOD, []),
        (changed(GOOD, "audit", "primary_cohort"), ["audit.primary_cohort: no value", "primary_cohort: nothing instead of 7"]),
        (changed(GOOD, "audit", "output_sha256", "members.csv", value=""), ["audit.output_sha256.members.csv: no digest"]),
        (changed(GOOD, "split", "split_manifest_sha256", value="ABC"), ["split.split_manifest_sha256: not a SHA-256 digest"]),
        (changed(GOOD, "split", "split_manifest_sha256", value=12), ["split.split_manifest_sha256: not a SHA-256 digest"]),
        (changed(GOOD, "split", "cluster_leakage", value="false"), ['split.cluster_leakage: "false" instead of false']),
        (changed(GOOD, "mmseqs", "input_fasta_sha256", value=E),
         ["mmseqs.input_fasta_sha256 differs from audit.output_sha256.sequences_for_clustering.fasta"]),
        (changed(GOOD, "split", "metadata_sha256", value=E), ["split.metadata_sha256 differs from audit.output_sha256.metadata.csv"]),
        (changed(GOOD, "split", "mmseqs_cluster_tsv_sha256", value=E),
         ["split.mmseqs_cluster_tsv_sha256 differs from mmseqs.mmseqs_cluster_tsv_sha256"]),
        (changed(GOOD, "split", "sequence_counts", "discovery", value=5), ["discovery_sequences: 5 instead of 6"]),
        (changed(GOOD, "audit", "dataset_version", value="data-2"), ['dataset_version: "data-2" instead of "data-1"']),
        (changed(GOOD, "audit", "candidate_records", value="10"), ['candidate_records: "10" instead of 10']),
        (changed(GOOD, "mmseqs"), []),
    ]
    results = run(spark, [case for case, _ in cases], release.release_rules(FROZEN))
    for got, (_, expected) in zip(results, cases):
        assert got == expected
    few = release.release_rules({**{n: v for n, v in FROZEN.items() if n != "split_version"}, "mood": 1})
    assert run(spark, [GOOD], few) == [["mood is not a frozen name", "split_version has no frozen value"]]


def test_rules_come_from_tables_and_go_back():
    rules = release.release_rules(FROZEN)
    assert rc.rules_from(json.loads(json.dumps(rc.table_of(rules)))) == rules
    named = rc.rules_from([{"kind": "equals", "document": "x", "path": ["n"], "baseline": "primary_cohort"}], FROZEN)
    assert named == [rc.Rule("equals", "x", ("n",), 7)]
    with pytest.raises(ValueError, match="no such kind"):
        rc.Rule("smells", "x")
    with pytest.raises(ValueError, match="no baseline value"):
        rc.rules_from([{"kind": "equals", "document": "x", "baseline": "other"}], FROZEN)


def test_every_field_and_hash_is_required(spark):
    paths = [("audit", f) for f in release.AUDIT_FIELDS] + [("mmseqs", f) for f in release.CLUSTERING_FIELDS]
    paths += [("split", f) for f in release.SPLIT_FIELDS] + [("audit", *p) for p in release.AUDIT_HASHES]
    results = run(spark, [changed(GOOD, *p) for p in paths], release.release_rules(FROZEN))
    for path, errors in zip(paths, results):
        assert any(".".join(path) in e for e in errors), path


def test_handed_over_receipts(spark):
    base = {**GOOD, "dataset": REPRODUCED["b_data"], "dataset_split": REPRODUCED["b_split"]}
    rules = release.handover_rules("dataset", FROZEN) + release.handover_rules("dataset_split", FROZEN)
    cases = [
        (base, []),
        (changed(base, "dataset", "counts", "primary", value=8), ["dataset.counts.primary: 8 instead of 7"]),
        (changed(base, "dataset", "outputs", "members_sha256", value=E), ["dataset.outputs.members_sha256 differs from audit.output_sha256.members.csv"]),
        (changed(base, "dataset", "source", "source_member_sha256"), ["dataset.source.source_member_sha256: not a SHA-256 digest"]),
        (changed(base, "dataset_split", "cluster_leakage", value=True), ["dataset_split.cluster_leakage: true instead of false"]),
        (changed(base, "dataset_split", "cluster_counts", "validation", value=2), ["dataset_split.cluster_counts.validation: 2 instead of 1"]),
        (changed(base, "dataset_split", "split_manifest_sha256", value=A), ["dataset_split.split_manifest_sha256 differs from split.split_manifest_sha256"]),
        (changed(base, "dataset_split", "comparison", "counts_match_frozen", value=False),
         ["dataset_split.comparison.counts_match_frozen: false instead of true"]),
        (changed(base, "dataset"), []),
    ]
    for got, (_, expected) in zip(run(spark, [x for x, _ in cases], rules), cases):
        assert got == expected
    own = {**release.HANDED_OVER["structure"], "equals": {n: EXPECTED[n] for n in ("pdb_id", "chain", "n_modeled_residues")},
           "begins": {"hmm.accession": "PX1"}}
    good = {"structure": STRUCTURE}
    cases = [good, changed(good, "structure", "chain", value="A"), changed(good, "structure", "n_modeled_residues", value=6),
             changed(good, "structure", "purpose", value="labels"), changed(good, "structure", "hmm", "sha256", value="x"),
             changed(good, "structure", "hmm", "accession", value="QX1")]
    assert [len(e) for e in run(spark, cases, release.handover_rules("structure", FROZEN, own))] == [0, 1, 1, 1, 1, 1]
    good = {"scan": SCAN}
    cases = [good, changed(good, "scan", "parameters", "validation_used_for_conservation", value=True),
             changed(good, "scan", "n_sequences", value=8), changed(good, "scan", "by_split"), {"scan": None}]
    assert [len(e) for e in run(spark, cases, release.handover_rules("scan", FROZEN))] == [0, 1, 1, 1, 0]


def test_manifest_rules(spark):
    schema = "homology_cluster string, split string"
    good = spark.createDataFrame([("a", "discovery"), ("a", "discovery"), ("b", "validation")], schema)
    assert release.manifest_errors(good).isEmpty()
    bad = good.unionByName(spark.createDataFrame([("a", "validation"), (" ", "discovery")], schema))
    assert sorted(r["error"] for r in release.manifest_errors(bad).collect()) == [
        "manifest: cluster in several splits: a", "manifest: rows without cluster or split: 1",
    ]


def test_command_line_exit_codes(spark, tmp_path, capsys):
    for name, value in {**GOOD, "frozen": FROZEN}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))

    def validate(**paths):
        names = {n: str(tmp_path / f"{n}.json") for n in ("audit", "mmseqs", "split", "frozen")} | paths
        return main(["validate", *[x for n, p in names.items() for x in (f"--{n}", p)]])

    assert validate() == 0
    (tmp_path / "bad.json").write_text(json.dumps(changed(GOOD, "audit", "source")["audit"]))
    assert validate(audit=str(tmp_path / "bad.json")) == 1
    assert "audit.source: no value" in capsys.readouterr().err
    (tmp_path / "dataset.json").write_text(json.dumps(REPRODUCED["b_data"]))
    (tmp_path / "m.csv").write_text("homology_cluster,split\na,discovery\na,validation\n")
    names = [x for n in ("audit", "mmseqs", "split", "frozen") for x in (f"--{n}", str(tmp_path / f"{n}.json"))]
    more = ["--receipt", f"dataset={tmp_path}/dataset.json"]
    assert main(["validate", *names, *more]) == 0
    assert main(["validate", *names, "--receipt", f"other={tmp_path}/dataset.json"]) == 2
    capsys.readouterr()
    assert main(["validate", *names, *more, "--manifest", str(tmp_path / "m.csv")]) == 1
    assert "manifest: cluster in several splits: a" in capsys.readouterr().err
    (tmp_path / "rules.json").write_text(json.dumps({"dataset": {"equals": {"status": "new"}}}))
    assert main(["validate", *names, *more, "--rules", str(tmp_path / "rules.json")]) == 1
    assert 'dataset.status: "ok" instead of "new"' in capsys.readouterr().err
    assert validate(split=str(tmp_path / "none.json")) == 1
    assert "missing receipt" in capsys.readouterr().err


def test_report_tables(spark):
    schema = ("internal_id string, sequence_id string, sequence string, sequence_length int, analysis_cohort string, "
              "is_partial_any_member boolean, has_type_conflict boolean, sequence_qc_eligible boolean, is_length_outlier boolean")
    metadata = spark.createDataFrame([
        ("r2", "s2", "AC", 2, "primary", False, False, True, False), ("r1", "s1", "AD", 60, "primary", False, False, True, False),
        ("r3", "s3", "AX", 61, "excluded_sequence_qc", True, False, False, False)], schema)
    rows = {r["check"]: r for r in report.spot_checks(metadata).collect()}
    assert rows["primary"]["internal_id"] == "r1" and rows["partial"]["internal_id"] == "r3"
    assert rows["length_outlier"]["internal_id"] is None
    assert rows["length_outlier"]["conclusion"] == "No length outlier under the rule."
    coordinates = spark.createDataFrame([("r1", 1, 2, "D", 1, False), ("r2", 1, 1, "A", None, True)],
                                        "internal_id string, domain_number int, raw_position int, residue string, hmm_match_state int, is_insertion boolean")
    status = spark.createDataFrame([("r1", "discovery", "accepted", 0), ("r2", "validation", "accepted", 0)],
                                   "internal_id string, split string, status string, n_deleted_match_states int")
    found = {r["check"]: r["conclusion"] for r in report.coordinate_spot_checks(coordinates, metadata, status).collect()}
    assert found == {"hmm_residue_identity": "residue agrees with the sequence", "hmm_insertion": "found", "hmm_deletion": "none found"}
    pairs = spark.createDataFrame([("r1", "r1"), ("r1", "r2")], "cluster string, member string")
    tables = report.figure_tables(metadata, pairs, status, coordinates, 3)
    assert [r["n"] for r in tables["hmm_occupancy"].orderBy("state").collect()] == [1, 0, 0]
    assert tables["length_distribution"].agg(F.sum("n")).first()[0] == 2
    assert report.plotted_equals_source(tables["cohort_counts"], metadata).isEmpty()
    assert list(tables["filter_flow"].first()) == [3, 2]
    with pytest.raises(ValueError, match="unknown analysis_cohort"):
        report.cohort_table(metadata.withColumn("analysis_cohort", F.lit("new")))
    text = report.render_spot_checks([r.asDict() for r in rows.values()], "d", "s")
    assert "| primary | r1 | s1 |" in text
    assert "- None." in report.render_validation([], ["n"], [{"name": "0.8", "n_clusters": 1, "max_cluster_size": 2, "n_singletons": 0, "agreement": 1.0}])
