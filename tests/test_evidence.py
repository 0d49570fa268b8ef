"""Structure, figure and artifact jobs, and profiles bound to their download receipts."""

import hashlib
import json

import pytest

from sievework.__main__ import main
from sievework.plans import evidence, jobs, scan
from sievework.operators.split import parse_ratios
from sievework.sources import delimited

from test_jobs import PROFILE, record, zipped
from test_sources import PDB

HMM = "HMMER3/f [x]\nNAME  t\nACC   PX1.2\nLENG  4\nGA    25.00 24.50;\nHMM   A\n"


def domain(target="CDG", **change):
    return {"score_bits": 30.0, "i_evalue": 0.0, "included": True, "reported": True, "hmm_from": 2, "hmm_to": 4,
            "target_from": 2, "target_to": 4, "hmm_sequence": "AAA", "target_sequence": target, **change}


def hit(ident, *domains):
    return {"internal_id": ident, "score_bits": 30.0, "evalue": 0.0, "included": True, "reported": True, "domains": list(domains)}


def receipt_of(path, url="u", **change):
    where = path.parent / f"{path.name}.receipt.json"
    where.write_text(json.dumps([{"url": url, "sha256": hashlib.sha256(path.read_bytes()).hexdigest(), "retrieved_utc": "t", **change}]))
    return where


def test_profile_file_and_its_receipt(spark, tmp_path):
    path = tmp_path / "p.hmm"
    path.write_text(HMM)
    model, bound = evidence.load_profile(spark, str(path), str(receipt_of(path)), "u", "PX1")
    assert (model.length, model.sequence_cutoff, model.domain_cutoff) == (4, 25.0, 24.5)
    assert bound["profile"] == hashlib.sha256(HMM.encode()).hexdigest()
    with pytest.raises(ValueError, match="sha256"):
        evidence.load_profile(spark, str(path), str(receipt_of(path, sha256="0" * 64)), "u", "PX1")
    with pytest.raises(ValueError, match="url"):
        evidence.load_profile(spark, str(path), str(receipt_of(path)), "v", "PX1")
    with pytest.raises(ValueError, match="PX2"):
        evidence.load_profile(spark, str(path), str(receipt_of(path)), "u", "PX2")


def test_structure_job(spark, tmp_path, capsys):
    for name in ("1abc.pdb", "2abc.pdb"):
        (tmp_path / name).write_text(PDB)
    hits = tmp_path / "hits.jsonl"
    write = lambda *rows: hits.write_text("".join(json.dumps(r) + "\n" for r in rows))
    both = [hit("1abc_N", domain()), hit("2abc_N", domain(included=False), domain())]
    write(*both)
    model = scan.ProfileModel(4, 25.0, 24.5)
    run = lambda out, pattern="*.pdb", chain="N": evidence.run_structure(spark, f"{tmp_path}/{pattern}", chain, str(hits), model, str(tmp_path / out))
    counts = run("ok")
    assert counts["structures"] == 2 and counts["n_deposited_residues"] == 8 and counts["n_modeled_hmm_aligned_residues"] == 6
    rows = delimited.read_csv(spark, str(tmp_path / "ok" / "residue_map"))
    assert rows.columns == evidence.STRUCTURE_FIELDS and rows.count() == 8
    first = {r["deposited_position"]: r for r in rows.filter("structure = '1abc'").collect()}
    assert first["1"]["modeled"] == "False" and first["1"]["hmm_aligned"] == "False" and first["1"]["hmm_match_state"] == ""
    assert (first["2"]["secondary_structure"], first["2"]["hmm_match_state"], first["2"]["is_hmm_insertion"]) == ("H", "2", "False")
    from sievework.plans import report

    shown = {r["check"]: r["conclusion"] for r in report.structure_spot_checks(rows).collect()}
    assert shown["structure_modeled"].startswith("position 2 (C)") and shown["structure_unmodeled"] == "position 1 (A): no model"

    write(both[0])
    with pytest.raises(ValueError, match="0 included domains"):
        run("no_hit")
    assert (tmp_path / "no_hit" / "FAILED.txt").exists()
    write(both[0], hit("2abc_N", domain(), domain()))
    with pytest.raises(ValueError, match="2 included domains"):
        run("two_domains")
    write(both[0], hit("2abc_N", domain(target="CDE")))
    with pytest.raises(ValueError, match="not aligned"):
        run("other_residues")
    with pytest.raises(ValueError, match="without deposited residues"):
        run("other_chain", chain="M")
    write(*both)
    (tmp_path / "3abc.txt").write_text("REMARK\n" + PDB)
    with pytest.raises(ValueError, match="without a header"):
        run("headless", "3abc.txt")

    path, profile = tmp_path / "1abc.pdb", tmp_path / "p.hmm"
    profile.write_text(HMM)
    call = ["structure", "--structures", str(path), "--chain", "N", "--hits", str(hits), "--profile", str(profile),
            "--profile-receipt", str(receipt_of(profile)), "--profile-url", "u", "--accession", "PX1",
            "--structure-receipt", str(receipt_of(path)), "--structure-url", "u"]
    assert main([*call, "--output-dir", str(tmp_path / "bound")]) == 0
    note = json.loads((tmp_path / "bound" / "structure_summary.json").read_text())
    assert {"profile", "profile_receipt", "structure", "structure_receipt"} <= set(note["input_sha256"])
    assert main([*call, "--profile-length", "4", "--output-dir", str(tmp_path / "mixed")]) == 2
    capsys.readouterr()


def test_figures_job(spark, tmp_path):
    records = [record(f"s{i}", "A" + "CDEFGH"[i] + "CDEK") for i in range(6)]
    jobs.run_audit(spark, zipped(tmp_path, records), "data/rows.json", str(tmp_path / "audit"), PROFILE, "recs")
    ids = [f"REC_{i:06d}" for i in range(1, 7)]
    clusters = tmp_path / "clusters.tsv"
    clusters.write_text("".join(f"{ids[i - i % 2]}\t{x}\n" for i, x in enumerate(ids)))
    metadata, fasta = str(tmp_path / "audit" / "metadata"), str(tmp_path / "audit" / "sequences_for_clustering")
    jobs.run_split(spark, metadata, str(clusters), str(tmp_path / "split"), parse_ratios("discovery=0.5,validation=0.5"), 1)
    hits = tmp_path / "h.jsonl"
    by_id = {x: r["sequence"] for x, r in zip(ids, records)}
    hits.write_text("".join(json.dumps(hit(x, domain(by_id[x][1:4]))) + "\n" for x in ids[:4]))
    model = scan.ProfileModel(4, 25.0, 24.5)
    jobs.run_scan(spark, metadata, fasta, str(tmp_path / "split" / "split_manifest"), str(hits), str(hits), model,
                  str(tmp_path / "scan"), bound={"profile": "d"})
    assert json.loads((tmp_path / "scan" / "scan_summary.json").read_text())["input_sha256"]["profile"] == "d"
    made = evidence.run_figures(spark, metadata, str(clusters), str(tmp_path / "scan"), str(tmp_path / "figures"), "d1", "s1")
    assert made["hmm_occupancy"] == 4
    read = lambda name: delimited.read_csv(spark, str(tmp_path / "figures" / name))
    occupancy = {tuple(r)[0]: tuple(r)[1] for r in read("hmm_occupancy").collect()}
    assert occupancy == {"1": "0", "2": "4", "3": "4", "4": "4"}
    assert {r["analysis_cohort"]: r["n"] for r in read("cohort_counts").collect()}["primary"] == "6"
    text = (tmp_path / "figures" / "spot_checks.md").read_text()
    assert "residue agrees with the sequence" in text and "Dataset `d1`" in text
    # A coordinate map whose residues are not those of the sequences is found out.
    spoiled = tmp_path / "scan" / "hmm_coordinate_map"
    for part in spoiled.glob("*.csv"):
        part.write_text(part.read_text().replace(",C,", ",W,").replace(",D,", ",W,").replace(",E,", ",W,").replace(",F,", ",W,"))
    for crc in spoiled.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="spot checks failed"):
        evidence.run_figures(spark, metadata, str(clusters), str(tmp_path / "scan"), str(tmp_path / "spoiled"), "d1", "s1")


def test_artifact_audit(spark, tmp_path, monkeypatch):
    bodies = {"a.csv": b"x\ny\n", "b [1].csv": b"x\r\ny\n\xff", "c.csv": b"q\n", "e.bin": b"", "d.csv.gz": b"\x1f\x8b no gzip"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    digest = lambda body: hashlib.sha256(body).hexdigest()
    scan_receipt = {"output": {"a": digest(bodies["a.csv"]), "b": digest(b"x\ny\n\xff"), "c": digest(b"other"), "e": digest(b"")}}
    other = {"sha256": digest(bodies["d.csv.gz"])}
    (tmp_path / "scan.json").write_text(json.dumps(scan_receipt))
    (tmp_path / "other.json").write_text(json.dumps(other))
    entry = lambda name, file, *field, receipt="scan": {"artifact": name, "location": f"{tmp_path}/{file}", "receipt": receipt, "field": list(field)}
    entries = [entry("a", "a.csv", "output", "a"), entry("b", "b [1].csv", "output", "b"), entry("c", "c.csv", "output", "c"),
               entry("e", "e.bin", "output", "e"), entry("d", "d.csv.gz", "sha256", receipt="other"), entry("again", "a.csv", "output", "c"),
               entry("gone", "none.csv", "output", "a"), {**entry("uri", "", "output", "a"), "location": f"file://{tmp_path}/a.csv"}]
    listing = tmp_path / "listing.json"
    receipts = {"scan": str(tmp_path / "scan.json"), "other": str(tmp_path / "other.json")}

    def run(out, rows=entries):
        listing.write_text(json.dumps({"artifacts": rows}))
        counts = evidence.run_artifacts(spark, str(listing), receipts, str(tmp_path / out))
        table = delimited.read_csv(spark, str(tmp_path / out / "artifact_states"))
        return counts, {r["artifact"]: (r["status"], r["line_ends"]) for r in table.collect()}

    expected = {"a": ("match", ""), "b": ("mismatch", "LF"), "c": ("mismatch", ""), "e": ("match", ""), "d": ("match", ""),
                "again": ("mismatch", ""), "gone": ("unverified_missing", ""), "uri": ("match", "")}
    counts, states = run("audit")
    assert states == expected and counts == {"match": 4, "mismatch": 3, "unverified_missing": 1}
    monkeypatch.setattr(evidence, "WHOLE", 2)  # the larger files as streams: no line ends are known of them
    assert run("streamed")[1] == {**expected, "b": ("mismatch", "")}
    assert run("nothing", [entry("gone", "none.csv", "output", "a")])[0] == {"unverified_missing": 1}
    with pytest.raises(ValueError, match="no digest at scan.output.z"):
        run("no_digest", [entry("z", "a.csv", "output", "z")])
    with pytest.raises(ValueError, match="no such receipts"):
        run("no_receipt", [entry("z", "a.csv", "output", "a", receipt="third")])
