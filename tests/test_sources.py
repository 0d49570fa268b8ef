import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.operators import constraints as c
from sievework.operators import receipts as rc
from sievework.plans import release
from sievework.sinks import fasta as fasta_sink
from sievework.sinks import tables as sinks
from sievework.sinks.runs import guarded_folder, receipt
from sievework.sinks.storage import Place
from sievework.sources import archives, arrays, delimited, documents, matches, structures
from sievework.sources.fasta import fasta_violations, headless_files, read_fasta


def make_zip(path, name, text):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, text)
    return str(path)


def test_zip_records_keep_their_order(spark, tmp_path, monkeypatch):
    records = [{"n": i, "t": 'a"]},{[é', "x": [1, {"y": 2}]} for i in range(500)]
    path = make_zip(tmp_path / "a.zip", "in/rows.json", "﻿" + json.dumps(records, ensure_ascii=False, indent=1))
    df = archives.read_zip_records(spark, path, "in/rows.json")
    rows = df.orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(1, 501))
    assert [json.loads(r["record"]) for r in rows] == records
    found = archives.read_zip_provenance(spark, path, "in/rows.json").first()
    raw = zipfile.ZipFile(path).read("in/rows.json")
    assert found["source_member_sha256"] == hashlib.sha256(raw).hexdigest()
    assert found["source_member_size"] == len(raw)
    assert found["source_zip_sha256"] == documents.file_digest(path) and found["source_zip"] == "a.zip"


def test_small_chunks_give_the_same_elements():
    records = [{"k": "ä€😀" * i, "n": -1.5e3} for i in range(1, 40)]
    body = json.dumps(records, ensure_ascii=False).encode()
    for size in (1, 2, 7, 64):
        assert [json.loads(x) for x in arrays.array_elements(io.BytesIO(body), "x", size)] == records


@pytest.mark.parametrize("body, message", [
    ("[]", "non-empty"), (" [ ] ", "non-empty"), ("{}", "non-empty"), ("{", "Invalid JSON"), ("", "Invalid JSON"),
    ("[{}", "Invalid JSON"), ("[{} {}]", "Invalid JSON"), ("[{}] x", "Invalid JSON"), ("[1]", "must be an object"),
    ("[{},]", "Invalid JSON"),
])
def test_bad_arrays(body, message):
    with pytest.raises(ValueError, match=message):
        list(arrays.array_elements(io.BytesIO(body.encode()), "x"))


def test_missing_and_nested_members(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/rows.json", '[{"a": 1}]')
    path = make_zip(tmp_path / "outer.zip", "in.zip", inner.getvalue())
    assert archives.read_record_array(spark, f"{path}::in.zip::deep/rows.json").first()["record"] == '{"a": 1}'
    with pytest.raises(Exception, match="possible members.*deep/rows.json"):
        archives.read_record_array(spark, f"{path}::in.zip::rows.json").collect()
    plain = tmp_path / "p.json"
    plain.write_text('[{"a": 2}]')
    assert archives.read_record_array(spark, str(plain)).count() == 1


def test_csv_is_strict(spark, tmp_path):
    def read(text, required=None, **kw):
        path = tmp_path / f"{hashlib.md5(text.encode()).hexdigest()}.csv"
        path.write_text(text, encoding="utf-8")
        return [tuple(r) for r in delimited.read_csv(spark, str(path), required, **kw).collect()]

    assert read('﻿a,b\n1,"x, ""y"""\n2,\n3\n', {"a"}) == [("1", 'x, "y"'), ("2", ""), ("3", "")]
    for text, required, message in [
        ("a,a\n1,2\n", None, "repeated"), ("a,b\n1,2\n", {"c"}, "Missing"), ("a,b\n", None, "Empty"),
        ("a,b\n1,2,3\n", None, "malformed"), ("a,b\n1,2,\n", None, "malformed"),
    ]:
        with pytest.raises(ValueError, match=message):
            read(text, required)
    assert read('a,b\n1,"x,y"\n') == [("1", "x,y")]
    assert read('a,b\n1,"x\ny"\n', multi_line=True) == [("1", "x\ny")]


def test_csv_roundtrip_and_no_overwrite(spark, tmp_path):
    rows = [("2", None), ("1", 'q"u,o'), ("3", " s ")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = str(tmp_path / "out")
    sinks.write_csv(df, out, ["b", "a"], ["a"])
    back = delimited.read_csv(spark, out)
    assert back.columns == ["b", "a"]
    assert sorted((r["a"], r["b"]) for r in back.collect()) == [("1", 'q"u,o'), ("2", ""), ("3", " s ")]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_csv(df, out, ["b", "a"])
    with pytest.raises(ValueError, match="field list"):
        sinks.write_csv(df, str(tmp_path / "x"), ["a"])
    sinks.write_csv(df, str(tmp_path / "y"), ["a", "new"], strict=False)
    assert {tuple(r) for r in delimited.read_csv(spark, str(tmp_path / "y")).collect()} == {("1", ""), ("2", ""), ("3", "")}


def test_eligible_rows(spark):
    df = spark.createDataFrame(
        [(" a ", "s", " TRUE "), ("b", "s", "false"), ("c", " ", "true"), ("a", "t", "true")],
        "internal_id string, sequence_id string, sequence_qc_eligible string",
    )
    kept = delimited.eligible_rows(df)
    assert sorted(r["internal_id"] for r in kept.collect()) == ["a", "a", "c"]
    found = {(r["rule"], r["key"]) for r in delimited.eligible_violations(kept).collect()}
    assert found == {("eligible id", "a"), ("blank sequence id", "c")}


def test_fasta(spark, tmp_path):
    df = spark.createDataFrame([("b", "AC" * 60), ("a", "D"), ("c", "")], "id string, s string")
    out = str(tmp_path / "fa")
    fasta_sink.write_fasta(df.filter("s <> ''"), out, "id", "s")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "fa").glob("part-*"))).splitlines()
    assert lines == [">a", "D", ">b", ("AC" * 60)[:80], ("AC" * 60)[80:]]
    back = read_fasta(spark, out)
    assert {tuple(r) for r in back.collect()} == {("a", "D"), ("b", "AC" * 60)}
    c.enforce(fasta_violations(back))
    bad = tmp_path / "bad.fa"
    bad.write_bytes(b">x y\r\nACB\r\n>z\r\n>w\nAC\n>w\nAC\n")
    found = {(r["rule"], r["key"]) for r in fasta_violations(read_fasta(spark, str(bad))).collect()}
    assert found == {("invalid FASTA ID", "x y"), ("invalid FASTA sequence", "x y"), ("empty sequence", "z"),
                     ("repeated FASTA ID", "w")}
    assert read_fasta(spark, str(bad), first_token=True).first()["internal_id"] == "x"
    assert headless_files(spark, str(bad)).isEmpty()
    head = tmp_path / "head.fa"
    head.write_text("ACD\n>a\nAC\n")
    assert headless_files(spark, str(head)).count() == 1


PDB = """HEADER    TEST STRUCTURE
SEQRES   1 N    4  ALA CYS ASP GLY
HELIX    1   1 CYS N    2  ASP N    3  1                                   2
SHEET    1   A 1 ASP N   3  GLY N   4  0
ATOM      1  N   CYS N   2      10.000  10.000  10.000
ATOM      2  CA ACYS N   2      10.000  10.000  10.000
ATOM      3  CA BCYS N   2      10.000  10.000  10.000
ATOM      4  CA  ASP N   3      10.000  10.000  10.000
ATOM      5  CA  GLY N   4      10.000  10.000  10.000
ATOM      6  CA  GLY N   4      10.000  10.000  10.000
ATOM      7  CA  MSE M   1      10.000  10.000  10.000
"""


def test_structure_file(spark, tmp_path):
    path = tmp_path / "s.pdb"
    path.write_bytes(PDB.encode() + b"REMARK \xe9\n")
    lines = structures.read_lines(spark, str(path))
    modelled = structures.modelled_residues(lines, "N")
    rows = [(r["residue_number"], r["amino_acid"], r["secondary_structure"]) for r in modelled.orderBy("residue_number").collect()]
    assert rows == [(2, "C", "H"), (3, "D", "H"), (4, "G", "E")]
    deposited = structures.deposited_residues(lines, "N")
    assert "".join(r["residue"] for r in deposited.orderBy("deposited_position").collect()) == "ACDG"
    c.enforce(structures.numbering_violations(deposited, modelled))
    assert structures.modelled_residues(lines, "M").first()["amino_acid"] == "X"
    with pytest.raises(ValueError, match="one character"):
        structures.modelled_residues(lines, "NM")
    wrong = tmp_path / "w.pdb"
    wrong.write_text(PDB.replace("N    4  ALA", "N    5  ALA"))
    with pytest.raises(Exception, match="SEQRES is missing"):
        structures.deposited_residues(structures.read_lines(spark, str(wrong)), "N").collect()

    from sievework.plans import structure

    aligned = spark.createDataFrame(
        [(2, 1, False), (3, None, True), (4, 2, False)], "raw_position int, match_state int, is_insertion boolean"
    ).join(deposited.select("file").distinct())
    mapped = structure.structure_map(deposited, modelled, aligned)
    assert list(structure.structure_summary(mapped).drop("file").first()) == [4, 3, 1, 3, 3, 2, 1, 2]
    assert structure.alignment_violations(aligned).isEmpty()


def test_xml_keeps_empty_and_missing_apart(spark, tmp_path):
    path = tmp_path / "r.xml"
    path.write_text(
        '<?xml version="1.0"?>\n<protein-matches xmlns="http://x" interproscan-version="5.1-1.0">\n'
        '<protein><sequence>AC</sequence><xref id="a"/><matches/></protein>\n'
        '<protein><sequence md5="q">AC</sequence><xref id="b"/></protein>\n</protein-matches>\n'
    )
    rows = {r["xref"][0]["_id"]: r for r in matches.read_proteins(spark, str(path)).collect()}
    assert rows["a"]["matches"] is not None and rows["b"]["matches"] is None
    assert rows["a"]["sequence"]["_VALUE"] == "AC" and rows["b"]["sequence"]["_md5"] == "q"
    assert matches.root_attributes(spark, str(path))["interproscan-version"] == "5.1-1.0"


def test_control_documents(spark, tmp_path):
    good = {"signature_database": "D", "signature_accession": "S1", "max_sequence_evalue": 1e-5,
            "max_domain_evalue": 1e-5, "min_hit_length": 30, "min_hmm_coverage": 0.5}
    path = tmp_path / "r.json"

    def load(**change):
        path.write_text(json.dumps({**good, **change}))
        return documents.load_rules(path, "D", "S1")

    assert load().min_hit_length == 30
    for change in ({"signature_accession": "S2"}, {"min_hit_length": 0}, {"min_hit_length": "3"},
                   {"min_hmm_coverage": 1.1}, {"max_domain_evalue": True}):
        with pytest.raises(ValueError):
            load(**change)
    header = "HMMER3/f [x]\nNAME  t\nACC   PX1.2\nLENG  39\nGA    25.00 24.50;\nHMM   A\n ACC junk\n"
    fields = documents.profile_header(header, "PX1")
    assert documents.profile_cutoffs(fields) == (39, 25.0, 24.5)
    for text in ("NOPE", header + header, header.replace("PX1.2", "PX2.2"), header.replace("GA ", "XX ")):
        with pytest.raises(ValueError):
            documents.profile_header(text, "PX1")
    ok = {"url": "u", "sha256": "d", "retrieved_utc": "t"}
    receipts = [ok, [ok], {"source_url": "u", **ok}, [ok, ok], {**ok, "sha256": "e"}, {**ok, "retrieved_utc": ""}, {**ok, "url": "v"}, "x", []]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(receipts)], "n int, body string")
    rows = rows.select("n", F.parse_json("body").alias("receipt"))
    found = rc.broken_rules(release.source_entries(rows), "n", release.source_rules("d", "u")).groupBy("n").count().collect()
    assert dict(map(tuple, found)) == {3: 1, 4: 1, 5: 1, 6: 1, 7: 3, 8: 3}
    assert documents.load_receipt(tmp_path / "none")[1][0].startswith("missing receipt")
    path.write_text("{")
    assert documents.load_receipt(path)[1][0].startswith("unreadable receipt")
    path.write_text("[]")
    assert documents.load_receipt(path)[1][0].endswith("is not a JSON object")


@pytest.mark.parametrize("text, found", [
    ("<?xml version='1.0'?><!-- a > <b c='d'> --><results interproscan-version='5.1'><protein/></results>", {"interproscan-version": "5.1"}),
    ('<!DOCTYPE r [<!ENTITY x "<y z=\'1\'>">]>\n<r a = "1 > 0" b=\'say "x"\' c="&lt;&quot;"/>', {"a": "1 > 0", "b": 'say "x"', "c": '<"'}),
    ("\ufeff<n:r xmlns:n='u'>", {"xmlns:n": "u"}), ("no tags", {}), ("<!-- <r a='1'> ", {}),
])
def test_root_of_a_scan(spark, tmp_path, text, found):
    (tmp_path / "x.xml").write_text(text, encoding="utf-8")
    assert matches.root_attributes(spark, str(tmp_path / "x.xml")) == found


def test_output_appears_at_once_or_not_at_all(spark, tmp_path):
    uri = f"file://{tmp_path}/out"
    with guarded_folder(uri) as folder:
        spark.range(3).write.json(f"{folder}/rows")
        sinks.write_document(folder / "x.json", {"a": 1})
        assert not (tmp_path / "out").exists()
    assert documents.load_object(f"{uri}/x.json") == {"a": 1} and spark.read.json(f"{uri}/rows").count() == 3
    assert Place(f"{uri}/x.json").digest() == documents.file_digest(tmp_path / "out" / "x.json")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    (tmp_path / "late").mkdir()
    with pytest.raises(RuntimeError), guarded_folder(f"file://{tmp_path}/late") as folder:
        sinks.write_document(folder / "x.json", {"a": 1})
        raise RuntimeError("x")
    assert [p.name for p in (tmp_path / "late").iterdir() if p.suffix != ".crc"] == ["FAILED.txt"]
    with pytest.raises(Exception), guarded_folder(tmp_path / "taken"):
        (tmp_path / "taken").mkdir()
        (tmp_path / "taken" / "other").write_text("x")
    assert (tmp_path / "taken" / "other").read_text() == "x"


def test_runs_and_registry(spark, tmp_path):
    assert sinks.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}\n'.encode()
    target = tmp_path / "d" / "x.json"
    sinks.write_document(target, {"a": 1})
    with pytest.raises(FileExistsError):
        sinks.write_document(target, {"a": 1})
    with pytest.raises(RuntimeError):
        with guarded_folder(tmp_path / "run"):
            raise RuntimeError("x")
    assert (tmp_path / "run" / "FAILED.txt").exists()
    with pytest.raises(ValueError, match="Refusing to overwrite"):
        with guarded_folder(tmp_path / "run"):
            pass
    assert receipt({"i": "1"}, {"o": "2"}, 3, note="n")["seed"] == 3
    table = spark.createDataFrame([("r1", "old"), ("r2", "b")], "id string, v string")
    new = spark.createDataFrame([("r1", "new")], "id string, v string")
    with pytest.raises(ValueError, match="already registered"):
        sinks.upsert_rows(table, new, "id")
    assert {tuple(r) for r in sinks.upsert_rows(table, new, "id", replace=True).collect()} == {("r1", "new"), ("r2", "b")}
    assert sinks.markdown_table([{"a": 1, "b": 2}], ["b", "a"])[-1] == "| 2 | 1 |"
