"""Cases in which inputs are unusual but legal, or plainly wrong."""

import pytest
from pyspark.sql import functions as F

from sievework.functions.rules import bad_number, parse_nonnegative
from sievework.operators import constraints
from sievework.operators.constraints import coordinate_integrity
from sievework.plans.release import FROZEN_PATHS, validate_release
from sievework.sources.delimited import read_csv
from sievework.sources.fasta import headless_files, read_fasta
from sievework.sources.matches import root_attributes


def test_number_grammar(spark):
    cells = ["1", " 2.5 ", ".5", "1e3", "1d", "1f", "0x1p3", "inf", "-1", ""]
    df = spark.createDataFrame([(c,) for c in cells], "raw string")
    got = {r["raw"]: (r["v"], r["bad"]) for r in df.select("raw", parse_nonnegative(F.col("raw")).alias("v"), bad_number(F.col("raw")).alias("bad")).collect()}
    assert [got[c] for c in cells[:4]] == [(1.0, False), (2.5, False), (0.5, False), (1000.0, False)]
    assert all(got[c] == (None, True) for c in cells[4:9]) and got[""] == (None, False)


def test_long_prologue(spark, tmp_path):
    path = tmp_path / "r.xml"
    path.write_text("<?xml version='1.0'?>\n<!-- <old> -->\n" + "\n" * 40 + '<results version="5.1"\n other="x"><protein/></results>')
    assert root_attributes(spark, str(path)) == {"version": "5.1", "other": "x"}
    path.write_text('<results version="5.1"><protein a="b"/></results>')
    assert root_attributes(spark, str(path)) == {"version": "5.1"}


def test_csv_parts_must_agree(spark, tmp_path):
    (tmp_path / "p0.csv").write_text("a,b\n1,2\n")
    (tmp_path / "p1.csv").write_text("b,a\n2,1\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path)).collect()


def test_fasta_after_blank_lines(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("\n\n>x\nACD\n>y\nEF\n")
    (tmp_path / "b.fasta").write_text("text\n>z\nACD\n")
    good, bad = str(tmp_path / "a.fasta"), str(tmp_path / "b.fasta")
    assert headless_files(spark, good).count() == 0 and headless_files(spark, bad).count() == 1
    assert sorted(map(tuple, read_fasta(spark, good).collect())) == [("x", "ACD"), ("y", "EF")]


def test_frozen_names(spark):
    some = dict.fromkeys(list(FROZEN_PATHS)[1:], 1) | {"misspelled": 1}
    empty = [F.parse_json(F.lit("{}")).alias(n) for n in ("audit", "mmseqs", "split")]
    errors = {r["error"] for r in validate_release(spark.range(1).select(F.lit("r").alias("release"), *empty), some).collect()}
    assert "misspelled is not a frozen name" in errors and f"{next(iter(FROZEN_PATHS))} has no frozen value" in errors


def test_coordinates_of_long_sequences(spark):
    long = "ACDE" * 5000
    sequences = spark.createDataFrame([("s", long)], "id string, seq string")
    rows = [("s", 1, "A", "u"), ("s", 20000, "E", "u"), ("s", 20001, "A", "u"), ("s", 2, "X", "u"), ("t", 1, "A", "u")]
    found = coordinate_integrity(spark.createDataFrame(rows, "id string, pos int, res string, unit string"), sequences, "id", "pos", "res", "seq", ["id", "unit"])
    assert found.count() == 3


def test_coordinate_check_sends_no_letters_whole(spark, tmp_path):
    spark.range(3000).selectExpr("cast(id as string) id", "repeat('ACDEF', 20 + int(id % 30)) seq").write.parquet(str(tmp_path / "s"))
    sequences = spark.read.parquet(str(tmp_path / "s"))
    cells = sequences.select("id", F.posexplode(F.split("seq", "")).alias("i", "res")).filter("res <> ''")
    cells = cells.select("id", (F.col("i") + 1).alias("pos"), F.when(F.col("i") == 65, "X").otherwise(F.col("res")).alias("res"))
    odd = spark.createDataFrame(
        [("0", 64, "E"), ("0", 101, "A"), ("0", 0, "C"), ("none", 5, "A"), (None, 5, "A"), ("1", None, "C"), ("1", 2, None)], "id string, pos int, res string"
    )
    found = coordinate_integrity(cells.filter("id >= '2'").unionByName(odd).unionByName(odd.limit(1)), sequences, "id", "pos", "res", "seq", ["id"])
    rows = sorted(map(tuple, found.filter("detail <> 'A' or key is null or key < '2'").collect()), key=str)
    assert rows == sorted([
        ("coordinate uniqueness", "0,64", "2 rows"), ("residue identity", "0:101", ""), ("residue identity", "0:0", "A"),
        ("residue identity", "none:5", "unknown sequence"), ("residue identity", "5", ""), ("residue identity", "1", "A"),
        ("coordinate uniqueness", "5", "blank key"), ("coordinate uniqueness", "1", "blank key"),
    ], key=str)
    assert found.filter("rule = 'residue identity' and detail = 'A' and key like '%:66'").count() == cells.filter("id >= '2' and pos = 66").count()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_counts_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(constraints, "ROWS_A_TASK", 100, raising=False)
    cells = spark.range(500).selectExpr("cast(id % 7 as int) k", "if(id % 11 = 0, null, int(id % 50)) v")
    stored = spark.createDataFrame([(k, 40 + k) for k in (*range(6), 5, 9)] + [(0, None)], "k int, n int")
    table = constraints.reconcile_counts(stored, {"n": cells}, "k")
    want = {k: len({i % 50 for i in range(500) if i % 7 == k and i % 11}) for k in range(7)}
    got = {r["k"]: (r["n"], r["n_stored"], r["state"]) for r in table.collect()}
    plain = {k: (want[k], 40 + k, "agrees" if want[k] == 40 + k else "differs") for k in range(1, 5)}
    assert got == plain | {
        0: (want[0], 40, "repeated record"), 5: (want[5], 90, "repeated record"), 6: (want[6], 0, "unknown record"), 9: (0, 49, "differs"),
    }
    plan = table._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("Initial Plan")[-1].splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 2 and any("hashpartitioning(k#" in line and ", 5), REPARTITION_BY_NUM" in line for line in dealt)
