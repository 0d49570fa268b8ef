import statistics

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import constraints as c
from sievework.operators import histograms as h
from sievework.operators import labels as lab
from sievework.operators import quality as q
from sievework.operators.digests import table_digest
from sievework.operators.intervals import label_by_interval, strongest_cover


def numbers(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")


def test_histograms_match_numpy(spark):
    values = [1.0, 2.5, 7.0, 50, 54.9, 55, 174, 175, 179.5, 180, 181, 60, 60, 99]
    df = numbers(spark, values)
    fixed = [r["n"] for r in h.fixed_width(df, "x", 50, 185, 5).orderBy("bin").collect()]
    assert fixed == np.histogram(values, bins=range(50, 185, 5))[0].tolist()
    equal = [r["n"] for r in h.equal_width(df, "x", 7).orderBy("bin").collect()]
    assert equal == np.histogram(values, 7)[0].tolist()
    same = [r["n"] for r in h.equal_width(numbers(spark, [3.0] * 4), "x", 6).orderBy("bin").collect()]
    assert same == np.histogram([3.0] * 4, 6)[0].tolist()


def test_outliers_use_eligible_rows_only(spark):
    values = [10.0] * 20 + [11.0] * 20 + [500.0, 9.0]
    df = numbers(spark, values)
    eligible = F.col("x") < 400
    m, s = statistics.fmean(values[:40] + [9.0]), statistics.pstdev(values[:40] + [9.0])
    got = [r["o"] for r in q.mark_length_outliers(df, "x", eligible, out="o").orderBy("i").collect()]
    assert got == [v < m - 3 * s or v > m + 3 * s for v in values]
    none = q.mark_length_outliers(df, "x", F.lit(False), out="o")
    assert none.filter("o").isEmpty()
    assert q.length_statistics(df, "x", F.col("i") == 0).first()["population_std"] == 0.0


def test_cohort_counts_and_unknown_values(spark):
    sizes = {"primary": 7, "sensitivity_partial": 2, "sensitivity_type_conflict": 3,
             "sensitivity_partial_and_type_conflict": 4, "excluded_sequence_qc": 1}
    rows = [(name,) for name, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "cohort string")
    counted = q.domain_counts(df, "cohort", q.COHORT_LABELS).orderBy("position").collect()
    assert [r["n"] for r in counted] == [7, 2, 3, 4, 1]
    assert q.unknown_values(df, "cohort", q.COHORT_LABELS).isEmpty()
    odd = df.unionByName(spark.createDataFrame([("new",), (None,)], "cohort string"))
    assert {r["cohort"] for r in q.unknown_values(odd, "cohort", q.COHORT_LABELS).collect()} == {"new", None}


def test_first_where(spark):
    df = numbers(spark, [5.0, 7.0, 9.0])
    rows = q.first_where(df, "i", {"big": F.col("x") > 6, "none": F.col("x") > 99}, ["i", "x"]).collect()
    assert [tuple(r) for r in rows] == [("big", 1, 7.0), ("none", None, None)]


def test_intervals_prefer_helix(spark):
    rows = numbers(spark, range(1, 9)).select(F.lit("f").alias("k"), F.col("x").cast("int").alias("p"))
    spans = spark.createDataFrame(
        [("f", 2, 4, "E"), ("f", 3, 5, "H"), ("f", 5, 5, "E"), ("f", 7, 6, "H")], "k string, lo int, hi int, code string"
    )
    got = label_by_interval(rows, "p", spans, ["k"], "lo", "hi", "code", ["H", "E"], "C", "s").orderBy("p").collect()
    assert "".join(r["s"] for r in got) == "CEHHHCCC"


def test_intervals_of_any_length_equal_a_plain_search(spark):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), rng.randint(-60, 60), rng.choice([0, 0, 1, 3, 17, 90, -2]), rng.choice("HEX")) for _ in range(40)]
    spans = [(k, lo, lo + n, c) for k, lo, n, c in spans] + [("c", -(10**9), 10**9, "E"), ("c", 5, 5, "H"), (None, 0, 9, "H"), ("c", None, 9, "H")]
    rows = [(k, p) for k in "abc" for p in range(-70, 160, 3)] * 2 + [(None, 3), ("c", None), ("c", 2 * 10**9)]
    left = spark.createDataFrame(rows, "k string, p int")
    right = spark.createDataFrame(spans, "k string, lo int, hi int, code string")
    got = label_by_interval(left, "p", right, ["k"], "lo", "hi", "code", ["H", "E"], "C", "s")
    assert got.schema["p"].dataType.simpleString() == "int"

    def label(k, p):
        codes = {c for n, lo, hi, c in spans if None not in (k, p, n, lo) and n == k and lo <= p <= hi}
        return "H" if "H" in codes else "E" if "E" in codes else "C"

    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select("k", "p", "s").collect()), key=key) == sorted(((k, p, label(k, p)) for k, p in rows), key=key)
    cells = strongest_cover(left, right.filter("hi = 1000000000"), ["k"], "p", "lo", "hi", F.lit(1))
    assert cells.count() == len({p for k, p in rows if k == "c" and p is not None and p <= 10**9})


def test_constraints_list_and_enforce(spark):
    schema = "k string, s string, n int"
    left = spark.createDataFrame([("a", "AC", 2), ("b", "", 0), ("b", "A", 3), ("", "A", 1)], schema)
    right = spark.createDataFrame([("a", "AC", 9), ("c", "A", 1), ("c", "A", 1)], schema)
    keys = lambda df: sorted((r["key"], r["detail"]) for r in df.collect())
    assert keys(c.unique_key(left, ["k"])) == [("", "blank key"), ("b", "2 rows")]
    assert keys(c.partition_coverage(left, right, "k")) == [
        ("", "missing"), ("b", "missing"), ("c", "unknown member")]
    assert keys(c.partition_coverage(right.filter("k='c'"), right.filter("k='c'"), "k")) == [("c", "appears more than once")]
    assert keys(c.agreement(left, right, "k", ["s", "n"])) == [("a", "n")]
    assert keys(c.sequence_identity(left, "k", "s", "n")) == [("b", "empty"), ("b", "length")]
    with pytest.raises(ValueError, match="2 violations; first: duplicate key"):
        c.enforce(c.unique_key(left, ["k"]))
    values = c.named_values(right.agg(F.count(F.lit(1)).alias("rows")), ["rows"])
    assert c.expected_values(values, {"rows": "3"}).isEmpty()
    assert c.expected_values(values, {"rows": "4", "x": "1"}).count() == 2


def test_coordinates_must_match_their_sequence(spark):
    seqs = spark.createDataFrame([("a", "ACD")], "id string, seq string")
    schema = "id string, dom int, pos int, res string, st int"
    good = spark.createDataFrame([("a", 1, 1, "A", 1), ("a", 1, 3, "D", None), ("a", 2, 1, "A", 2)], schema)
    bad = spark.createDataFrame([("a", 1, 2, "D", 9), ("a", 1, 9, "A", 1), ("b", 1, 1, "A", 1), ("a", 1, 1, "A", 1)], schema)
    run = lambda df: c.coordinate_integrity(df, seqs, "id", "pos", "res", "seq", ["id", "dom"], "st", 5)
    assert run(good).isEmpty()
    found = sorted((r["rule"], r["key"]) for r in run(good.unionByName(bad)).collect())
    assert found == [
        ("coordinate uniqueness", "a,1,1"), ("residue identity", "a:2"), ("residue identity", "a:9"),
        ("residue identity", "b:1"), ("state range", "a:2"),
    ]


def test_labels_need_a_verified_success(spark):
    schema = ("internal_id string, sample_group string, scan_status string, label int, detected int, "
              "submitted boolean, result_present boolean, parse_status string")
    good = [("1", "g", "success", 1, 1, True, True, "success"), ("2", "g", "success", 0, 0, True, True, "success"),
            ("3", "g", "needs_review", None, None, True, True, "success"),
            ("4", "h", "not_submitted", None, None, False, False, "not_submitted")]
    rows = spark.createDataFrame(good, schema)
    assert lab.label_violations(rows, rows).isEmpty()
    table = {r["sample_group"]: r for r in lab.group_summary(rows, "sample_group", ["g", "h", "z"]).collect()}
    assert list(table["g"])[1:] == [3, 3, 2, 1, 1, 1, 0, 1]
    assert list(table["h"])[1:] == [1, 0, 0, 0, 0, 0, 1, 0]
    assert list(table["z"])[1:] == [0] * 8
    bad = [
        (("5", "g", "success", 0, 0, False, True, "success"), "Label without verified"),
        (("5", "g", "failed", 0, 0, True, True, "failed"), "Label without verified"),
        (("5", "g", "success", 2, 2, True, True, "success"), "Label without verified"),
        (("5", "g", "success", None, None, True, True, "success"), "cannot have blank label"),
        (("5", "g", "success", 1, None, True, True, "success"), "inconsistency"),
        (good[0], "duplicate label"),
    ]
    for row, message in bad:
        df = spark.createDataFrame([*good, row], schema)
        with pytest.raises(ValueError, match=message):
            c.enforce(lab.label_violations(df, df))
    with pytest.raises(ValueError, match="ID mismatch"):
        c.enforce(lab.label_violations(rows, rows.limit(3)))


def test_digest_ignores_order_but_not_content(spark):
    rows = [(1, "a", None), (2, "b", ""), (2, "b", "")]
    df = spark.createDataFrame(rows, "i int, s string, t string")
    digest = lambda d: table_digest(d, ["i", "s", "t"]).first()["content_sha256"]
    assert digest(df) == digest(df.repartition(5).orderBy(F.desc("i")))
    assert digest(df) != digest(df.distinct())
    assert digest(df) != digest(df.withColumn("t", F.coalesce("t", F.lit(""))))
