from pyspark.sql import functions as F

from sievework.functions import rules as r


def values(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    return [x[0] for x in df.orderBy("i").select(expr.alias("x")).collect()]


def test_hit_classifier_states(spark):
    rows = [
        (True, 1, None, None), (True, 2, None, None), (False, 0, 24.0, 24.0), (False, 0, 20.0, 20.0),
        (False, 0, None, None), (True, 0, 30.0, 30.0), (False, 0, 40.0, None), (False, 0, 23.0, 40.0),
    ]
    state = r.classify_hit(F.col("h"), F.col("n"), F.col("s"), F.col("d"), 25.0, 25.0, 2.0)
    assert values(spark, rows, "h boolean, n int, s double, d double", state) == [
        "accepted", "multi_hit", "boundary", "weak_hit", "no_hit", "failed", "weak_hit", "boundary",
    ]


def test_review_reasons_in_order(spark):
    rows = [
        (1e-9, 1e-9, 0.9, 40), (1e-5, 1e-9, 0.9, 40), (1e-9, 1e-5, 0.5, 30), (None, 1.0, 0.4, 29),
        (1.0, 1.0, None, 30),
    ]
    expr = r.review_reasons(F.col("e"), F.col("d"), F.col("c"), F.col("l"), r.HitRules())
    assert values(spark, rows, "e double, d double, c double, l int", expr) == [
        "", "weak_or_boundary_evalue", "weak_or_boundary_evalue",
        "significance_missing|low_hmm_coverage|short_hit", "weak_or_boundary_evalue|hmm_coverage_missing",
    ]


def test_numbers(spark):
    rows = [("",), (None,), ("1e-5",), ("0",), ("-1",), ("nan",), ("inf",), ("x",)]
    assert values(spark, rows, "s string", r.parse_nonnegative(F.col("s"))) == [
        None, None, 1e-5, 0.0, None, None, None, None,
    ]
    assert values(spark, rows, "s string", r.bad_number(F.col("s"))) == [
        False, False, False, False, True, True, True, True,
    ]


def test_blank_is_not_negative(spark):
    rows = [
        ("not_submitted", True, False, 0, 0, True), ("", False, False, 0, 0, True), ("", True, True, 0, 0, True),
        ("", True, False, 1, 2, True), ("", True, False, 0, 0, False), ("", True, False, 0, 0, True),
        ("", True, False, 0, 2, False),
    ]
    state = r.scan_state(*[F.col(c) for c in "gpfrhe"])
    schema = "g string, p boolean, f boolean, r int, h int, e boolean"
    states = values(spark, rows, schema, state)
    assert states == [
        "not_submitted", "result_missing", "parse_failed", "needs_review", "needs_review", "success", "success",
    ]
    assert values(spark, rows, schema, r.tri_state_label(state, F.col("h"))) == [None] * 5 + [0, 1]


def test_artifact_states(spark):
    rows = [(None, "a"), ("a", "a"), ("b", "a")]
    assert values(spark, rows, "x string, y string", r.artifact_status(F.col("x"), F.col("y"))) == [
        "unverified_missing", "match", "mismatch",
    ]
