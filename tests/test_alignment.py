import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from sievework.functions import alignment as al

SCHEMA = "i int, p string, t string, pf int, tf int, tt int, s string, n int"


def expand(spark, rows):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)
    cells = al.alignment_columns(F.col("p"), F.col("t"), F.col("pf"), F.col("tf"))
    named = [F.col(c) for c in ("p", "t", "pf", "tf", "tt", "s", "n")]
    return df.withColumn("c", cells).select(
        "i", "c", al.alignment_error(*named).alias("e"),
        al.deleted_states(F.col("pf"), F.lit(8), al.match_states(F.col("c"))).alias("d"),
    ).orderBy("i").collect()


def test_insertion_and_deletion(spark):
    row = expand(spark, [("AB.CD", "AXY-D", 5, 10, 13, "Q" * 9 + "AXYD", 10)])[0]
    assert [(c["raw_position"], c["match_state"], c["is_insertion"]) for c in row["c"]] == [
        (10, 5, False), (11, 6, False), (12, None, True), (13, 8, False),
    ]
    assert row["e"] is None and row["d"] == [7]


def test_each_rule_is_reported(spark):
    good = ("AB.CD", "AXY-D", 5, 10, 13, "Q" * 9 + "AXYD", 10)

    def change(**kw):
        names = ("p", "t", "pf", "tf", "tt", "s", "n")
        return tuple(kw.get(n, v) for n, v in zip(names, good))

    cases = [
        (change(s="Q" * 9 + "AXWD"), "full input sequence"), (change(n=7), "out of range"),
        (change(tt=14), "target_to"), (change(p="AB"), "length"), (change(pf=0), "origin"),
        (change(p="A1.CD"), "symbol"), (change(t="-----"), "no aligned residues"),
        (change(n=5, s="Q" * 9 + "AXWD"), "out of range"), (change(n=7, s="Q" * 9 + "AXWD"), "full input sequence"),
    ]
    for row, (_, message) in zip(expand(spark, [c for c, _ in cases]), cases):
        assert message in row["e"]


def test_random_alignments_match_a_plain_walk(spark):
    rng = random.Random(3)
    rows, expected = [], []
    for _ in range(60):
        n = rng.randint(1, 60)
        p = "".join(rng.choice("ACD.") for _ in range(n))
        t = "".join(rng.choice("acdE-.") for _ in range(n))
        pf, tf = rng.randint(1, 9), rng.randint(1, 9)
        state, position, cells = pf, tf, []
        for a, b in zip(p, t):
            if b not in "-.":
                cells.append((position, None if a == "." else state, a == ".", b.upper()))
                position += 1
            state += a != "."
        rows.append((p, t, pf, tf, 0, "", 99))
        expected.append(cells)
    assert [[tuple(c) for c in r["c"]] for r in expand(spark, rows)] == expected


def test_domains_of_a_row_fail_alone(spark):
    domain = "struct<hmm_from:int,hmm_to:int,target_from:int,target_to:int,hmm_sequence:string,target_sequence:string>"
    rows = [
        (1, "MAXYD", [(5, 8, 2, 5, "AB.CD", "AXY-D"), (1, 2, 1, 2, "MA", "Mz")]), (2, "A", []), (3, None, None),
        (4, None, [(1, 1, 1, 1, "A", "A")]), (5, "A", [(None, 1, 1, 1, None, "A")]),
    ]
    df = spark.createDataFrame(rows, f"i int, s string, d array<{domain}>").repartition(1)
    got = {r.i: r.x for r in df.select("i", al.aligned_domains(F.col("d"), F.col("s"), 10).alias("x")).collect()}
    assert [(x.number, len(x.cells), list(x.deleted)) for x in got[1]] == [(1, 4, [7]), (2, 2, [])]
    assert got[1][0].error is None and "full input" in got[1][1].error
    assert got[2] == [] and got[3] == []
    assert got[4][0].error is None and got[5][0].cells is None and "no aligned" in got[5][0].error


def test_length_costs_linear_time():
    def spent(n):
        p, t = ["A.CD" * n] * 4, ["AC-D" * n] * 4
        ones = pa.array([1] * 4, pa.int32())
        begin = time.perf_counter()
        walk = al.Walk(p, t, ones, ones)
        walk.cells()
        walk.errors(ones, ["ACD" * n] * 4, pa.array(range(4)).to_numpy(), ones)
        return time.perf_counter() - begin

    spent(1000)
    assert spent(200_000) < 30 * max(spent(20_000), 0.002)
