import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import similarity as sim
from sievework.operators import selection as sel


def is_near(a, b):
    """The rule as it reads, without any shortcut."""
    if not a or not b:
        return False
    short, long = sorted([len(a), len(b)])
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    return short / long >= 0.8 and common / short >= 0.9 and sum(x.size for x in blocks) / short >= 0.9


@settings(max_examples=300, deadline=None)
@given(st.text("abcé😀", min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.sampled_from(["", "a", "b", "xy"])), max_size=5))
def test_bounds_never_reject_a_near_pair(text, edits):
    other = list(text)
    for place, new in edits:
        if place < len(other):
            other[place] = new
    other = "".join(other)
    assert (sim.Chosen([other]).first_near([text])[0] == 0) == is_near(text, other)


def test_runs_reject_texts_with_equal_letters():
    rng = random.Random(8)
    a = "".join(rng.choices("abcdefgh", k=400))
    b = "".join(sorted(a))
    assert not sim.runs_suffice(sim.code_points(a), sim.code_points(b))
    assert sim.runs_suffice(sim.code_points(a), sim.code_points(a[5:]))


def test_counts_of_characters_take_one_pass(spark):
    df = spark.createDataFrame([(1, "abca😀"), (2, None), (3, ""), (4, "zz")], "i int, t string")
    points = sim.alphabet(df.filter("i < 4"), "t")
    assert [chr(p) for p in points] == ["a", "b", "c", "😀"]
    got = {r.i: list(r.v) for r in df.select("i", sim.count_vectors(points)("t").alias("v")).collect()}
    assert got == {1: [2, 1, 1, 1], 2: [0] * 4, 3: [0] * 4, 4: [0] * 4}
    assert sim.count_matrix(["ab"], np.zeros(0, np.uint32)).shape == (1, 0)


def plain_rule(rows, quotas):
    selected, reasons = [], {}
    for group, quota in quotas.items():
        pool = [r for r in rows if r["g"] == group]
        seen, taken = {n: Counter() for n in "otls"}, 0
        while pool and taken < quota:
            key = lambda r: (seen["o"][r["o"]], seen["t"][r["t"]], seen["l"][len(r["seq"]) // 25], seen["s"][r["s"]], r["rank"])
            row = min(pool, key=key)
            pool.remove(row)
            near = next((x for x in selected if is_near(row["seq"], x["seq"])), None)
            if near:
                reasons[row["id"]] = (sel.NEAR, near["id"])
                continue
            selected.append(row)
            taken += 1
            for name in "ots":
                seen[name][row[name]] += 1
            seen["l"][len(row["seq"]) // 25] += 1
        reasons.update({r["id"]: (sel.UNUSED, None) for r in pool})
    return [r["id"] for r in selected], reasons


@pytest.mark.parametrize("seed, batch", [(1, 3), (2, 20), (3, 1000)])
def test_selection_equals_the_plain_rule(spark, seed, batch):
    rng = random.Random(seed)
    bases = ["".join(rng.choices("ACDEFGHIKL", k=rng.randint(20, 110))) for _ in range(5)]
    ranks = rng.sample(range(1000), 120)
    rows = []
    for i, rank in enumerate(ranks):
        text = list(rng.choice(bases)) if rng.random() < 0.8 else rng.choices("ACDEFGHIKL", k=60)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice("ACDEFG")
        rows.append({"id": str(i), "g": rng.choice("abc"), "seq": "".join(text), "o": rng.choice("pqrs"),
                     "t": rng.choice("xy"), "s": rng.choice("12"), "rank": rank})
    quotas = {"a": 6, "b": rng.randint(0, 4), "c": 50}
    outside = [{**rows[0], "id": "o1", "g": "z", "rank": 2001}, {**rows[1], "id": "o2", "g": None, "rank": 2002}]
    chosen, rejected = sel.diversity_select(
        spark.createDataFrame(rows + outside), quotas, sel.PoolColumns("id", "g", "seq", "o", "t", "s", "rank"), batch
    )
    ids, reasons = plain_rule(rows, quotas)
    reasons |= {r["id"]: (sel.UNUSED, None) for r in outside}
    assert [r["identity"] for r in chosen.orderBy("selection_order").collect()] == ids
    assert {r["identity"]: (r["reason"], r["related_accession"]) for r in rejected.collect()} == reasons


@pytest.mark.parametrize("copied", [sel.COPIED, 0])
def test_first_near_selected_equals_all_pairs(spark, monkeypatch, copied):
    monkeypatch.setattr(sel, "COPIED", copied)
    rng = random.Random(4)
    bases = ["".join(rng.choices("ACDEFG", k=n)) for n in (30, 33, 40, 80)]
    rows = []
    for i in range(120):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice("ACDEFG")
        rows.append((i, "".join(text[: len(text) - rng.randint(0, 9)])))
    picked = rng.sample(rows, 15)
    df = spark.createDataFrame(rows, "id int, s string")
    chosen = spark.createDataFrame([(i, s, n) for n, (i, s) in enumerate(picked)], "id int, s string, o int")
    expected = {}
    for i, s in rows:
        match = next((p for p, x in picked if p != i and is_near(s, x)), None)
        if match is not None:
            expected[i] = match
    got = sel.first_near_selected(df, chosen, "id", "s", "o").collect()
    assert {r["id"]: r["related_accession"] for r in got} == expected and expected
