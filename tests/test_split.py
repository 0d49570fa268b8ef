import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import constraints as c
from sievework.operators import split as s
from sievework.plans import split_job
from sievework.sources.delimited import read_cluster_pairs


def greedy(sizes, ratios, seed):
    """The rule, one cluster at a time."""
    total = sum(sizes.values())
    counts = dict.fromkeys(ratios, 0)
    result = {}
    for name in sorted(sizes, key=lambda n: (-sizes[n], hashlib.sha256(f"{seed}:{n}".encode()).hexdigest())):
        choice = min(ratios, key=lambda r: (counts[r] / (ratios[r] * total), -ratios[r], r))
        result[name] = choice
        counts[choice] += sizes[name]
    return result


@pytest.mark.parametrize("text", ["discovery=0.7,validation=0.3", "a=1,b=1,c=1", "x=0.6,y=0.3,z=0.2,w=0.05"])
def test_allocation_equals_the_sequential_rule(spark, text):
    rng = random.Random(text)
    ratios = s.parse_ratios(text)
    sizes = {f"r{i}": rng.choice([1, 1, 1, 1, 2, 2, 3, 7, rng.randint(1, 60)]) for i in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "cluster string, size bigint")
    got = {r["cluster"]: r["split"] for r in s.allocate_clusters(df, ratios, 42).collect()}
    assert got == greedy(sizes, ratios, 42)


def test_one_giant_cluster_and_many_singletons(spark):
    sizes = {"giant": 900, **{f"s{i}": 1 for i in range(1800)}}
    df = spark.createDataFrame(list(sizes.items()), "cluster string, size bigint")
    ratios = s.parse_ratios("a=0.5,b=0.3,c=0.2")
    got = {r["cluster"]: r["split"] for r in s.allocate_clusters(df, ratios, 1).collect()}
    assert got == greedy(sizes, ratios, 1)


@pytest.mark.parametrize("text", ["a=1", "a=1,a=2", "a=0,b=1", "a=x,b=1", "=1,b=1", "a=nan,b=1", "a=inf,b=1", "a,b"])
def test_bad_ratios(text):
    with pytest.raises(ValueError):
        s.parse_ratios(text)


def test_ratios_are_scaled():
    assert s.parse_ratios(" a = 7, b=3") == {"a": 0.7, "b": 0.3}


def _eligible(spark, names):
    rows = [(n, f"seq-{n}", "primary", "true") for n in names]
    return spark.createDataFrame(
        rows, "internal_id string, sequence_id string, analysis_cohort string, primary_analysis_eligible string"
    )


def _pairs(spark, tmp_path, text):
    path = tmp_path / "clusters.tsv"
    path.write_text(text)
    return read_cluster_pairs(spark, str(path))


def test_split_job(spark, tmp_path):
    pairs = _pairs(spark, tmp_path, "r1\ta\nr1\tb\n\nr2\tc\r\nr3\td\n")
    ratios = s.parse_ratios("discovery=0.7,validation=0.3")
    result = split_job.split_eligible(_eligible(spark, "abcd"), pairs, ratios, 42)
    expected = greedy({"r1": 2, "r2": 1, "r3": 1}, ratios, 42)
    rows = {r["internal_id"]: r for r in result.manifest.collect()}
    assert {k: v["split"] for k, v in rows.items()} == {
        "a": expected["r1"], "b": expected["r1"], "c": expected["r2"], "d": expected["r3"],
    }
    assert rows["a"]["sequence_id"] == "seq-a"
    assert result.summary["total_sequences"] == 4 and result.summary["total_clusters"] == 3
    assert result.summary["cluster_leakage"] is False
    again = split_job.split_eligible(_eligible(spark, "abcd"), pairs, ratios, 42)
    assert again.summary == result.summary


@pytest.mark.parametrize("text, message", [
    ("r1\ta\nr1\tb\nr2\tc\n", "missing"), ("r1\ta\nr2\ta\nr1\tb\nr2\tc\nr3\td\n", "more than once"),
    ("r1\ta\nr1\tb\nr2\tc\nr3\td\nr3\te\n", "unknown member"), ("r1 a\nr1\tb\n", "malformed"),
    ("\ta\nr1\tb\nr1\tc\nr1\td\n", "malformed"), ("\n", "No clusters"),
])
def test_bad_clusters(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        split_job.split_eligible(
            _eligible(spark, "abcd"), _pairs(spark, tmp_path, text), s.parse_ratios("a=1,b=1"), 42
        )


def test_leakage_is_computed(spark):
    manifest = spark.createDataFrame(
        [("x", "discovery"), ("x", "validation"), ("y", "discovery")], "cluster string, split string"
    )
    leaking = s.leaking_clusters(manifest, "cluster", "split")
    with pytest.raises(ValueError, match="x assigned to more than one split"):
        c.enforce(c.leakage(leaking))
    c.enforce(c.leakage(s.leaking_clusters(manifest.filter("split = 'discovery'"), "cluster", "split")))


def test_threshold_sensitivity(spark):
    schema = "internal_id string, homology_cluster string, split string"
    frozen = spark.createDataFrame([("a", "r", "d"), ("b", "r", "d"), ("c", "q", "v")], schema)
    other = spark.createDataFrame([("a", "r", "d"), ("b", "p", "v"), ("c", "q", "v")], schema)
    rows = {r["name"]: r for r in split_job.threshold_sensitivity(frozen, {"same": frozen, "other": other}).collect()}
    assert (rows["same"]["agreement"], rows["same"]["max_cluster_size"], rows["same"]["n_singletons"]) == (1.0, 2, 1)
    assert (rows["other"]["matching"], rows["other"]["agreement"], rows["other"]["n_clusters"]) == (2, 0.666667, 3)


def test_assignment_reaches_every_member_of_a_hot_cluster(spark):
    members = spark.range(1000).select(
        "id", F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("cluster")
    )
    assigned = s.assign_members(
        members, s.allocate_clusters(s.cluster_sizes(members, "cluster"), s.parse_ratios("a=1,b=1"), 3),
        "cluster", F.col("id"),
    )
    assert assigned.count() == 1000 and assigned.select("id").distinct().count() == 1000
    assert s.leaking_clusters(assigned, "cluster", "split").isEmpty()
