import random

from pyspark.sql import functions as F

from sievework.operators import duplicates as d
from sievework.operators.ranking import seeded_rank
from sievework.operators.skew import attach_by_key


def sample(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 40 + [f"k{j}" for j in range(60)]), rng.choice(["", None, "A", "B", str(i)]))
            for i in range(400)]
    return rows, spark.createDataFrame(rows, "n bigint, sha string, name string")


def test_first_copy_wins(spark):
    rows, df = sample(spark)
    first, expected = {}, {}
    for n, sha, _ in rows:
        expected[n] = first.get(sha)
        first.setdefault(sha, n)
    got = d.mark_exact_duplicates(df, "sha", "n", F.col("n")).collect()
    assert {r["n"]: r["exact_duplicate_of"] for r in got} == expected


def test_shared_ids_flag_all_rows_but_no_blanks(spark):
    rows, df = sample(spark)
    names = [r[2] for r in rows]
    got = d.mark_shared_ids(df, ["name"], F.col("n")).collect()
    assert {r["n"]: r["is_duplicate_id"] for r in got} == {
        n: bool(name) and names.count(name) > 1 for n, _, name in rows
    }


def test_hot_keys_are_salted_without_loss(spark):
    rows, df = sample(spark)
    table = df.groupBy("sha").agg(F.count(F.lit(1)).alias("w"), F.min("n").alias("least"))
    plain = attach_by_key(df, table, ["sha"], "w", F.col("n"))
    salted = attach_by_key(df, table, ["sha"], "w", F.col("n"), unmatched=F.col("name").isNull())
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
    key = lambda r: (r["n"], r["sha"], r["w"], r["least"])
    matched = sorted(key(r) for r in salted.filter("name is not null").collect())
    assert matched == sorted(key(r) for r in plain.filter("name is not null").collect())
    assert salted.count() == len(rows)


def test_hot_rows_spread_over_tasks(spark):
    df = spark.range(4000).select(F.col("id").alias("n"), F.lit("hot").alias("k"))
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_by_key(df, table, ["k"], "w", F.col("n"))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_preferred_copy(spark):
    rows = [("a", "s", True, 1), ("b", "s", False, 9), ("c", "s", False, 5), ("d", "t", True, 2)]
    df = spark.createDataFrame(rows, "id string, sha string, background boolean, rank int")
    kept, rejected = d.split_preferred_copies(df, "sha", ["background", "rank"], "id")
    assert {r["id"] for r in kept.collect()} == {"c", "d"}
    assert {(r["id"], r["related_accession"]) for r in rejected.collect()} == {("a", "c"), ("b", "c")}


def test_ranks(spark):
    df = spark.range(300).select(F.col("id").alias("n"))
    ranks = [r["rank"] for r in seeded_rank(df, ["n"], 5).orderBy("n").collect()]
    assert sorted(ranks) == list(range(300)) and ranks != sorted(ranks)
    again = {r["n"]: r["rank"] for r in seeded_rank(df.repartition(7), ["n"], 5).collect()}
    assert again == {r["n"]: r["rank"] for r in seeded_rank(df, ["n"], 5).collect()}
