"""Shared helpers: scratch tables, global row numbers and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import attach_by_key
from ..session import shared_folder


#: Spark's own setting: drop the shuffle files of a query at its end, not at some later collection of garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared folder; each can be dropped as soon as nothing needs it.

    Written tables cut the lineage: a lost executor costs no earlier work.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")  # the written table replaces the shuffles behind it
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if found := self._paths.pop(id(df), None):
                self._delete(found[1])

    def clear(self) -> None:
        self._paths.clear()
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(scratch: Scratch, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers from 0 in the order of ``order``, without one task for all rows.

    Rows are range-sorted and written. Only the row counts of the partitions, one
    number each, meet on the driver. Rows that agree in ``order`` follow in the
    order they were read, so even one value for all rows spreads over tasks.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    parts = scratch.keep(
        tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
        .drop("_tie")
    )
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in parts.groupBy(part.alias("p")).count().collect())
    total, starts = 0, []
    for p, n in counts:
        starts.append((p, total))
        total += n
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_start", T.LongType())])
    offsets = scratch.spark.createDataFrame(starts, schema)
    placed = parts.withColumn("_part", part).join(F.broadcast(offsets), "_part", "left")
    at = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return placed.withColumn(name, F.col("_start") + at).drop("_at", "_part", "_start")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each node of ``edges (a, b)`` can reach.

    Large-star and small-star steps take turns until the edges are stars; the
    number of rounds grows with the logarithm of the longest chain. Minima
    combine before the shuffle, and joins on a frequent node can be split by AQE.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a").filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        )
        middle = scratch.keep(large.distinct())
        least = middle.groupBy("a").agg(F.min("b").alias("m"))
        small = middle.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        later = scratch.keep(small.distinct())
        scratch.drop(now, middle)
        now = later
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def attached_to_group(rows: DataFrame, groups: DataFrame, root: str, spread: str) -> DataFrame:
    """``rows`` joined to ``groups``, one row per ``root`` whose ``_weight`` counts its rows; heavy groups are spread by ``spread``."""
    return attach_by_key(rows, groups, [root], "_weight", F.col(spread)).drop("_weight")


def code_point_order(name: str) -> Column:
    """Sort key: NULL last, else the order of UTF-8 bytes, which is that of code points."""
    return F.struct(F.col(name).isNull().alias("_null"), F.col(name).alias("_value"))


def attached(joined: DataFrame, decisions: DataFrame, identity: list[str]) -> DataFrame:
    """Rows with a decision for their identity, once each where ``decisions._rows`` counts several."""
    if decisions.filter("_rows > 1").isEmpty():
        return joined
    once = joined.filter("_rows > 1").dropDuplicates(identity)
    return joined.filter("_rows is null or _rows = 1").union(once)
