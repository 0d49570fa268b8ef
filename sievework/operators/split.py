"""Leakage-free splits: whole clusters go greedily to the split furthest below its target.

The rule takes clusters by falling size, ties by a seeded hash, and gives each
to the split with the least ``(count / target, -ratio, name)``. Only sizes move
the counts, so clusters of one size form a class, and the state before a class
follows from the sizes before it. The number of different sizes is at most
about ``sqrt(2 * members)``, which makes that walk small at any data size.
Within a class the splits' keys are rising sequences and the rule merges them,
so the split of the cluster at any rank is found on its own, in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import bucketed_rank, tie_key
from .skew import attach_by_key


def parse_ratios(text: str) -> dict[str, float]:
    """``name=ratio,…`` with at least two different names; ratios are scaled to sum 1."""
    ratios: dict[str, float] = {}
    for item in text.split(","):
        name, _, raw = item.partition("=")
        name = name.strip()
        try:
            ratio = float(raw)
        except ValueError:
            ratio = math.nan
        if not name or name in ratios or not math.isfinite(ratio) or ratio <= 0:
            raise ValueError("Ratios must look like discovery=0.7,validation=0.3")
        ratios[name] = ratio
    if len(ratios) < 2:
        raise ValueError("At least two positive split ratios are required")
    total = sum(ratios.values())
    return {name: ratio / total for name, ratio in ratios.items()}


def preferred_order(ratios: dict[str, float]) -> list[str]:
    """Split names so that the first of equal keys wins: larger ratio, then name."""
    return sorted(ratios, key=lambda name: (-ratios[name], name))


def merge_picks(
    start: np.ndarray, targets: np.ndarray, size: np.ndarray, rank: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Counts of picks per split among the first ``rank`` picks of a class, and the next pick.

    All arguments have one row per question. ``start`` holds the member counts
    before the class, with splits in preferred order; ``size`` is the class's
    cluster size. A linear estimate that never exceeds the true counts is
    brought up to ``rank`` by a few exact steps.
    """
    rows, splits = start.shape
    start = start.astype(np.float64)
    weights = targets / size[:, None]
    floors = start / targets
    active = np.ones((rows, splits), dtype=bool)
    level = np.zeros(rows)
    for _ in range(splits):
        supply = np.where(active, weights, 0.0).sum(axis=1)
        debt = np.where(active, start / size[:, None], 0.0).sum(axis=1)
        level = (rank + debt) / supply
        below = active & (floors <= level[:, None])
        below[np.arange(rows), np.argmin(floors, axis=1)] = True
        if (below == active).all():
            break
        active = below
    guess = np.floor((level[:, None] * targets - start) / size[:, None]) - (splits + 2)
    picks = np.maximum(np.where(active, guess, 0.0), 0.0).astype(np.int64)
    every = np.arange(rows)
    while True:
        keys = (start + picks * size[:, None]) / targets
        choice = np.argmin(keys, axis=1)
        left = picks.sum(axis=1) < rank
        if not left.any():
            return picks, choice
        picks[every[left], choice[left]] += 1


def _class_states(names: list[str], ratios: dict[str, float]):
    """Walk the size classes once, from large to small, and emit the state before each."""
    shares = np.array([ratios[name] for name in names])

    def walk(classes: pd.DataFrame) -> pd.DataFrame:
        classes = classes.sort_values("size", ascending=False)
        sizes = classes["size"].to_numpy(dtype=np.int64)
        counts = classes["clusters"].to_numpy(dtype=np.int64)
        targets = shares * float((sizes * counts).sum())
        state = np.zeros(len(names), dtype=np.int64)
        before = []
        for size, count in zip(sizes, counts):
            before.append(state.tolist())
            picks, _ = merge_picks(
                state[None, :], targets[None, :], np.array([size]), np.array([count])
            )
            state = state + picks[0] * size
        return pd.DataFrame(
            {"size": sizes, "start": before, "targets": [targets.tolist()] * len(sizes)}
        )

    return walk


def _choose(names: list[str]):
    @F.pandas_udf("string")
    def choose(start: pd.Series, targets: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        if not len(size):
            return pd.Series([], dtype="object")
        _, picked = merge_picks(
            np.stack(start.to_numpy()), np.stack(targets.to_numpy()), size.to_numpy(), rank.to_numpy()
        )
        return pd.Series(np.array(names, dtype=object)[picked])

    return choose


def cluster_sizes(members: DataFrame, cluster: str) -> DataFrame:
    return members.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def allocate_clusters(sizes: DataFrame, ratios: dict[str, float], seed: int) -> DataFrame:
    """Add ``split`` to a table of (cluster, size), one row per cluster.

    ``sizes`` is read three times (classes, bucket counts, ranks), so pass a
    stored table.
    """
    names = preferred_order(ratios)
    classes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))
    states = classes.groupBy().applyInPandas(
        _class_states(names, ratios), "size bigint, start array<bigint>, targets array<double>"
    )
    keyed = sizes.withColumn("_tie", tie_key(seed, F.col("cluster")))
    # The state of a class travels with the bucket offsets, so the class of
    # singletons is never joined as one group.
    ranked = bucketed_rank(keyed, ["size"], "_tie", "_rank", group_table=states)
    return ranked.select(
        "cluster",
        "size",
        _choose(names)("start", "targets", "size", "_rank").alias("split"),
    )


def assign_members(
    members: DataFrame, assignment: DataFrame, cluster: str, spread: Column
) -> DataFrame:
    """Give every member the split (and any other column) of its cluster.

    Large clusters spread over tasks.
    """
    table = assignment.withColumnRenamed("cluster", cluster)
    return attach_by_key(members, table, [cluster], "size", spread, how="inner").drop("size")


def leaking_clusters(manifest: DataFrame, cluster: str, split: str) -> DataFrame:
    """Clusters found in more than one split; nothing is collected per cluster."""
    return (
        manifest.groupBy(F.col(cluster).alias("cluster"))
        .agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
        .filter("first_split <> last_split")
    )


def split_agreement(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Share of members that two assignments of the same keys put into the same split."""
    pair = left.select(key, weight, F.col("split").alias("_a")).join(
        right.select(key, F.col("split").alias("_b")), key
    )
    return pair.agg(
        F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.col(weight))), F.lit(0)).alias("matching"),
        F.sum(weight).alias("total"),
    ).withColumn("agreement", F.round(F.try_divide(F.col("matching").cast("double"), F.col("total").cast("double")), 6))


def cluster_statistics(sizes: DataFrame) -> DataFrame:
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.max("size").alias("max_cluster_size"),
        F.count_if(F.col("size") == 1).alias("n_singletons"),
    )


def split_counts(manifest: DataFrame, cluster: str, primary: Column) -> DataFrame:
    """Sequences, clusters and primary sequences per split; empty splits are absent."""
    per_cluster = manifest.groupBy("split", cluster).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(primary).alias("p")
    )
    return per_cluster.groupBy("split").agg(
        F.sum("n").alias("n_sequences"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum("p").alias("n_primary"),
    )
