"""Near-duplicate vectors by NN-descent.

Each vector keeps a short list of its nearest known neighbours. The lists start
from neighbours in random hyperplane cells and improve by joining the members
of every list with each other. Every met pair that links two components joins
them for good, whatever the lists keep. A vector lists its nearest neighbours
inside and outside its component separately, so near-duplicates never crowd out
the rest; components are compared block by block in the end. A bounded audit
against all vectors, together with lists and links that no longer change, tells
when to stop; without that the search fails.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import usable_vectors
from .base import Scratch, components
from .groups import by_block, groups_of, in_block_pairs, numbers

LIST = 12  # neighbours kept in the component of a vector, and as many outside
REVERSE = 12  # vectors that list a vector and join in, at most
TREES = 3  # random cell orders to start from, at least
WINDOW = 6  # following vectors of the order that each meets
CELL = 24  # vectors in a cell of such an order, about
ROUNDS = 6  # after these, cells and windows grow from round to round
WIDEST = 6  # doublings of a window, at most
NEAR = 0.2  # list entries up to this far below the threshold have to settle
CHANGED = 0.02  # share of these entries below which the lists have settled
JOINS = 0.001  # share of joined components below which the links have settled
AUDIT = 512  # vectors of the audit, at most
RECALL = 0.995  # share of linked audited vectors all of whose links are found
BLOCK = 512
UNSURE = 1e-4  # similarities of rounded vectors this near to the threshold are computed again


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(vectors: DataFrame, bits: int, seed: int, window: int = WINDOW, least: float = -2.0) -> DataFrame:
    """Similarities ``(a, b, s)`` from ``least`` of vectors that are close in one random order of cells."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            cell = np.zeros(batch.num_rows, dtype=np.int64)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                planes = np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, bits))
                signs = numbers(batch.column("v").take(pa.array(own)), dim) @ planes > 0
                cell[own] = signs @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["node", "dim", "v", "cell"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for batch in batches:
            for part in ([batch] if batch.num_rows else []):
                both = pa.Table.from_batches([tail, part]).combine_chunks().to_batches()[0] if tail is not None else part
                node, cell, size = (both.column(c).to_numpy() for c in ("node", "cell", "dim"))
                fresh = np.arange(len(node)) >= (tail.num_rows if tail is not None else 0)
                for dim in np.unique(size):
                    own = np.flatnonzero(size == dim)
                    x = _unit(numbers(both.column("v").take(pa.array(own)), dim).astype(np.float64))
                    for k in range(1, min(window, len(own) - 1) + 1):
                        a, b = np.arange(len(own) - k), np.arange(k, len(own))
                        use = (cell[own[a]] == cell[own[b]]) & fresh[own[b]]
                        a, b = a[use], b[use]
                        s = np.einsum("ij,ij->i", x[a], x[b])
                        a, b, s = a[s >= least], b[s >= least], s[s >= least]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node[own[a]]), pa.array(node[own[b]]), pa.array(s)], names=["a", "b", "s"]
                        )
                tail = both.slice(max(0, both.num_rows - window))

    order = ["dim", "cell", "mixed"]
    keyed_rows = vectors.mapInArrow(keyed, "node long, dim int, v array<float>, cell long")
    mixed = keyed_rows.withColumn("mixed", F.xxhash64("node", F.lit(seed)))
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(meet, "a long, b long, s double")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))


def _placed(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with the roots ``ra`` and ``rb`` of their components."""
    for side in ("a", "b"):
        of = roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        pairs = pairs.join(of, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return pairs


def _best(pairs: DataFrame, roots: DataFrame, keep: int) -> DataFrame:
    """``(a, b, s, own)``: the ``keep`` nearest of each ``a`` in its component (``own``) and outside."""
    nearest = Window.partitionBy("a", "own").orderBy(F.desc("s"), "b")
    distinct = pairs.groupBy("a", "b").agg(F.max("s").alias("s"))
    sided = _placed(distinct, roots).select("a", "b", "s", (F.col("ra") == F.col("rb")).alias("own"))
    return sided.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= keep).drop("_rank")


def _joined(lists: DataFrame, vectors: DataFrame, roots: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs of vectors that stand in one list, where they improve a list of one of them or may link two components."""
    mixed = Window.partitionBy("b").orderBy(F.xxhash64("a", "b", F.lit(turn)))
    back = lists.withColumn("_rank", F.row_number().over(mixed)).filter(F.col("_rank") <= REVERSE)
    members = lists.select("a", "b").union(back.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    full = [
        F.when(F.count(F.when(side, 1)) >= LIST, F.min(F.when(side, F.col("s")))).otherwise(-2.0).alias(name)
        for side, name in ((F.col("own"), "inner"), (~F.col("own"), "outer"))
    ]
    worst = lists.groupBy(F.col("a").alias("b")).agg(*full)
    of = roots.select(F.col("node").alias("b"), "root")
    known = vectors.withColumnRenamed("node", "b").join(worst, "b", "left").join(of, "b", "left").select(
        "b", "dim", F.coalesce("inner", F.lit(-2.0)).alias("inner"), F.coalesce("outer", F.lit(-2.0)).alias("outer"),
        F.coalesce("root", "b").alias("root"), "v",
    )
    rows = members.join(known, "b")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for group in groups_of(batches, ["a", "dim"]):
            if group.num_rows > 1:
                node, inner, outer, root = (group.column(c).to_numpy() for c in ("b", "inner", "outer", "root"))
                x = _unit(numbers(group.column("v"), group.column("dim")[0].as_py()).astype(np.float64))
                s = x @ x.T
                own = root[:, None] == root[None, :]
                least = np.where(own, np.minimum(inner[:, None], inner[None, :]), np.minimum(outer[:, None], outer[None, :]))
                i, j = np.nonzero(np.triu((s > least) | (~own & (s >= threshold - UNSURE)), 1))
                out.append((node[i], node[j], s[i, j]))
            if len(out) >= 512:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return rows.repartition("a").sortWithinPartitions("a", "dim").mapInArrow(local, "a long, b long, s double")


def _pairs(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["a", "b", "s"])


def _true_links(vectors: DataFrame, threshold: float, share: float) -> DataFrame:
    """``(a, b)``: all links of a bounded sample of vectors, by comparison with every vector."""
    sample = vectors.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)).toArrow()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in np.unique(sample.column("dim").to_numpy()):
        own = np.flatnonzero(sample.column("dim").to_numpy() == dim)
        part = sample.take(pa.array(own)).combine_chunks()
        by_dim[int(dim)] = (part.column("node").to_numpy(), _unit(numbers(part.column("v").combine_chunks(), dim).astype(np.float64)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node = batch.column("dim").to_numpy(), batch.column("node").to_numpy()
            for dim, (own, x) in by_dim.items():
                at = np.flatnonzero(size == dim)
                if len(at):
                    y = _unit(numbers(batch.column("v").take(pa.array(at)), dim).astype(np.float64))
                    i, j = np.nonzero(x @ y.T >= threshold + 1e-6)
                    keep = own[i] != node[at][j]
                    yield pa.RecordBatch.from_arrays([pa.array(own[i][keep]), pa.array(node[at][j][keep])], names=["a", "b"])

    return vectors.mapInArrow(compare, "a long, b long")


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """``(node, links)`` partial counts: linked vectors, copies counted, in each pair of blocks of a component."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["root", "_i", "_j"]):
            node, copies, own = (group.column(c).to_numpy() for c in ("node", "copies", "_own"))
            size = group.column("dim").to_numpy()
            i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = _unit(numbers(group.column("v").take(pa.array(at)), dim))
                left, right = np.flatnonzero(own[at] == i), np.flatnonzero(own[at] == j)
                near = x[left] @ x[right].T >= threshold
                if i == j:
                    np.fill_diagonal(near, False)
                sums = np.zeros(len(at), dtype=np.int64)
                sums[left] += near @ copies[at][right]
                if i != j:
                    sums[right] += near.T @ copies[at][left]
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(sums)], names=["node", "links"])

    blocks = by_block(in_block_pairs(rows, "root", "node", BLOCK), "root")
    return blocks.mapInArrow(count, "node long, links long")


def near_duplicates(
    scratch: Scratch, vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, float]:
    """``(key, n_links, component_id)`` for every row of ``vectors``, and the audited recall.

    A link is a cosine of at least ``threshold`` in double precision between two
    rows. Equal vectors are one node of the graph with a number of copies; all
    their rows link with each other. Unusable vectors, and vectors of
    different lengths, link with nothing: such rows have 0 links and their own
    id as component. Rows that repeat an id are vectors of their own with one id.
    Raises ``RuntimeError`` where the audit stays below ``RECALL``.
    """
    given = vectors.select(F.col(key).alias("_id"), F.col(vector).alias("_given"))
    usable = usable_vectors(given, "_id", "_given").withColumns(
        {"_h": F.xxhash64("_v"), "_g": F.xxhash64(F.lit(1), F.reverse("_v"))}
    )
    named = scratch.keep(usable.select("_id", "_h", "_g"))
    nodes = scratch.keep(
        usable.groupBy("_h", "_g").agg(F.first("_v").alias("w"), F.count("*").alias("copies"), F.min("_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("v", F.transform("w", lambda x: x.cast("float"))).withColumn("dim", F.size("w"))
    )
    light = nodes.select("node", "dim", "v")
    n = nodes.count()
    bits = max(1, round(math.log2(max(2.0, n / CELL))))
    truth = scratch.keep(_true_links(light, threshold, min(1.0, 0.8 * AUDIT / max(1, n))))
    asked = truth.select("a").distinct().count()
    pairs = None
    for seed in range(max(TREES, bits // 3)):
        part = _cells(light, bits, seed)
        pairs = part if pairs is None else pairs.union(part)
    none = scratch.spark.createDataFrame([], "node long, root long")
    met = scratch.keep(pairs)
    roots = _merged(scratch, met, none, nodes, threshold)
    lists = scratch.keep(_best(_both_ways(met), roots, LIST))
    scratch.drop(met)
    joins = _joins(roots)
    for turn in range(ROUNDS + 2 * bits):
        fresh = _joined(lists, light, roots, threshold, turn)
        wider = min(max(0, turn + 1 - ROUNDS), WIDEST)
        for order in range(max(1, bits // 6)):
            seed, least = 1000 * (1 + order) + turn, threshold - NEAR if wider else -2.0
            fresh = fresh.union(_cells(light, max(0, bits - wider), seed, WINDOW << wider, least))
        fresh = scratch.keep(fresh)
        grown = _merged(scratch, fresh, roots, nodes, threshold)
        better = scratch.keep(_best(lists.select("a", "b", "s").union(_both_ways(fresh)), grown, LIST))
        close = better.filter(F.col("s") >= threshold - NEAR)
        changed, entries = close.join(lists, ["a", "b"], "left_anti").count(), close.count()
        before, joins = joins, _joins(grown)
        scratch.drop(fresh, lists, roots)
        lists, roots = better, grown
        recall = _recall(truth, roots, asked)
        if turn and recall >= RECALL and changed <= CHANGED * entries and joins - before <= JOINS * joins:
            break
    else:
        raise RuntimeError(f"near_duplicates has not settled: audited recall {recall:.4f}, {changed} of {entries} near list entries changed")
    grouped = roots.join(nodes.select("node", "dim", F.col("w").alias("v"), "copies", "least"), "node")
    links = _links(grouped, threshold).groupBy("node").agg(F.sum("links").alias("links"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    placed = (
        nodes.select("node", "_h", "_g", "copies", "least")
        .join(links, "node", "left").join(roots, "node", "left").join(smallest, "root", "left")
        .select("_h", "_g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    )
    linked = named.join(placed, ["_h", "_g"]).select("_id", "n_links", "component_id")
    rest = usable_vectors(given, "_id", "_given").select("_id")
    unusable = _without(given.select("_id"), rest)
    result = scratch.keep(
        linked.union(unusable.select("_id", F.lit(0).cast("long"), F.col("_id"))).withColumnRenamed("_id", key)
    )
    scratch.drop(lists, truth, roots, nodes, named)
    return result, recall


def _joins(roots: DataFrame) -> int:
    """How many links join the components of ``roots``."""
    return roots.filter("node <> root").count()


def _recall(truth: DataFrame, roots: DataFrame, asked: int) -> float:
    """The share of audited vectors with links all of whose links lie in their component."""
    if not asked:
        return 1.0
    missed = _placed(truth, roots).filter("ra <> rb").select("a").distinct().count()
    return 1.0 - missed / asked


def _without(every: DataFrame, usable: DataFrame) -> DataFrame:
    """The ids in ``every`` beyond those in ``usable``, with their repetitions."""
    return every.exceptAll(usable)


def _merged(scratch: Scratch, met: DataFrame, roots: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``(node, root)`` after all links among the pairs ``met`` have joined the components of ``roots``."""
    near = met.filter(F.col("s") >= threshold - UNSURE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
    across = scratch.keep(
        _placed(near.groupBy("a", "b").agg(F.max("s").alias("s")), roots).filter("ra <> rb").select("a", "b", "s", "ra", "rb")
    )
    sure = F.col("s") >= threshold + UNSURE
    linked = across.filter(sure).select("ra", "rb").union(_verified(across.filter(~sure), nodes, threshold))
    found = scratch.keep(components(scratch, linked.toDF("a", "b").union(roots.toDF("a", "b"))))
    scratch.drop(across)
    return found


def _verified(near: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``(ra, rb)`` of the pairs that reach the threshold in double precision."""
    full = nodes.select("node", "w")
    sides = near.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for row, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                p, q = (_unit(z.values.to_numpy()[None]) for z in (x, y))
                keep[row] = float((p @ q.T)[0, 0]) >= threshold
            yield batch.select(["ra", "rb"]).filter(pa.array(keep))

    return sides.mapInArrow(exact, "ra long, rb long")
