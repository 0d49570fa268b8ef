"""Groups of sets that are linked by Jaccard similarity, from buckets of candidate sets.

A pair is a candidate if both stand in one bucket. First every set of a bucket
is compared with one pivot, and the links found give groups. Only pairs whose
ends are then in different groups are compared further, in blocks and behind a
bitmap bound that never rejects a link: first the nearest pair of each two groups,
then every pair whose ends are in different groups even after that. So a large
group of copies costs one comparison per copy and bucket, and yet no candidate link
between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, components
from .groups import by_block, groups_of, in_block_pairs

BITS = 512
BLOCK = 512
HEADS = 32  # of a set's buckets, the smallest; a pair is left to the smallest of them that both have


def reaches(inter, left, right, percent: int):
    """``100 * intersection >= percent * union``, in whole numbers."""
    return 100 * inter >= percent * (left + right - inter)


def with_bitmaps(sets: DataFrame) -> DataFrame:
    """``(node, n, bits)`` of ``(node, n, tokens)``: the parity of the tokens that share a bit.

    Two sets differ in at least as many tokens as their bitmaps differ in bits.
    """

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column("tokens")
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                bit = lists.flatten().to_numpy() & (BITS - 1)
                parity = (np.bincount(row * BITS + bit, minlength=len(lists) * BITS) & 1).astype(np.uint8)
                packed = np.packbits(parity.reshape(-1, BITS), axis=1)
                out = pa.array([r.tobytes() for r in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), out], names=["node", "n", "bits"])

    return sets.select("node", "n", "tokens").mapInArrow(bitmaps, "node long, n int, bits binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose token sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            xs, ys = x.flatten().to_numpy(), y.flatten().to_numpy()
            xo, yo = x.offsets.to_numpy() - x.offsets[0].as_py(), y.offsets.to_numpy() - y.offsets[0].as_py()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for row in range(batch.num_rows):
                p, q = xs[xo[row] : xo[row + 1]], ys[yo[row] : yo[row + 1]]
                if len(p) > len(q):
                    p, q = q, p
                if len(p):
                    at = np.searchsorted(q, p)
                    inter = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                    keep[row] = reaches(inter, len(p), len(q), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(exact, "a long, b long")


def linked_groups(scratch: Scratch, buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, root)`` for every node of ``sets (node, n, tokens)`` that has a link within a bucket.

    ``buckets (sig, node)``; ``tokens`` are sorted and distinct. ``root`` is the
    smallest node of the group.
    """
    sizes = sets.select("node", "n")
    pivots = buckets.groupBy("sig").agg(F.min("node").alias("pivot"), F.count("*").alias("rows")).filter("rows > 1")
    starred = scratch.keep(buckets.join(pivots.select("sig", "pivot"), "sig"))
    first = starred.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    fitting = (
        first.join(sizes.toDF("b", "nb"), "b").join(sizes.toDF("a", "na"), "a")
        .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
    )
    stars = scratch.keep(verified(fitting, sets, percent))
    roots = scratch.keep(components(scratch, stars))
    label = F.coalesce("root", "node")
    labelled = scratch.keep(starred.join(roots, "node", "left").select("sig", "node", "pivot", label.alias("root")))
    scratch.drop(starred)
    # the nearest pair of each two groups first: what it merges needs no further pairs
    near = _crossing(labelled, sets, percent, nearest=True)
    chosen = near.groupBy("ra", "rb").agg(F.min(F.struct("apart", "a", "b")).alias("pair")).select("pair.a", "pair.b")
    merging = scratch.keep(verified(chosen, sets, percent))
    merged = scratch.keep(components(scratch, stars.union(merging)))
    again = labelled.drop("root").join(merged, "node", "left").select("sig", "node", "pivot", label.alias("root"))
    relabelled = scratch.keep(again)
    scratch.drop(labelled, roots)
    pairs = _crossing(relabelled, sets, percent, nearest=False).select("a", "b").distinct()
    more = scratch.keep(verified(pairs, sets, percent))
    scratch.drop(relabelled)
    result = scratch.keep(components(scratch, _tree(merged).union(more)))
    scratch.drop(stars, merging, merged, more)
    return result


def _tree(groups: DataFrame) -> DataFrame:
    """Edges from each node of ``(node, root)`` to its root: the same groups with the fewest edges."""
    return groups.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _crossing(labelled: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs ``(a, b, ra, rb, apart)`` of one bucket with different roots that may be links by size and bitmap.

    ``ra`` and ``rb`` are the roots, ``apart`` is the share of bits that differ. A pair
    comes from the smallest bucket that is among the ``HEADS`` smallest of both its
    ends. With ``nearest``, each block gives only one pair for two roots.
    """
    mixed = labelled.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("sig")
    rows = labelled.join(mixed, "sig")
    smallest = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, HEADS).alias("heads"))
    known = with_bitmaps(sets).join(smallest, "node")
    blocks = by_block(in_block_pairs(rows.join(known, "node"), "sig", "node", BLOCK), "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for group in groups_of(batches, ["sig", "_i", "_j"]):
            found = _block_pairs(group, percent)
            if len(found[0]):
                held.append(_unique(found, nearest))
            if len(held) >= 64:
                yield _batch(_unique(_stacked(held), nearest))
                held = []
        if held:
            yield _batch(_unique(_stacked(held), nearest))

    return blocks.mapInArrow(run, "a long, b long, ra long, rb long, apart double")


def _block_pairs(group: pa.RecordBatch, percent: int) -> tuple[np.ndarray, ...]:
    node, pivot, root, n, own = (group.column(c).to_numpy() for c in ("node", "pivot", "root", "n", "_own"))
    i, j, sig = (group.column(c)[0].as_py() for c in ("_i", "_j", "sig"))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
    lists = group.column("heads")
    heads = np.full((len(node), HEADS), sig)
    heads[np.arange(HEADS) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
    parts = []
    for a in left[pivot[left] != node[left]]:
        b = right[(root[right] != root[a]) & (pivot[right] != node[right])]
        if i == j:
            b = b[node[b] > node[a]]
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        b = b[100 * small.astype(np.int64) >= percent * large.astype(np.int64)]
        if not len(b):
            continue
        differ = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1).astype(np.int64)
        total = n[a].astype(np.int64) + n[b]
        open_ = (100 + percent) * differ <= (100 - percent) * total
        b, apart = b[open_], (differ / total)[open_]
        if len(b):
            earlier = heads[a][heads[a] < sig]
            alone = ~np.isin(heads[b], earlier).any(axis=1)
            b, apart = b[alone], apart[alone]
        if len(b):
            swap = node[b] < node[a]
            parts.append((
                np.where(swap, node[b], node[a]), np.where(swap, node[a], node[b]),
                np.minimum(root[a], root[b]), np.maximum(root[a], root[b]), apart,
            ))
    return _stacked(parts) if parts else (*[np.zeros(0, np.int64)] * 4, np.zeros(0))


def _stacked(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(column) for column in zip(*parts))


def _unique(found: tuple[np.ndarray, ...], nearest: bool) -> tuple[np.ndarray, ...]:
    """Each pair once or, with ``nearest``, the nearest pair of each two roots."""
    a, b, ra, rb, apart = found
    keys = (ra, rb) if nearest else (a, b)
    order = np.lexsort((b, a, apart, rb, ra) if nearest else (b, a))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
    return tuple(column[order[first]] for column in found)


def _batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "ra", "rb", "apart"])


def text_key(column: str) -> Column:
    """128 bits of a text; equal texts have equal keys. NULL stays NULL."""
    return F.unhex(F.md5(F.col(column).cast("binary")))
