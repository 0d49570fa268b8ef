"""Groups of sorted Arrow rows, and pairs inside large groups by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal ``keys``; rows must come sorted by them. Keys are whole numbers without NULL."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            same = all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if not same:
                yield _joined(held)
                held = []
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            values = batch.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield _joined(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def numbers(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; every list has ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def in_block_pairs(rows: DataFrame, group: str, item: str, size: int) -> DataFrame:
    """Rows copied so that any two of a group meet once in a (group, ``_i``, ``_j``) of about ``2 * size`` rows.

    A group of n rows is cut into ``n / size`` blocks by a hash of ``item``; each
    row goes to every pair of blocks that contains its own, ``_own``. So no task
    ever holds a whole large group.
    """
    counts = rows.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(item, F.lit(17)), F.col("_blocks")).cast("int")
    spread = (
        rows.join(counts, group)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    )
    return spread.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_other", "_blocks")


def by_block(rows: DataFrame, group: str) -> DataFrame:
    keys = [group, "_i", "_j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)
