"""Quota selection that favours rare organisms, types, lengths and sources.

Within a group the rule repeatedly takes the row with the least
``(organism count, type count, length-bin count, source count, rank)``; it
rejects the row if it nearly repeats a selected row, otherwise it selects it
and raises the four counts. Counts only rise, and only on a selection. So:

* the first rows of the best strata under the present counts are enough to go
  on with, as long as the best of them stays below any row left outside;
* a row left over was looked at if and only if its key lay below the key of
  some selected row at the moment that row was taken. That test needs only
  the selected rows, whose number the quotas bound.

Spark ranks, filters and classifies the pool; the driver sees bounded batches.
"""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.text import length_bin
from ..session import materialise

# Rows fetched at once, and rows fetched per stratum. Both only set the pace.
BATCH = 4000
HEADS = 4

# A selection of this many bytes is copied to every task; a larger one is copied to so many salts.
COPIED = 64 << 20
SALTS = 64

# Reasons given to rows that were not selected.
NEAR = "near_duplicate_of_selected_approximate"
UNUSED = "not_selected_quota_diversity"
DUPLICATE = "exact_duplicate"


@dataclass(frozen=True)
class PoolColumns:
    identity: str = "original_accession"
    group: str = "sample_group"
    sequence: str = "sequence"
    organism: str = "organism"
    types: str = "source_types"
    source: str = "source_file"
    rank: str = "rank"


STRATA = ["organism", "types", "bin", "source"]


def _seen(counts: Counter, column: str) -> Column:
    """The present count of a row's stratum; the table is bounded by the quotas."""
    if not counts:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for item in counts.items() for x in item])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(0))


class _Counts:
    """How often each stratum value was selected."""

    def __init__(self):
        self.tables = {name: Counter() for name in STRATA}

    def key(self, row) -> tuple:
        return (*[self.tables[n][row[n]] for n in STRATA], row["rank"])

    def add(self, row) -> None:
        for name in STRATA:
            self.tables[name][row[name]] += 1


class _Queue:
    """Strata by the key of their first row. Counts only rise, so a key that went stale only moves back."""

    def __init__(self, counts: _Counts, rows: list[dict]):
        self.counts = counts
        self.rows: dict[tuple, deque] = {}
        for row in rows:
            self.rows.setdefault(tuple(row[n] for n in STRATA), deque()).append(row)
        self.heap = [(counts.key(held[0]), stratum) for stratum, held in self.rows.items()]
        heapq.heapify(self.heap)

    def first(self) -> tuple | None:
        """The least key of all rows."""
        while self.heap:
            key, stratum = self.heap[0]
            now = self.counts.key(self.rows[stratum][0])
            if now == key:
                return key
            heapq.heapreplace(self.heap, (now, stratum))
        return None

    def pop(self) -> dict:
        _, stratum = heapq.heappop(self.heap)
        held = self.rows[stratum]
        row = held.popleft()
        if held:
            heapq.heappush(self.heap, (self.counts.key(held[0]), stratum))
        return row


class _Batch:
    """The head rows of the best strata, and the least key a row outside can have."""

    def __init__(self, pool: DataFrame, rest: DataFrame, counts: _Counts, quota: int, size: int):
        within = Window.partitionBy(*STRATA).orderBy("rank")
        heads = rest.withColumn("_head", F.row_number().over(within)).filter(F.col("_head") <= HEADS)
        seen = {f"_seen_{n}": _seen(counts.tables[n], n) for n in STRATA}
        ordered = heads.withColumns(seen).orderBy(*seen, "rank").limit(size)
        rows = [r.asDict() for r in ordered.drop("_head", *seen).collect()]
        self.empty = not rows
        self.counts, self.queue = counts, _Queue(counts, rows)
        # A stratum with all its heads here may go on beyond them, after the last one.
        sizes = Counter(tuple(row[n] for n in STRATA) for row in rows)
        last = {tuple(row[n] for n in STRATA): row for row in rows}
        self.beyond = _Queue(counts, [row for stratum, row in last.items() if sizes[stratum] == HEADS])
        self.horizon = None
        if len(rows) == size:
            self.horizon = counts.key(rows[-1])
            self.before = {name: dict(table) for name, table in counts.tables.items()}
            # With more values than the quota, one value always stays untouched.
            self.values = {
                n: [r[0] for r in pool.select(n).distinct().limit(quota + 1).collect()] for n in STRATA
            }
            self.quota = quota
        self.rise: list[int] = [0] * len(STRATA)

    def selected(self) -> None:
        """Counts have changed: so may the least key of rows beyond the horizon."""
        if self.horizon is not None:
            self.rise = [
                0 if len(values) > self.quota
                else min(self.counts.tables[n][v] - self.before[n].get(v, 0) for v in values)
                for n, values in self.values.items()
            ]

    def pop(self) -> dict | None:
        """The best row of the pool, or None if it may lie outside the batch."""
        best = self.queue.first()
        if best is None:
            return None
        bounds = [b for b in [self.beyond.first()] if b is not None]
        if self.horizon is not None:
            bounds.append((*[h + r for h, r in zip(self.horizon, self.rise)], self.horizon[-1]))
        return None if any(best > b for b in bounds) else self.queue.pop()


def _near_rows(chosen: list[str]):
    """A filter for rows that nearly repeat one of the chosen sequences."""

    @F.arrow_udf("boolean")
    def near(sequences: pa.Array) -> pa.Array:
        return pa.array(sim.Chosen(chosen).first_near(sequences.to_pylist()) >= 0)

    return near


def _fill_group(pool: DataFrame, quota: int, selected: list[dict], size: int) -> list[dict]:
    """Select up to ``quota`` rows of one group.

    After each batch, what is left is stored without the rows that nearly repeat
    a new choice. So a large group of near copies cannot fill batch after batch, and
    every row is compared with each choice once.
    """
    counts = _Counts()
    taken: list[dict] = []
    rest, tested = pool, 0
    while len(taken) < quota:
        batch = _Batch(pool, rest, counts, quota, size)
        if batch.empty:
            break
        # the stored rest was already compared with the first `tested` choices
        others = [sim.Chosen([other["sequence"] for other in (selected + taken)[tested:]])]
        popped = []
        while len(taken) < quota and (row := batch.pop()) is not None:
            popped.append(row["rank"])
            if any(other.first_near([row["sequence"]])[0] >= 0 for other in others):
                continue
            taken.append(row)
            others.append(sim.Chosen([row["sequence"]]))
            counts.add(row)
            batch.selected()
        if len(taken) < quota:
            fresh = [row["sequence"] for row in (selected + taken)[tested:]]
            rest = rest.filter(~F.col("rank").isin(popped or [-1]))
            if fresh:
                rest = rest.filter(~_near_rows(fresh)("sequence"))
            rest, tested = materialise(rest), len(selected) + len(taken)
    return taken


class _Steps:
    """The choices of one group in order, and the counts before each of them."""

    def __init__(self, picks: list[dict]):
        self.ranks = np.array([p["rank"] for p in picks], dtype=np.int64)
        self.values = {n: [p[n] for p in picks] for n in STRATA}
        self.own = np.zeros((len(STRATA), len(picks)), dtype=np.int64)
        for row, name in enumerate(STRATA):
            seen: Counter = Counter()
            for place, value in enumerate(self.values[name]):
                self.own[row, place] = seen[value]
                seen[value] += 1

    def before(self, name: str, value: str) -> np.ndarray:
        hits = np.array([v == value for v in self.values[name]], dtype=np.int64)
        return np.cumsum(hits) - hits

    def looked_at(self, stratum: tuple, ranks: np.ndarray) -> np.ndarray:
        """The first choice whose key lay above that of a row with this stratum and rank; else their number."""
        if not len(self.ranks):
            return np.zeros(len(ranks), dtype=np.int64)
        mine = np.stack([self.before(n, v) for n, v in zip(STRATA, stratum)])
        apart = mine != self.own
        lead = np.argmax(apart, axis=0)
        differs = apart.any(axis=0)
        below = differs & (mine[lead, np.arange(mine.shape[1])] < self.own[lead, np.arange(mine.shape[1])])
        always = int(np.argmax(below)) if below.any() else len(self.ranks)
        ties = np.flatnonzero(~differs)
        ties = ties[ties < always]
        if not len(ties):
            return np.full(len(ranks), always)
        # among equal counts the rank decides; running maxima of the choices' ranks find the first one above
        at = np.searchsorted(np.maximum.accumulate(self.ranks[ties]), ranks, "right")
        return np.where(at < len(ties), ties[np.minimum(at, len(ties) - 1)], always)


def _classify(selected: list[dict], exhausted: set[str], groups: list[str]):
    """Reason and related row for each row that was not selected."""
    first, steps, seen = {}, {}, 0
    for group in groups:
        picks = [s for s in selected if s["grp"] == group]
        first[group], steps[group] = seen, _Steps(picks)
        seen += len(picks)
    texts, names = [s["sequence"] for s in selected], np.array([s["identity"] for s in selected] + [None], dtype=object)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = sim.Chosen(texts)
        for batch in batches:
            ranks = batch.column("rank").to_numpy()
            strata: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", *STRATA)))):
                strata.setdefault(key, []).append(row)
            ends = np.zeros(batch.num_rows, dtype=np.int64)
            looked = np.zeros(batch.num_rows, dtype=bool)
            for (group, *stratum), rows in strata.items():
                if group not in steps:
                    continue
                at = steps[group].looked_at(tuple(stratum), ranks[rows])
                ends[rows] = first[group] + at
                looked[rows] = (at < len(steps[group].ranks)) | (group in exhausted)
            near = chosen.first_near(batch.column("sequence").to_pylist(), ends=np.where(looked, ends, 0))
            reasons = pa.array(np.where(looked, NEAR, UNUSED), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("identity"), batch.column("grp"), reasons, pa.array(names[near], pa.string())],
                names=["identity", "grp", "reason", "related_accession"],
            )

    return classify


def diversity_select(
    pool: DataFrame, quotas: dict[str, int], columns: PoolColumns = PoolColumns(), batch: int = BATCH
) -> tuple[DataFrame, DataFrame]:
    """Return (selected, rejected); ``pool`` has unique ranks and no exact duplicates.

    Groups are filled in the order of ``quotas``; a near-duplicate test looks at
    every row selected so far, whatever its group. Rows of other groups, or of
    none, are rejected like those that the quotas had no room for.
    """
    spark = pool.sparkSession
    c = columns  # The pool is read several times, so it is stored once, evenly spread.

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    narrow = materialise(
        pool.select(
            F.col(c.identity).cast("string").alias("identity"),
            F.col(c.group).alias("grp"),
            F.col(c.sequence).alias("sequence"),
            text(c.organism).alias("organism"),
            text(c.types).alias("types"),
            length_bin(F.length(c.sequence)).cast("string").alias("bin"),
            text(c.source).alias("source"),
            F.col(c.rank).cast("bigint").alias("rank"),
        )
    )
    selected: list[dict] = []
    exhausted: set[str] = set()
    for group, quota in quotas.items():
        taken = _fill_group(narrow.filter(F.col("grp") == group), quota, selected, batch)
        if len(taken) < quota:
            exhausted.add(group)
        selected += taken
    chosen = spark.createDataFrame(
        [(i, s["identity"], s["grp"]) for i, s in enumerate(selected, 1)],
        "selection_order int, identity string, grp string",
    )
    left = narrow.join(F.broadcast(chosen.select("identity")), "identity", "left_anti")
    rejected = left.mapInArrow(
        _classify(selected, exhausted, list(quotas)),
        "identity string, grp string, reason string, related_accession string",
    )
    return chosen, rejected


def bounded_pairs(
    candidates: DataFrame, selected: DataFrame, identity: str, text: str, order: str, texts: bool = False
) -> DataFrame:
    """Candidates and selected rows that pass the length and character bounds.

    Both sides meet as lengths and count vectors over the characters that the
    selection holds. A selection of up to ``COPIED`` bytes goes to every task. A larger
    one meets the candidates by length bucket and by a salt of the candidate's id: so one
    length may hold any share of the rows, and what travels is numbers. With ``texts``
    the pairs carry both texts, ``_a`` and ``_b``.
    """
    held = selected.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    alphabet = sim.alphabet(selected, text)
    counts = sim.count_vectors(alphabet)
    bucket = sim.length_bucket(F.length(text))
    copied = 3 * (held[0] * (64 + 4 * len(alphabet)) + held[1]) <= COPIED
    carried = texts and copied
    left = candidates.select(
        F.col(identity), F.length(text).alias("_la"), counts(text).alias("_ca"), bucket.alias("_bucket"),
        *([F.col(text).alias("_a")] if carried else []),
    )
    right = selected.select(
        F.col(identity).alias("related_accession"), F.length(text).alias("_lb"), F.col(order).alias("_order"),
        counts(text).alias("_cb"), *([F.col(text).alias("_b")] if carried else []),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"),
    )
    keys = ["_bucket"]
    if copied:
        right = F.broadcast(right)
    else:
        keys = ["_bucket", "_salt"]
        left = left.withColumn("_salt", F.pmod(F.xxhash64(identity), F.lit(SALTS)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = left.join(right, keys).filter(
        (F.col(identity) != F.col("related_accession"))
        & (sim.length_ratio(F.col("_la"), F.col("_lb")) >= sim.MIN_LENGTH_RATIO)
    )
    shorter = F.least("_la", "_lb").cast("double")
    share = F.try_divide(sim.shared_characters(F.col("_ca"), F.col("_cb")).cast("double"), shorter)
    close = pairs.withColumn("overlap", share).filter(F.col("overlap") >= sim.MIN_OVERLAP).drop(*keys, "_ca", "_cb")
    if texts and not carried:
        close = close.join(candidates.select(identity, F.col(text).alias("_a")), identity)
        close = close.join(selected.select(F.col(identity).alias("related_accession"), F.col(text).alias("_b")), "related_accession")
    return close


def first_near_selected(
    candidates: DataFrame, selected: DataFrame, identity: str, text: str, order: str
) -> DataFrame:
    """For each candidate the first selected row, by ``order``, that it nearly repeats."""
    pairs = bounded_pairs(candidates, selected, identity, text, order, texts=True)
    near = pairs.filter(sim.blocks_suffice()("_a", "_b"))
    return near.groupBy(identity).agg(F.min_by("related_accession", "_order").alias("related_accession"))
