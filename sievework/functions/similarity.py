"""Near repeats of short strings: integer bounds first, block matching only for what they leave.

A candidate nearly repeats a chosen string if their lengths, their characters and their
matching blocks agree well enough. The first two are sums of integers. Before blocks are
matched, runs of ``q`` characters are counted that occur in both strings at a fitting
distance. With ``m`` matched characters of lengths ``la`` and ``lb``, at most
``la + lb - 2m + 1`` blocks exist, each of which loses ``q - 1`` runs at its end, and
no matched character moves by more than ``la - m`` to the left or ``lb - m`` to
the right. So a pair with fewer such runs cannot pass.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length ratio, character overlap and matched share, all inclusive.
MIN_LENGTH_RATIO = 0.8
MIN_OVERLAP = 0.9
MIN_MATCHED = 0.9

RUNS = (2, 4)


def length_ratio(a: Column, b: Column) -> Column:
    """The ratio of two lengths, the shorter one above."""
    return F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double"))


def shared_characters(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two count vectors over one alphabet."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda total, n: total + n)


def length_bucket(length: Column) -> Column:
    """Strings whose length ratio passes lie in the same or in adjacent buckets.

    Buckets are a little wider than the ratio, so rounding cannot split a pair further.
    """
    step = F.log(F.lit(1.001 / MIN_LENGTH_RATIO))
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / step).cast("int")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def count_matrix(texts: list[str | None], alphabet: np.ndarray) -> np.ndarray:
    """How often each character of the sorted ``alphabet`` occurs in each text, in one pass over all of them."""
    lengths = [len(t or "") for t in texts]
    points = code_points("".join(t or "" for t in texts))
    row = np.repeat(np.arange(len(texts)), lengths)
    at = np.minimum(np.searchsorted(alphabet, points), max(len(alphabet) - 1, 0))
    known = alphabet[at] == points if len(alphabet) else np.zeros(len(points), dtype=bool)
    flat = np.bincount(row[known] * len(alphabet) + at[known], minlength=len(texts) * len(alphabet))
    return flat.reshape(len(texts), len(alphabet)).astype(np.int32)


def alphabet(df: DataFrame, text: str) -> np.ndarray:
    """The code points of a text column, ascending; there are never more than Unicode has."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(at, 512).to_pylist()
                seen = np.union1d(seen, code_points("".join(t or "" for t in texts)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64))], names=["point"])

    found = df.select(text).mapInArrow(distinct, "point long").distinct().collect()
    return np.array(sorted(r[0] for r in found), dtype=np.uint32)


def count_vectors(points: np.ndarray):
    """A function of a text column: how often it has each of ``points``; other characters are left out."""

    @F.arrow_udf("array<int>")
    def counts(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), 512):
            matrix = count_matrix(texts.slice(at, 512).to_pylist(), points)
            offsets = np.arange(matrix.shape[0] + 1, dtype=np.int32) * matrix.shape[1]
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return counts


def needed(shorter: int) -> int:
    """The least number of matched characters that passes."""
    least = math.floor(MIN_MATCHED * shorter)
    while least / shorter < MIN_MATCHED:
        least += 1
    return least


def _runs(points: np.ndarray, q: int) -> np.ndarray:
    code = np.zeros(max(len(points) - q + 1, 0), dtype=np.uint64)
    for k in range(q):
        code = code * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(code)] + np.uint64(1)
    return code


def common_runs(a: np.ndarray, b: np.ndarray, q: int, left: int, right: int) -> int:
    """Runs of ``a`` that ``b`` has at most ``left`` places before and ``right`` after their own place."""
    x, y = _runs(a, q), _runs(b, q)
    _, code = np.unique(np.concatenate([y, x]), return_inverse=True)
    width = len(a) + len(b) + right + 1
    held = np.sort(code[: len(y)] * width + np.arange(len(y)))
    place = np.arange(len(x))
    from_, to = (code[len(y) :] * width + np.maximum(place + d, 0) for d in (-left, right))
    return int((np.searchsorted(held, to, "right") > np.searchsorted(held, from_, "left")).sum())


def runs_suffice(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the runs of two strings allow enough matched characters; never wrongly false."""
    matched = needed(min(len(a), len(b)))
    for q in RUNS:
        least = matched - (q - 1) * (len(a) + len(b) - 2 * matched + 1)
        if least > 0 and common_runs(a, b, q, len(a) - matched, len(b) - matched) < least:
            return False
    return True


class Chosen:
    """Chosen strings with their bounds, to which candidates are compared."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.points = [code_points(t) for t in texts]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *self.points]))
        self.counts = count_matrix(texts, self.alphabet)
        self.matchers: dict[int, difflib.SequenceMatcher] = {}

    def _blocks(self, candidate: str, place: int) -> int:
        """Characters in matching blocks; what is known of the chosen string is kept for the next candidate."""
        if place not in self.matchers:
            self.matchers[place] = difflib.SequenceMatcher(None, "", self.texts[place], autojunk=False)
        matcher = self.matchers[place]
        matcher.set_seq1(candidate)
        return sum(block.size for block in matcher.get_matching_blocks())

    def first_near(self, candidates: list[str | None], begin: int = 0, ends: np.ndarray | None = None) -> np.ndarray:
        """For each candidate the place of the first chosen string from ``begin`` on that it nearly repeats, or -1.

        ``ends``: for each candidate how many chosen strings it may be compared with.
        """
        found = np.full(len(candidates), -1)
        lengths = np.array([len(c or "") for c in candidates], dtype=np.int64)
        counts = count_matrix(candidates, self.alphabet)
        points: dict[int, np.ndarray] = {}
        for place in range(begin, len(self.texts)):
            open_ = (found < 0) & (lengths > 0) & (self.lengths[place] > 0)
            if ends is not None:
                open_ &= ends > place
            rows = np.flatnonzero(open_)
            short, long = np.minimum(lengths[rows], self.lengths[place]), np.maximum(lengths[rows], self.lengths[place])
            rows, short = (x[short / long >= MIN_LENGTH_RATIO] for x in (rows, short))
            shared = np.minimum(counts[rows], self.counts[place]).sum(axis=1)
            for row in rows[shared / short >= MIN_OVERLAP].tolist():
                if row not in points:
                    points[row] = code_points(candidates[row])
                if runs_suffice(points[row], self.points[place]):
                    shorter = min(lengths[row], self.lengths[place])
                    if self._blocks(candidates[row], place) / shorter >= MIN_MATCHED:
                        found[row] = place
        return found


def blocks_suffice():
    """A function of two text columns: whether enough of the shorter one lies in matching blocks."""

    @F.arrow_udf("boolean")
    def suffice(a: pa.Array, b: pa.Array) -> pa.Array:
        known: dict[str, Chosen] = {}
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            if not x or not y:
                out.append(False)
                continue
            if y not in known:
                if len(known) >= 64:
                    known.clear()
                known[y] = Chosen([y])
            chosen = known[y]
            out.append(
                runs_suffice(code_points(x), chosen.points[0])
                and chosen._blocks(x, 0) / min(len(x), len(y)) >= MIN_MATCHED
            )
        return pa.array(out, pa.bool_())

    return suffice
