"""Expansion of alignments into residue coordinates, in one pass over each batch of rows.

Positions and match states are running counts. They are cumulative sums over the
characters of all alignments of a batch laid end to end, less what stands before the
row; so the work is linear in the length of the alignments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import code_points

CELL = "struct<raw_position:int,match_state:int,is_insertion:boolean,residue:string>"
_CELL = pa.struct([
    ("raw_position", pa.int32()), ("match_state", pa.int32()), ("is_insertion", pa.bool_()), ("residue", pa.string()),
])
_GAP, _DASH, _NONE = ord("."), ord("-"), -1

# The reasons written for a broken alignment, in the order of the rules.
REASONS = {
    "shape": "Invalid HMM alignment length or 1-based origin",
    "symbol": "Invalid HMM alignment symbol",
    "empty": "Reported HMM domain has no aligned residues",
    "residue": "HMM alignment does not match the full input sequence",
    "state": "HMM match state is out of range",
    "end": "HMM alignment terminal coordinate disagrees with target_to",
}


def _laid(texts: list[str | None], widths: np.ndarray) -> np.ndarray:
    """Code points of all texts, each cut or filled with ``_NONE`` to its width."""
    out = np.full(int(widths.sum()), _NONE, dtype=np.int64)
    lengths = np.array([len(t or "") for t in texts], dtype=np.int64)
    points = code_points("".join(t or "" for t in texts))
    inside = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fits = inside < np.repeat(widths, lengths)
    out[(inside + np.repeat(np.cumsum(widths) - widths, lengths))[fits]] = points[fits]
    return out


def _since_start(steps: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """How many of ``steps`` hold before each place of its row."""
    run = np.cumsum(steps) - steps
    first = np.cumsum(widths) - widths
    return run - np.repeat(run[np.minimum(first, max(len(run) - 1, 0))] if len(run) else run, widths)


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    known = np.asarray(column.is_valid())
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known


def _letters(points: np.ndarray, allowed: tuple[int, ...]) -> np.ndarray:
    """Whether each code point is a letter or one of ``allowed``."""
    distinct, back = np.unique(points, return_inverse=True)
    good = np.array([p in allowed or (p >= 0 and chr(p).isalpha()) for p in distinct.tolist()], dtype=bool)
    return good[back]


class Walk:
    """The cells of some alignments, flat, with the row of each.

    A ``.`` in the profile is an insertion: the residue has no state. A ``-``
    or ``.`` in the target is a deletion: the state has no residue.
    """

    def __init__(self, profiles: list, targets: list, profile_from: pa.Array, target_from: pa.Array):
        self.profiles, self.targets = profiles, targets
        self.rows = len(profiles)
        self.first, self.first_known = _ints(profile_from)
        self.start, self.start_known = _ints(target_from)
        widths = np.array([len(p or "") for p in profiles], dtype=np.int64)
        self.empty = widths == 0
        profile, target = _laid(profiles, widths), _laid(targets, widths)
        kept = (target != _GAP) & (target != _DASH)
        owner = np.repeat(np.arange(self.rows), widths)
        state = self.first[owner] + _since_start((profile != _GAP).astype(np.int64), widths)
        position = self.start[owner] + _since_start((kept & (target != _NONE)).astype(np.int64), widths)
        self.owner, self.state, self.position = owner[kept], state[kept], position[kept]
        self.insertion, self.target = profile[kept] == _GAP, target[kept]
        self.counts = np.bincount(self.owner, minlength=self.rows)
        self.ends = np.cumsum(self.counts)
        distinct, back = np.unique(self.target, return_inverse=True)
        upper = ["" if p == _NONE else chr(p).upper() for p in distinct.tolist()]
        self.residue = pa.array(upper, pa.string()).take(pa.array(back)) if len(distinct) else pa.array([], pa.string())
        self.point = np.array([ord(u) if len(u) == 1 else _NONE for u in upper], dtype=np.int64)[back]

    def cells(self) -> pa.ListArray:
        no_state = self.insertion | ~self.first_known[self.owner]
        values = pa.StructArray.from_arrays(
            [
                pa.array(self.position.astype(np.int32), mask=~self.start_known[self.owner]),
                pa.array(self.state.astype(np.int32), mask=no_state), pa.array(self.insertion), self.residue,
            ],
            fields=list(_CELL),
        )
        offsets = pa.array(np.concatenate([[0], self.ends]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=pa.array(self.empty))

    def errors(self, target_to: pa.Array, sequences: list, owner: np.ndarray, states: pa.Array) -> list[str | None]:
        """The first rule that each alignment breaks; ``owner`` is the sequence of each alignment."""
        n = self.rows
        last, last_known = _ints(target_to)
        most, most_known = _ints(states)
        lp, lt = (np.array([-1 if t is None else len(t) for t in x], dtype=np.int64) for x in (self.profiles, self.targets))
        both = (lp >= 0) & (lt >= 0)
        shape = (both & (lp != lt)) | (self.first_known & (self.first < 1)) | (self.start_known & (self.start < 1))
        symbol = np.zeros(n, dtype=bool)
        for texts, lengths, allowed in ((self.profiles, lp, (_GAP,)), (self.targets, lt, (_GAP, _DASH))):
            widths = np.maximum(lengths, 0)
            bad = ~_letters(_laid(texts, widths), allowed)
            symbol |= np.bincount(np.repeat(np.arange(n), widths)[bad], minlength=n) > 0
        length = np.array([-1 if s is None else len(s) for s in sequences], dtype=np.int64)
        begin = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        points = code_points("".join(s or "" for s in sequences)).astype(np.int64)
        mine = owner[self.owner]
        there = (self.position >= 1) & (self.position <= length[mine])
        letter = np.full(len(mine), _NONE - 1)
        letter[there] = points[(begin[mine] + self.position - 1)[there]]
        wrong_residue = (length[mine] >= 0) & self.start_known[self.owner] & (letter != self.point)
        known = ~self.insertion & self.first_known[self.owner]
        beyond = most_known[self.owner] & (self.state > most[self.owner])
        wrong_state = known & ((self.state < 1) | beyond)
        broken = np.flatnonzero(wrong_residue | wrong_state)
        # the first broken cell of a row decides; in one cell the residue is looked at first
        rows, at = np.unique(self.owner[broken], return_index=True)
        cell = dict(zip(rows.tolist(), np.where(wrong_residue[broken[at]], 0, 1).tolist()))
        out: list[str | None] = []
        for row in range(n):
            if shape[row]:
                out.append(REASONS["shape"])
            elif symbol[row]:
                out.append(REASONS["symbol"])
            elif not self.counts[row]:
                out.append(REASONS["empty"])
            elif row in cell:
                out.append(REASONS["state" if cell[row] else "residue"])
            elif last_known[row] and self.start_known[row] and self.position[self.ends[row] - 1] != last[row]:
                out.append(REASONS["end"])
            else:
                out.append(None)
        return out


def alignment_columns(profile: Column, target: Column, profile_from: Column, target_from: Column) -> Column:
    """Residues of an alignment with their position and match state; NULL for an empty profile."""

    @F.arrow_udf(f"array<{CELL}>")
    def cells(p: pa.Array, t: pa.Array, pf: pa.Array, tf: pa.Array) -> pa.Array:
        return Walk(p.to_pylist(), t.to_pylist(), pf, tf).cells()

    return cells(profile, target, profile_from, target_from)


def alignment_error(
    profile: Column, target: Column, profile_from: Column, target_from: Column, target_to: Column,
    sequence: Column, profile_length: Column,
) -> Column:
    """The first rule the alignment breaks, or NULL."""

    @F.arrow_udf("string")
    def error(
        p: pa.Array, t: pa.Array, pf: pa.Array, tf: pa.Array, tt: pa.Array, s: pa.Array, n: pa.Array
    ) -> pa.Array:
        walk = Walk(p.to_pylist(), t.to_pylist(), pf, tf)
        return pa.array(walk.errors(tt, s.to_pylist(), np.arange(len(p)), n), pa.string())

    return error(profile, target, profile_from, target_from, target_to, sequence, profile_length)


def aligned_domains(domains: Column, sequence: Column, profile_length: int) -> Column:
    """Number, cells, states without a residue and first broken rule of every domain of a row."""

    @F.arrow_udf(f"array<struct<number:int,cells:array<{CELL}>,deleted:array<int>,error:string>>")
    def aligned(lists: pa.Array, sequences: pa.Array) -> pa.Array:
        counts = np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64)
        flat = lists.flatten()
        fields = dict(zip([f.name for f in flat.type], flat.flatten()))
        walk = Walk(
            fields["hmm_sequence"].to_pylist(), fields["target_sequence"].to_pylist(), fields["hmm_from"], fields["target_from"]
        )
        owner = np.repeat(np.arange(len(lists)), counts)
        length = pa.array(np.full(len(flat), profile_length, dtype=np.int32))
        errors = walk.errors(fields["target_to"], sequences.to_pylist(), owner, length)
        deleted = []
        for row, (a, b) in enumerate(zip(fields["hmm_from"].to_pylist(), fields["hmm_to"].to_pylist())):
            if a is None or b is None or a > b:
                deleted.append([])
                continue
            lo, hi = walk.ends[row] - walk.counts[row], walk.ends[row]
            used = walk.state[lo:hi][~walk.insertion[lo:hi]]
            deleted.append(np.setdiff1d(np.arange(a, b + 1), used))
        number = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        names = ["number", "cells", "deleted", "error"]
        values = pa.StructArray.from_arrays(
            [pa.array(number, pa.int32()), walk.cells(), pa.array(deleted, pa.list_(pa.int32())), pa.array(errors, pa.string())],
            names=names,
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values)

    return aligned(domains, sequence)


def match_states(cells: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(cells, lambda c: c["match_state"])))


def deleted_states(first: Column, last: Column, matched: Column) -> Column:
    """States of ``first..last`` that no residue occupies."""
    span = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.array_except(span, matched)
