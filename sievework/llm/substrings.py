"""Substring dedup: paragraphs and overlapping word windows as candidates, verified, extended and clustered.

A paragraph is a line. Long enough paragraphs that collide in a MinHash band are
verified by exact Jaccard similarity and grouped by components. Passages that are
copied into other paragraphs are found by windows of words: a window has so few
shingles that one other word puts it below the similarity, so all its bands fall
together into one, the hash of its words. Of every ``GAP`` windows in a row the least
hash is taken, so two texts that share ``WINDOW + GAP - 1`` words share a taken window.
From there a match is extended word by word to its true ends, which lie less than
``GAP`` words away or beyond the next taken window. A paragraph or passage is a repeat
in every document but the first (by key) that has it or, for paragraphs, one of its
group. Runs of repeats with enough words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from .base import Scratch, attached_to_group
from .links import linked_groups
from .words import _ODD, Words, _inverse, buffers, mix, shingles, sub_batches, words

LEAST_WORDS = 30  # of a run that is removed
WINDOW, GAP = 10, 20  # any LEAST_WORDS - 1 words in a row hold a taken window
SIDE = GAP - 1  # words on each side of a window with which a match is extended
BRIDGE = 4  # up to as many other words between repeats go with them
PARAGRAPH = LEAST_WORDS  # words of a paragraph that enters MinHash
SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 10, 3  # a pair of similarity 0.8 meets in a band with probability 0.999

_MULTIPLY = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of ``width`` values from each place on, where there are as many."""
    step, now = 1, values
    while step * 2 <= width:
        now, step = best(now[:-step], now[step:]), step * 2
    return best(now[: len(values) - width + 1], now[width - step :]) if width > step else now


class Units:
    """Paragraphs and taken windows of some rows: word ranges, rows and hashes."""

    def __init__(self, column: pa.Array):
        raw, ends = buffers(column)
        base = int(ends[0]) if len(ends) else 0
        raw = raw[base : int(ends[-1])] if len(ends) else raw
        self.words: Words = words(column)
        self.raw, self.offsets = raw, ends - base
        w, n = self.words, len(self.words.hash)
        self.row = w.row()
        line_ends = np.concatenate([[0], np.cumsum(raw == 10)])
        new_line = np.ones(n, dtype=bool)
        new_line[1:] = (self.row[1:] != self.row[:-1]) | (line_ends[w.start[1:]] > line_ends[w.end[:-1]])
        up, down = np.full(n + 1, _ODD, dtype=np.uint64), np.full(n + 1, _inverse(int(_ODD)), dtype=np.uint64)
        up[0] = down[0] = 1
        self._down = np.multiply.accumulate(down)
        self._run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * np.multiply.accumulate(up)[:n], dtype=np.uint64)])
        self.paragraph = np.concatenate([np.flatnonzero(new_line), [n]])
        self.paragraph_row = self.row[self.paragraph[:-1]]
        self.paragraph_hash = self._hashes(self.paragraph[:-1], self.paragraph[1:])
        self.window = self._taken(n)
        self.window_hash = self._hashes(self.window, self.window + WINDOW)

    def _hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words of each range, in their order."""
        value = (self._run[end] - self._run[begin]) * self._down[begin]
        return mix(value + (end - begin).astype(np.uint64)).view(np.int64)

    def _taken(self, n: int) -> np.ndarray:
        """Where the taken windows begin: every least hash of ``GAP`` windows of a row, ties included."""
        if n < WINDOW + SIDE:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(n - WINDOW + 1)
        value = self._hashes(at, at + WINDOW).view(np.uint64)
        least = _sliding(value, GAP, np.minimum)
        full = self.row[: len(least)] == self.row[np.arange(len(least)) + WINDOW + SIDE - 1]
        least = np.where(full, least, np.uint64(0))
        around = np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)])
        inside = self.row[at] == self.row[at + WINDOW - 1]
        return np.flatnonzero(inside & (_sliding(around, GAP, np.maximum) == value))

    def sides(self, begin: np.ndarray) -> np.ndarray:
        """The words around windows, nearest first: ``SIDE`` to the left, then to the right; 0 beyond the row."""
        step = np.arange(SIDE)
        place = np.concatenate([begin[:, None] - 1 - step, begin[:, None] + WINDOW + step], axis=1)
        short = (self.words.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        inside = np.clip(place, 0, max(len(short) - 1, 0))
        same = (inside == place) & (self.row[inside] == self.row[begin][:, None])
        return np.where(same, short[inside], np.uint32(0)).astype("<u4")


def _key(key: str, text: str) -> Column:
    """The key as a number; where there is none, the text gives one above 2**62."""
    late = F.lit(2**62) + F.xxhash64(text).bitwiseAND(F.lit(2**61 - 1))
    return F.coalesce(F.col(key).cast("long"), late)


def _given(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key as a number, a hash of the text to tell rows apart, and the text."""
    return docs.select(_key(key, text).alias("doc"), F.xxhash64(text).alias("tk"), F.col(text).alias("_text"))


def _window_rows(given: DataFrame) -> DataFrame:
    """``(hash, doc, tk)``: the distinct taken windows of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "_text"):
                u = Units(batch.column("_text"))
                row, h = u.row[u.window], u.window_hash
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                keep = np.ones(len(h), dtype=bool)
                keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                at = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[keep]), batch.column("doc").take(at), batch.column("tk").take(at)], names=["hash", "doc", "tk"]
                )

    return given.mapInArrow(run, "hash long, doc long, tk long")


def _window_sides(wanted: DataFrame) -> DataFrame:
    """``(hash, sides)`` of the windows named in ``hashes`` of ``(_text, hashes)``, at their first place in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "_text"):
                u, named = Units(batch.column("_text")), batch.column("hashes")
                row = u.row[u.window]
                for r in range(batch.num_rows):
                    mine = slice(*np.searchsorted(row, [r, r + 1]))
                    h, first = np.unique(u.window_hash[mine], return_index=True)
                    asked = np.isin(h, named[r].values.to_numpy())
                    sides = u.sides(u.window[mine][first[asked]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[asked]), pa.array([s.tobytes() for s in sides], pa.binary())], names=["hash", "sides"]
                    )

    return wanted.mapInArrow(run, "hash long, sides binary")


def _paragraph_rows(given: DataFrame) -> DataFrame:
    """``(node, doc, tk, bands)``: long paragraphs with their MinHash bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "_text"):
                u = Units(batch.column("_text"))
                long = np.flatnonzero(np.diff(u.paragraph) >= PARAGRAPH)
                token, first = _shingles(u, long)
                least = np.zeros((BANDS * ROWS, len(long)), dtype=np.uint64)
                if len(long):
                    token = mix(token)
                    for k, multiply in enumerate(_MULTIPLY):
                        value = token * multiply
                        value ^= value >> np.uint64(32)
                        least[k] = np.minimum.reduceat(value, first[:-1])
                bands = np.zeros((len(long), BANDS), dtype=np.int64)
                for b in range(BANDS):
                    sig = np.full(len(long), b + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        sig = mix(sig * _ODD + least[b * ROWS + r])
                    bands[:, b] = sig.view(np.int64)
                at = pa.array(u.paragraph_row[long])
                offsets = pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.paragraph_hash[long]), batch.column("doc").take(at), batch.column("tk").take(at),
                     pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))],
                    names=["node", "doc", "tk", "bands"],
                )

    return given.mapInArrow(run, "node long, doc long, tk long, bands array<long>")


def _shingles(u: Units, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles of the chosen paragraphs, all of which have ``SHINGLE`` words at least."""
    all_runs = Words(u.words.start, u.words.end, u.words.hash, np.concatenate([u.paragraph[:-1], u.paragraph[-1:]]))
    token, first = shingles(all_runs, SHINGLE)
    sizes = np.diff(first)[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(first[:-1][which] - ends[:-1], sizes) + np.arange(ends[-1])
    return token[at], ends


def _paragraph_sets(wanted: DataFrame) -> DataFrame:
    """``(node, n, tokens)`` of the paragraphs named in ``nodes`` of ``(_text, nodes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "_text"):
                u = Units(batch.column("_text"))
                named = batch.column("nodes").flatten().to_numpy()
                which = np.flatnonzero(np.isin(u.paragraph_hash, named) & (np.diff(u.paragraph) >= PARAGRAPH))
                which = which[np.unique(u.paragraph_hash[which], return_index=True)[1]]
                token, ends = _shingles(u, which)
                sets = [np.unique(token[a:b].view(np.int64)) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.paragraph_hash[which]), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["node", "n", "tokens"],
                )

    rows = wanted.mapInArrow(run, "node long, n int, tokens array<long>")
    return rows.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def _repeated(u: Units, hashes: np.ndarray, sides: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Which words of one text lie in a marked line, or in a marked window extended as far as its other text agrees."""
    change = np.zeros(len(u.words.hash) + 1, dtype=np.int64)
    line = np.flatnonzero(np.isin(u.paragraph_hash, lines) & (np.diff(u.paragraph) >= PARAGRAPH))
    np.add.at(change, u.paragraph[line], 1)
    np.add.at(change, u.paragraph[line + 1], -1)
    if len(hashes):
        order = np.argsort(hashes)
        at = np.minimum(np.searchsorted(hashes[order], u.window_hash), len(hashes) - 1)
        hit = np.flatnonzero(hashes[order][at] == u.window_hash)
        begin = u.window[hit]
        mine = u.sides(begin)
        agree = (mine == sides[order][at[hit]]) & (mine != 0)
        reach = [np.logical_and.accumulate(part, axis=1).sum(axis=1) for part in (agree[:, :SIDE], agree[:, SIDE:])]
        np.add.at(change, begin - reach[0], 1)
        np.add.at(change, begin + WINDOW + reach[1], -1)
    return np.cumsum(change[:-1]) > 0


def _cleaned(text: str, marked: dict) -> tuple[str, int, int]:
    """The text without its runs of repeats, the words removed and the runs."""
    u = Units(pa.array([text]))
    windows = marked["windows"] or []
    hashes = np.array([w["hash"] for w in windows], dtype=np.int64)
    sides = np.frombuffer(b"".join(w["sides"] for w in windows), dtype="<u4").reshape(-1, 2 * SIDE)
    sure = _repeated(u, hashes, sides, np.array(marked["lines"] or [], dtype=np.int64))
    if marked["whole"]:
        sure[:] = True
    place = np.arange(len(sure))
    before = np.maximum.accumulate(np.where(sure, place, -1))
    after = np.minimum.accumulate(np.where(sure, place, len(sure))[::-1])[::-1]
    hit = sure | ((before >= 0) & (after < len(sure)) & (after - before <= BRIDGE + 1))
    total = np.concatenate([[0], np.cumsum(sure)])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    raw, out, at, words_gone, runs = u.raw.tobytes(), [], 0, 0, 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        many = int(b - a)
        if total[b] - total[a] < LEAST_WORDS:
            continue
        begin, end = int(u.words.start[a]), int(u.words.end[b - 1])
        left = raw[at:begin]
        kept = left.rstrip(b" \t\n\v\f\r")
        rest = raw[end:].lstrip(b" \t\n\v\f\r")
        gap = left[len(kept) :] + raw[end : len(raw) - len(rest)]
        out.append(kept)
        out.append(b"" if not rest or not (kept or any(out)) else b"\n" if b"\n" in gap else b" ")
        at = len(raw) - len(rest)
        words_gone, runs = words_gone + many, runs + 1
    out.append(raw[at:])
    return b"".join(out).decode(), words_gone, runs


def remove_repeats(scratch: Scratch, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with cleaned texts, ``_removed_words`` and ``_removed_runs``; one row per row.

    Words are compared with ``A``–``Z`` lower-cased and with their punctuation.
    Repeats inside one document stay. Rows that share a key count as one document, and so do
    rows without a key that share a text; they come after all others. NULL and empty
    texts stay as they are. A document that consists of repeats gets an empty text. All columns are kept.
    """
    whole = _given(docs, key, text)
    texts = scratch.keep(whole.groupBy("tk").agg(F.min("doc").alias("first"), F.count("*").alias("_weight")))
    named = attach_by_key(whole.drop("_text"), texts.filter("_weight > 1"), ["tk"], "_weight", F.xxhash64("doc"))
    copies = scratch.keep(named.filter("first < doc").select("doc", "tk").distinct())
    given = scratch.keep(whole.join(copies, ["doc", "tk"], "left_anti"))  # the first of each group of equal texts

    found = scratch.keep(_window_rows(given))
    repeated = scratch.keep(
        found.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("hash", "first")
    )
    asked = repeated.groupBy(F.col("first").alias("doc")).agg(F.collect_list("hash").alias("hashes"))
    sides = _window_sides(given.join(asked, "doc").select("_text", "hashes")).groupBy("hash").agg(F.max("sides").alias("sides"))
    seeds = scratch.keep(repeated.join(sides, "hash").select("hash", "first", "sides"))
    scratch.drop(repeated)
    marks = scratch.keep(
        found.join(seeds, "hash").filter("first < doc").groupBy("doc", "tk")
        .agg(F.collect_list(F.struct("hash", "sides")).alias("windows"))
    )
    scratch.drop(found, seeds)

    lines = scratch.keep(_paragraph_rows(given))
    nodes = scratch.keep(
        lines.groupBy("node").agg(F.min(F.struct("doc", "tk")).alias("at"), F.first("bands").alias("bands"))
        .select("node", "at.doc", "at.tk", "bands")
    )
    places = scratch.keep(lines.select("node", "doc", "tk"))
    scratch.drop(lines)
    band = nodes.select("node", F.explode("bands").alias("sig"))
    shared = band.groupBy("sig").agg(F.count("*").alias("rows")).filter("rows > 1").select("sig")
    buckets = scratch.keep(band.join(shared, "sig"))
    wanted = nodes.join(buckets.select("node").distinct(), "node").groupBy("doc", "tk").agg(F.collect_set("node").alias("nodes"))
    located = given.join(wanted, ["doc", "tk"]).select("_text", "nodes")
    sets = scratch.keep(_paragraph_sets(located))
    groups = linked_groups(scratch, buckets, sets, PERCENT)
    firsts = nodes.select("node", "doc").join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc")
    first = firsts.groupBy("root").agg(F.min("doc").alias("first"), F.count("*").alias("_weight"))
    in_group = attached_to_group(firsts.select("node", "root"), first, "root", "node").select("node", "first")
    line_marks = (
        places.join(in_group, "node").filter("first < doc").groupBy("doc", "tk").agg(F.collect_set("node").alias("lines"))
    )
    marked = scratch.keep(
        marks.join(line_marks, ["doc", "tk"], "full").withColumn("whole", F.lit(False))
        .unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True)
        .select(F.col("doc").alias("_doc"), F.col("tk").alias("_tk"), F.struct("windows", "lines", "whole").alias("_marked"))
    )
    scratch.drop(texts, given, marks, copies, nodes, places, buckets, sets, groups)

    # Texts too short for any removal match nothing: instead of the hash of a text that may be everywhere they get one of their own.
    short = F.coalesce(F.octet_length(text), F.lit(0)) < 2 * LEAST_WORDS - 1
    own = F.when(short, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(text))
    keyed = docs.withColumns({"_doc": _key(key, text), "_tk": own})
    rows = keyed.join(marked, ["_doc", "_tk"], "left").drop("_doc", "_tk")
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, text):
                texts, gone, runs = [], [], []
                for value, hashes in zip(batch.column(text), batch.column("_marked")):
                    result = (value.as_py(), 0, 0)
                    if hashes.is_valid and value.is_valid:
                        result = _cleaned(value.as_py(), hashes.as_py())
                    texts.append(result[0])
                    gone.append(result[1])
                    runs.append(result[2])
                columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
                columns += [pa.array(gone, pa.int64()), pa.array(runs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "_removed_words", "_removed_runs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.select(*names, "_marked").mapInArrow(clean, f"{fields}, _removed_words long, _removed_runs long")
