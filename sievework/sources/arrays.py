"""JSON arrays as rows, one per element, read in byte ranges by many tasks.

What a range of bytes does to the reader's state is a small outline: whether it
flips "inside a string", and by how much it changes the depth if it begins outside or
inside one. Outlines compose, so a prefix over the ranges of a file tells
the state at the start of each; then every range is cut into records alone. Only
records that cross a border are put together afterwards.

Ranges come from Spark's text reader with ``}`` as the separator, so files are opened
through Hadoop's file systems, and no range ends within a character or an escape.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

CHUNK = 1 << 20
_QUOTE, _ESCAPE = ord('"'), ord("\\")
_STEP = np.zeros(256, dtype=np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_BLANK = b" \t\r\n"
_BOM = "﻿".encode()


def _marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Brackets, how many quotes that are not escaped stand before each, and the number of those quotes."""
    quotes = np.flatnonzero(raw == _QUOTE)
    escapes = np.flatnonzero(raw == _ESCAPE)
    if len(escapes) and len(quotes):
        fresh = np.diff(escapes, prepend=-2) != 1
        run = np.arange(len(escapes)) - np.maximum.accumulate(np.where(fresh, np.arange(len(escapes)), 0)) + 1
        at = np.searchsorted(escapes, quotes - 1)
        held = at < len(escapes)
        held[held] = escapes[at[held]] == quotes[held] - 1
        odd = np.zeros(len(quotes), dtype=bool)
        odd[held] = run[at[held]] % 2 == 1
        quotes = quotes[~odd]
    brackets = np.flatnonzero(_STEP[raw])
    return brackets, np.searchsorted(quotes, brackets), len(quotes)


@dataclass
class Outline:
    """What some bytes do to the state; ``then`` composes two of them."""

    flips: int = 0
    outside: int = 0
    inside: int = 0

    def then(self, later: Outline) -> Outline:
        swap = self.flips % 2
        return Outline(
            (self.flips + later.flips) % 2,
            self.outside + (later.inside if swap else later.outside),
            self.inside + (later.outside if swap else later.inside),
        )


def outline(data: bytes) -> Outline:
    raw = np.frombuffer(data, dtype=np.uint8)
    brackets, before, quotes = _marks(raw)
    step, odd = _STEP[raw[brackets]], before % 2 == 1
    return Outline(quotes % 2, int(step[~odd].sum()), int(step[odd].sum()))


class RecordScan:
    """Cuts the bytes of an array into the text of its elements, in time linear in their length.

    It carries whether a string is open, the depth, and the bytes of an element not
    ended yet. ``depth`` of two or more means to begin within an element.
    """

    def __init__(self, name: str, inside: bool = False, depth: int = 0, first: bool = True):
        self.name, self.inside, self.depth, self.first = name, inside, depth, first
        self.count = 0
        self.begun = False
        self.held: list[bytes] | None = [] if depth >= 2 else None
        self.size, self.probe = 0, CHUNK
        self.gap = b""

    def fail(self, why: object) -> ValueError:
        return ValueError(f"Invalid JSON in {self.name}: {why}")

    def feed(self, data: bytes) -> Iterator[tuple[bytes, bool]]:
        """Elements that end in ``data`` and whether they also began in what was fed."""
        raw = np.frombuffer(data, dtype=np.uint8)
        brackets, before, quotes = _marks(raw)
        brackets = brackets[(before + self.inside) % 2 == 0]
        step = _STEP[raw[brackets]]
        level = self.depth + np.cumsum(step)
        at = 0
        for border in brackets[((step > 0) & (level == 2)) | ((step < 0) & (level == 1))].tolist():
            if self.held is None:
                self._between(data[at:border])
                if self.gap != (b"[" if self.first and not self.count else b","):
                    raise self.fail(self._misplaced())
                self.held, self.size, self.probe, self.begun, self.gap, at = [], 0, CHUNK, True, b"", border
                self.count += 1
            else:
                yield b"".join([*self.held, data[at : border + 1]]), self.begun
                self.held, at = None, border + 1
        if self.held is None:
            self._between(data[at:])
        else:
            self._hold(data[at:])
        self.inside = (self.inside + quotes) % 2 == 1
        self.depth = int(level[-1]) if len(level) else self.depth

    def _between(self, data: bytes) -> None:
        if self.first and not self.count and not self.gap:
            data = data.removeprefix(_BOM)
        self.gap += data.translate(None, _BLANK)
        if len(self.gap) > 2 or (self.first and not self.count and self.gap[:1] not in (b"", b"[")):
            raise self.fail(self._misplaced())

    def _misplaced(self) -> str:
        if self.first and not self.count and (self.gap[:1] != b"[" or self.gap[1:2] == b"]"):
            return "expected a non-empty JSON list"
        if self.gap.strip(b"[],"):
            return f"record {self.count + 1} must be an object"
        return f"expected ',' after record {self.count}"

    def _hold(self, data: bytes) -> None:
        """Keep the beginning of an element; a long one is tried now and then, so a bad one fails early."""
        self.held.append(data)
        self.size += len(data)
        if self.begun and self.size > self.probe:
            self.probe = 2 * self.size
            text = b"".join(self.held).decode(errors="ignore")
            try:
                json.JSONDecoder().raw_decode(text)
            except json.JSONDecodeError as error:
                if error.pos < len(text) - 8 and "Unterminated" not in error.msg:
                    raise self.fail(error) from error

    def finish(self, rest: bytes = b"]") -> None:
        """``rest``: what must be left after the last element."""
        if self.held is not None or self.inside:
            raise self.fail("the list does not end")
        if self.gap != rest or (self.first and not self.count):
            raise self.fail(self._misplaced())


def checked(text: bytes, scan: RecordScan) -> str:
    """The text of one element, if it is a JSON object in UTF-8."""
    try:
        decoded = text.decode()
        value = json.loads(decoded)
    except ValueError as error:
        raise scan.fail(f"record {scan.count}: {error}") from error
    if not isinstance(value, dict):
        raise scan.fail(f"record {scan.count} must be an object")
    return decoded


def array_elements(stream, name: str, chunk: int | None = None) -> Iterator[str]:
    """The source text of each object in a top-level JSON array, read from a stream in chunks."""
    scan, kept = RecordScan(name), b""
    while data := stream.read(chunk or CHUNK):
        data = kept + data
        whole = len(data.rstrip(b"\\")) if data.endswith(b"\\") else len(data)
        if whole < len(_BOM) and not scan.count:  # a byte order mark comes in one piece
            kept = data
            continue
        data, kept = data[:whole], data[whole:]
        for text, _ in scan.feed(data):
            yield checked(text, scan)
    for text, _ in scan.feed(kept):
        yield checked(text, scan)
    scan.finish()


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], bytes, int]]:
    """Pieces of ranges ``((input, block, size), bytes, rows)``; rows of one range come together and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        inputs, blocks = batch.column("input"), batch.column("block").to_numpy()
        codes = inputs.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = (inputs[lo].as_py(), int(blocks[lo]), batch.column("size")[lo].as_py())
            parts = batch.column("part").slice(lo, hi - lo).to_pylist()
            yield key, b"}".join(parts) + b"}", hi - lo


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["input", "block", "size", "bytes", "flips", "outside", "inside"]

    def row(key, total, seen):
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, total, seen.flips, seen.outside, seen.inside)))])

    now, total, seen = None, 0, Outline()
    for key, data, _ in _ranges(batches):
        if key != now and now is not None:
            yield row(now, total, seen)
        if key != now:
            now, total, seen = key, 0, Outline()
        total, seen = total + len(data), seen.then(outline(data))
    if now is not None:
        yield row(now, total, seen)


def _entries(outlines: list[tuple]) -> dict[tuple[str, int], tuple[bool, int, bool, bool]]:
    """State at the start of each range, and whether it is its file's first or last one."""
    found: dict[tuple[str, int], tuple[bool, int, bool, bool]] = {}
    inside, depth, total = False, 0, 0
    for place, (name, block, size, length, flips, outside, within) in enumerate(outlines):
        first = not place or outlines[place - 1][0] != name
        last = place + 1 == len(outlines) or outlines[place + 1][0] != name
        if first:
            inside, depth, total = False, 0, 0
        found[name, block] = (inside, depth, first, last)
        depth += within if inside else outside
        inside ^= flips == 1
        total += length
        # the reader's separator is not in the file after the last part, and it drops a byte order mark
        if last and total not in (size + 1, size + 1 - len(_BOM)):
            raise ValueError(f"Invalid JSON in {name}: text after the list")
    return found


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(input, ordinal, record)`` of plain files that hold one JSON array each.

    The driver sees one small row per input split. Elements are checked in tasks;
    a text that is no JSON, an element that is no object and an empty list raise
    an error. Files are cut as Spark cuts text files (``spark.sql.files.maxPartitionBytes``).
    """
    source = spark.read.option("lineSep", "}").text(path)
    parts = source.select(
        F.col("value").cast("binary").alias("part"), F.col("_metadata.file_path").alias("input"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
    )
    seen = parts.mapInArrow(
        _outlined, "input string, block long, size long, bytes long, flips long, outside long, inside long"
    ).collect()
    outlines = sorted(tuple(r) for r in seen)
    files = source.inputFiles()
    if not files or len({r[0] for r in outlines}) < len(files):
        raise ValueError(f"Invalid JSON in {path}: expected a non-empty JSON list")
    entries = _entries(outlines)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["input", "block", "place", "begins", "ends", "record"]

        def close(key, scan):
            *_, last = entries[key[:2]]
            if scan.held is None:
                scan.finish(b"]}" if last else b"")
            elif last:
                raise scan.fail("the list does not end")
            else:
                yield (*key[:2], scan.count, scan.begun, False, b"".join(scan.held).decode())

        def batch(rows):
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])

        now, scan = None, None
        for key, data, _ in _ranges(batches):
            if key != now:
                if now is not None and (rows := list(close(now, scan))):
                    yield batch(rows)
                inside, depth, first, _ = entries[key[:2]]
                now, scan = key, RecordScan(key[0], inside, depth, first)
            rows = []
            for text, begun in scan.feed(data):
                rows.append((*key[:2], scan.count, begun, True, checked(text, scan) if begun else text.decode()))
            if rows:
                yield batch(rows)
        if now is not None and (rows := list(close(now, scan))):
            yield batch(rows)

    pieces = materialise(
        parts.mapInArrow(cut, "input string, block long, place long, begins boolean, ends boolean, record string")
    )
    begun = {(r[0], r[1]): r[2] for r in pieces.filter("begins").groupBy("input", "block").count().collect()}
    starts, total, before = [], 0, None
    for name, block in sorted(entries):
        total = 0 if name != before else total
        starts.append((name, block, total))
        total, before = total + begun.get((name, block), 0), name
    offsets = F.broadcast(spark.createDataFrame(starts, "input string, block long, _start long"))
    placed = pieces.join(offsets, ["input", "block"]).withColumn("ordinal", F.col("_start") + F.col("place"))
    whole = placed.filter("begins and ends").select("input", "ordinal", "record")
    crossing = placed.filter("not (begins and ends)").groupBy("input", "ordinal").agg(
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("x")
    )
    return whole.unionByName(
        crossing.select("input", "ordinal", F.array_join("x.record", "").alias("record")).mapInArrow(
            _proved, "input string, ordinal long, record string"
        )
    )


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, ordinal, record in zip(*(batch.column(c).to_pylist() for c in ("input", "ordinal", "record"))):
            scan = RecordScan(name)
            scan.count = ordinal
            checked(record.encode(), scan)
        yield batch
