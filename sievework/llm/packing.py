"""Best-fit packing of token sequences by large-item matching on the histogram of lengths.

Only lengths matter for the plan, and there are at most ``capacity`` of them.
So the plan is made once for the histogram, in groups of equal bins, and each
piece finds its bin from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, numbered

CAPACITY = 2048
# Up to here both tokenizer libraries sort code points into letters, digits and
# others alike (a test compares them one by one); other texts take the reference library.
SHARED = re.compile("[^\x00-\u2fff]")


class Encoder:
    """Ids of the byte-level BPE in ``folder_path(name)``; special strings are ordinary text.

    ``tokenizers`` defines the ids. ``tiktoken`` gives the same ones from the
    same vocabulary about four times faster, so it encodes the texts whose
    characters the two libraries are known to treat alike.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = True
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if SHARED.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def public_encoder(name: str) -> Encoder:
    """One encoder per worker process; vocabulary files are read in place, never copied."""
    if name not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[name] = Encoder(
            public_tokenizers.path(f"{name}.json"),
            public_tokenizers.path(f"{name}.tiktoken"),
            public_tokenizers.PATTERN,
        )
    return _ENCODERS[name]


def cut_documents(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", key: str = "doc_id",
    text: str = "text", end_id: int = 0,
) -> DataFrame:
    """Pieces ``(key, piece, start, length, ids_crc32)``; a longer document gives what is above full pieces first, then full pieces.

    A document is its ids and ``end_id``. NULL texts are empty: one piece with the end id.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = narrow.schema["_key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = public_encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                owner, piece, start, length, crc = [], [], [], [], []
                for row, value in enumerate(batch.column("_text")):
                    ids = np.append(encode(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    rest = len(ids) % capacity or capacity
                    borders = [0, *range(rest, len(ids) + 1, capacity)]
                    for number, (begin, to) in enumerate(zip(borders[:-1], borders[1:])):
                        part = ids[begin:to]
                        owner.append(row)
                        piece.append(number)
                        start.append(begin)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["_key", "piece", "start", "length", "ids_crc32"],
                )

    return narrow.mapInArrow(cut, f"_key {kind}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan ``(length, first rank, how many, first bin, offset)`` and the number of bins.

    Items above a third of the capacity stand at most two to a bin: from the
    largest down, each takes the largest other one that still fits. Then smaller
    items, from the largest down, go where the least room is left; a new bin is
    opened when none fits. Equal bins are kept together as a range and split
    only when the next items do not fill the whole range.
    """
    left = {k: v for k, v in counts.items() if v}
    used: Counter[int] = Counter()
    plan: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first bin, how many)
    order: list[int] = []  # the rooms that exist, ascending
    bins = 0

    def put(length: int, many: int, first: int, offset: int) -> None:
        plan.append((length, used[length], many, first, offset))
        used[length] += many
        left[length] -= many

    def leave(room: int, first: int, many: int) -> None:
        if room not in rooms:
            bisect.insort(order, room)
        rooms.setdefault(room, []).append((first, many))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        while left[length]:
            other = next((k for k in large if k <= capacity - length and left[k] > (k == length)), None)
            many = left[length] if other is None else left[length] // 2 if other == length else min(left[length], left[other])
            put(length, many, bins, 0)
            if other is not None:
                put(other, many, bins, length)
            leave(capacity - length - (other or 0), bins, many)
            bins += many
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                many = max(1, left[length] // each)
                for k in range(min(each, left[length])):
                    put(length, many, bins, k * length)
                    room = capacity - (k + 1) * length
                leave(room, bins, many)
                bins += many
                continue
            room = order[at]
            first, there = rooms[room].pop()
            each = min(room // length, max(1, left[length] // there))
            many = min(there, left[length])
            for k in range(each):
                put(length, many, first, capacity - room + k * length)
            leave(room - each * length, first, many)
            if many < there:
                rooms[room].append((first + many, there - many))
            if not rooms[room]:
                del rooms[room]
                order.remove(room)
    return plan, bins


def pack_documents(
    scratch: Scratch, docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k",
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``.

    Rows that agree in id are separate documents. An empty table gives no rows.
    Pieces are numbered in the order (length, id, piece, CRC); the histogram and
    the plan hold at most a few numbers per length whatever the number of rows.
    """
    cut = scratch.keep(cut_documents(docs, capacity, vocabulary, key, text))  # the range sort reads it twice
    pieces = numbered(scratch, cut, ["length", "_key", "piece", "ids_crc32"], "_row")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan, _ = plan_bins(counts, capacity)
    first, total = {}, 0
    for length in sorted(counts):
        first[length], total = total, total + counts[length]
    steps = np.array(sorted((first[n] + rank, at, offset) for n, rank, _, at, offset in plan), dtype=np.int64).reshape(-1, 3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row").to_numpy()
            step = steps[np.searchsorted(steps[:, 0], row, "right") - 1]
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "_row"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(step[:, 1] + row - step[:, 0]), pa.array(step[:, 2])],
                names=[key, *[n for n in batch.schema.names[1:] if n != "_row"], "sequence_id", "offset"],
            )

    kind = pieces.schema["_key"].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ordered = pieces.select("_key", "piece", "start", "length", "ids_crc32", "_row")
    return ordered.mapInArrow(place, schema)
