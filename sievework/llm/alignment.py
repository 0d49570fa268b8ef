"""Alignment of two tokenizations of the same bytes by interval coalescing.

All tokens of both sides are sorted by their start; a group ends where a start
reaches the largest end so far. Within a group every token meets the other side's tokens
that its bytes overlap. How often two ids are linked in the whole corpus is counted
with map-side sums. Pairs that hold at least a ``1/HOT`` share of all links, of
which there are ``HOT`` at most, are looked up inside tasks; the rest is joined, so
that no key of the join has more than that share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch
from .packing import public_encoder
from .words import sub_batches

HOT = 1 << 16
#: Bytes of text in a window; windows end where tokens of both sides do.
WINDOW = 1 << 19
#: Distinct pairs that a task holds before it hands its sums on.
HELD = 1 << 20


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: visible ones for themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + k): b for k, b in enumerate(others)}}


class ByteTokens:
    """Ids of ``" " + text`` in a byte-level vocabulary and the bytes of each id."""

    def __init__(self, vocabulary: str):
        self.encoder = public_encoder(vocabulary)
        letters, held = byte_level_alphabet(), self.encoder.slow.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(held.values()) + 1)
        for token, number in held.items():
            self.bytes[number] = bytes(letters[c] for c in token)
        self.length = np.array([len(b) for b in self.bytes])

    def __call__(self, text: str) -> np.ndarray:
        return self.encoder(" " + text).astype(np.int64)


class PieceTokens:
    """Ids of ``text`` in a sentencepiece model, which adds the blank itself, and the bytes of each id."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{model}.model"))
        self.bytes = []
        for number in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(number)
            if self.model.is_byte(number):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
        self.length = np.array([len(b) for b in self.bytes])

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.int64)


@dataclass
class Side:
    """Tokens of one side: ids, starts and ends in bytes, and the row of each."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def part(self, lo: int, hi: int) -> Side:
        return Side(self.ids[lo:hi], self.start[lo:hi], self.end[lo:hi], self.row[lo:hi])


def side(rows: list[np.ndarray], length: np.ndarray) -> Side:
    """The tokens of all rows laid end to end."""
    ids = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    end = np.cumsum(length[ids]) if len(ids) else np.zeros(0, np.int64)
    return Side(ids, end - length[ids], end, np.repeat(np.arange(len(rows)), [len(r) for r in rows]))


def coalesce(a: Side, b: Side) -> np.ndarray:
    """The group of each token, ``a``'s before ``b``'s: groups end where a start reaches all ends before it."""
    start, end = np.concatenate([a.start, b.start]), np.concatenate([a.end, b.end])
    order = np.lexsort((np.repeat([0, 1], [len(a.ids), len(b.ids)]), start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of all pairs whose bytes overlap; never more than tokens."""
    first = np.searchsorted(b.end, a.start, "right")
    many = np.searchsorted(b.start, a.end, "left") - first
    left = np.repeat(np.arange(len(a.ids)), many)
    right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return left, right


def windows(a: Side, b: Side, size: int = WINDOW) -> Iterator[tuple[Side, Side]]:
    """Parts of about ``size`` bytes that end where tokens of both sides end."""
    i = j = 0
    while i < len(a.ids):
        to = a.start[i] + size
        p = min(int(np.searchsorted(a.end, to)), len(a.ids) - 1)
        q = min(int(np.searchsorted(b.end, to)), len(b.ids) - 1)
        while a.end[p] != b.end[q]:
            if a.end[p] < b.end[q]:
                p += 1
            else:
                q += 1
        yield a.part(i, p + 1), b.part(j, q + 1)
        i, j = p + 1, q + 1


class Writer:
    """The text form of groups: ids of a group as ``a1,a2|b1``, groups parted by ``;``."""

    def __init__(self, ids: int):
        self.ids = ids
        self.words = [mark + str(k) for mark in (",", "|", ";") for k in range(ids)]

    def parts(self, a: Side, b: Side, group: np.ndarray) -> Iterator[tuple[int, str]]:
        """Rows and their text, each part starting with ``;``."""
        which = np.repeat([0, 1], [len(a.ids), len(b.ids)])
        order = np.lexsort((which, group))
        ids, row = np.concatenate([a.ids, b.ids])[order], np.concatenate([a.row, b.row])[order]
        mark = np.full(len(order), 2)
        same = group[order][1:] == group[order][:-1]
        mark[1:][same] = (which[order][1:] != which[order][:-1])[same]
        word = mark * self.ids + ids
        cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield int(row[lo]), "".join(map(self.words.__getitem__, word[lo:hi].tolist()))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order][0] - 1))
    return keys[order][first], np.add.reduceat(n[order], first)


class Aligner:
    """Both tokenizers of a task."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.a, self.b = ByteTokens(byte_vocabulary), PieceTokens(piece_model)
        self.width = len(self.b.bytes)
        self.writer = Writer(max(len(self.a.bytes), self.width))

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where one of them does not give back all bytes."""
        if text:
            a, b, whole = self.a(text), self.b(text), (" " + text).encode()
            if all(b"".join(map(t.bytes.__getitem__, ids.tolist())) == whole for t, ids in ((self.a, a), (self.b, b))):
                return a, b
        none = np.zeros(0, np.int64)
        return none, none

    def __call__(self, texts: list[str | None], size: int = WINDOW) -> dict[str, pa.Array]:
        """The columns of some texts; ``keys`` are ``a * width + b``, ``links`` how often each occurs in the text."""
        found = [self.ids(t) for t in texts]
        a, b = side([f[0] for f in found], self.a.length), side([f[1] for f in found], self.b.length)
        groups = np.zeros(len(texts), dtype=np.int64)
        digests: dict[int, object] = {}
        rows, keys, counts = [], [], []
        for x, y in windows(a, b, size):
            group = coalesce(x, y)
            opening = np.flatnonzero(np.diff(group[: len(x.ids)], prepend=-1))
            groups += np.bincount(x.row[opening], minlength=len(texts))
            left, right = overlaps(x, y)
            packed = x.row[left] * (len(self.a.bytes) * self.width) + x.ids[left] * self.width + y.ids[right]
            packed, n = np.unique(packed, return_counts=True)
            rows.append(packed)
            counts.append(n)
            for row, text in self.writer.parts(x, y, group):
                if row in digests:
                    digests[row].update(text.encode())
                else:
                    digests[row] = hashlib.sha256(text[1:].encode())
        packed, n = _summed(*(np.concatenate(p) if p else np.zeros(0, np.int64) for p in (rows, counts)))
        owner, keys = np.divmod(packed, len(self.a.bytes) * self.width)
        first = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(links, owner, n)
        return {
            "n_a": pa.array([len(f[0]) for f in found], pa.int64()),
            "n_b": pa.array([len(f[1]) for f in found], pa.int64()),
            "n_groups": pa.array(groups),
            "n_links": pa.array(links),
            "groups_sha256": pa.array([digests[r].hexdigest() if r in digests else "" for r in range(len(texts))], pa.string()),
            "keys": pa.ListArray.from_arrays(pa.array(first), pa.array(keys, pa.int64())),
            "links": pa.ListArray.from_arrays(pa.array(first), pa.array(n, pa.int64())),
        }


FORM = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def tokenised(
    docs: DataFrame, key: str, text: str, byte_vocabulary: str = "byte_bpe_50k", piece_model: str = "piece_bpe_32k"
) -> DataFrame:
    """``(_key, n_a, n_b, n_groups, n_links, groups_sha256, keys, links)`` of each row."""
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(byte_vocabulary, piece_model)
        for whole in batches:
            for batch in sub_batches(whole, "_text", WINDOW):
                columns = align(batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("_key"), *columns.values()], names=["_key", *columns])

    kind = narrow.schema["_key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"_key {kind}, {FORM}, keys array<long>, links array<long>")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """``(key, n, best)`` of each id pair: its links in all rows, and whether no pair with its B id has more.

    The largest numbers per B id are at most ``width`` rows, so they are broadcast.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more, many = (batch.column(c).flatten().to_numpy() for c in ("keys", "links"))
            keys, n = _summed(np.concatenate([keys, more]), np.concatenate([n, many]))
            if len(keys) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
                keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    counts = found.select("keys", "links").mapInArrow(summed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("_b", F.col("key") % width)
    most = counts.groupBy("_b").agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(most), "_b").select("key", "n", (F.col("n") == F.col("_most")).alias("best"))


def align_documents(
    scratch: Scratch, docs: DataFrame, key: str = "doc_id", text: str = "text",
    byte_vocabulary: str = "byte_bpe_50k", piece_model: str = "piece_bpe_32k", hot: int = HOT,
) -> DataFrame:
    """One row per document: ``key``, token, group and link counts, the digest of its groups, ``n_best`` and ``count_sum``.

    ``n_best`` counts the links of the document whose id pair no other A id beats for that B
    id in the whole corpus (ties count); ``count_sum`` adds the corpus counts of all its
    links. Texts that are NULL or empty, and texts that one side does not give back byte by byte, have
    zeros and no digest. Rows that agree in ``key`` or text are separate documents and
    all count in the corpus. An empty table gives no rows; other columns are not read.
    """
    narrow = tokenised(docs, key, text, byte_vocabulary, piece_model)
    found = scratch.keep(narrow.withColumn("_row", F.monotonically_increasing_id()))
    width = _width(piece_model)
    counts = scratch.keep(pair_counts(found, width))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # each of these pairs has at least 1/hot of all links, so there are no more than `hot`
    common = counts.filter(F.col("n") * hot >= total).toArrow().sort_by("key")
    known, many, best = (common.column(c).to_numpy() for c in ("key", "n", "best"))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            keys, links = lists.flatten().to_numpy(), batch.column("links").flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), dtype=bool)
            sums = np.zeros((2, len(lists)), dtype=np.int64)
            np.add.at(sums[0], owner[hit], links[hit] * best[at[hit]])
            np.add.at(sums[1], owner[hit], links[hit] * many[at[hit]])
            first = pa.array(np.searchsorted(owner[~hit], np.arange(len(lists) + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(first, pa.array(c[~hit])) for c in (keys, links)]
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name not in ("keys", "links")]
            names = [name for name in batch.schema.names if name not in ("keys", "links")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums[0]), pa.array(sums[1]), *rest], names=[*names, "_best", "_sum", "keys", "links"]
            )

    kind = found.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, {FORM}, _row long, _best long, _sum long, keys array<long>, links array<long>"
    columns = ["_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_row", "keys", "links"]
    partly = scratch.keep(found.select(*columns).mapInArrow(looked_up, schema))
    scratch.drop(found)
    each = partly.select("_row", F.explode(F.arrays_zip("keys", "links")).alias("x")).select("_row", "x.keys", "x.links")
    rare = counts.filter(F.col("n") * hot < total).withColumnRenamed("key", "keys")
    sums = (
        each.join(rare, "keys").groupBy("_row")
        .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_b"), F.sum(F.col("links") * F.col("n")).alias("_s"))
    )
    whole = partly.drop("keys", "links").join(sums, "_row", "left")
    n_best = F.col("_best") + F.coalesce("_b", F.lit(0))
    count_sum = F.col("_sum") + F.coalesce("_s", F.lit(0))
    return whole.select(
        F.col("_key").alias(key), "n_a", "n_b", "n_groups", "n_links",
        n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256",
    )


def _width(piece_model: str) -> int:
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{piece_model}.model")).vocab_size()
