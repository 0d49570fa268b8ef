"""N-gram Jaccard join of documents by token-combination prefixes.

The tokens of a document are its distinct word shingles. All sets are sorted in
one global order, and of two similar sets the prefixes must share some tokens:
the longer the prefix, the more. That is used twice.

1. In the order of hash values, a prefix somewhat longer than needed must share
   several tokens with another set. Sets for which it shares fewer can have no
   link and are left out.
2. The remaining sets are sorted by how many of them hold a token, rare tokens
   first. Rare tokens are indexed one by one, frequent ones as pairs: the
   frequent tokens are dealt to slots, each slot in a prefix makes it one token
   longer, and then two similar sets share a rare token or two tokens of a slot.

Candidates are verified exactly (``links.py``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, attached, attached_to_group
from .links import linked_groups, text_key
from .words import mix, shingles, sub_batches, words

RARE = 32  # a token of at most so many sets is indexed alone

#: Bits of a token that the first pass keeps. Tokens that fall together only let more sets pass on to the exact join;
#: among 10**13 tokens it is one in thirty.
KEPT = 48


def misses(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its ``n`` tokens a set may lack in a similar one, at most."""
    return n - -(-n * percent // 100)


def _surplus(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that the first, longer prefix must share; it never falls as ``n`` grows."""
    return 1 + misses(n, percent)


def distinct_tokens(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, as signed numbers, and row ends."""
    token, first = shingles(words(column), size)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    token = token.view(np.int64)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    keep = np.ones(len(token), dtype=bool)
    keep[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[keep], row[keep]
    return token, np.searchsorted(row, np.arange(len(first)))


def _prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``(…, n, d0, d1, head)``: set size, digest of the set and its longer prefix in hash order, shortened to ``KEPT`` bits."""
    given = [f.name for f in texts.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "_text"):
                token, ends = distinct_tokens(batch.column("_text"), size)
                n = np.diff(ends)
                row = np.repeat(np.arange(len(n)), n)
                digests = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    run = np.zeros(len(token) + 1, dtype=np.uint64)
                    np.cumsum(mix(token.view(np.uint64) ^ np.uint64(salt)), out=run[1:])
                    digests.append(pa.array((run[ends[1:]] - run[ends[:-1]]).view(np.int64)))
                length = np.minimum(n, misses(n, percent) + _surplus(n, percent))
                inside = np.arange(len(token)) - ends[row] < length[row]
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                short = (token[inside].view(np.uint64) >> np.uint64(64 - KEPT)).view(np.int64)
                heads = pa.ListArray.from_arrays(pa.array(offsets), pa.array(short))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in given], pa.array(n.astype(np.int32)), *digests, heads],
                    names=[*given, "n", "d0", "d1", "head"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "_text")
    return texts.mapInArrow(run, f"{kinds}, n int, d0 long, d1 long, head array<long>")


def _token_sets(texts: DataFrame, size: int) -> DataFrame:
    """``(node, n, tokens)`` of ``(node, _text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "_text"):
                token, ends = distinct_tokens(batch.column("_text"), size)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token))
                n = pa.array(np.diff(ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("node"), n, lists], names=["node", "n", "tokens"])

    return texts.select("node", "_text").mapInArrow(run, "node long, n int, tokens array<long>")


def _signatures(shared: DataFrame, percent: int, rare: int) -> DataFrame:
    """``(sig, node)`` from ``(node, n, held)``; ``held`` has ``(sets, token)`` of the tokens in several sets.

    The other ``n - size(held)`` tokens stand in one set only and so come first.
    Sets whose sizes can be similar share a size class, in which the number of
    slots is fixed; a set near the upper end of its class stands in the next too.
    """

    def one(n: int, sets: np.ndarray, token: np.ndarray) -> np.ndarray:
        order = np.lexsort((token, sets))
        sets, token = sets[order], token[order]
        spare = int(misses(np.array([n]), percent)[0])
        alone = n - len(token)
        single = np.arange(len(token)) < np.searchsorted(sets, rare, "right")
        size_class = n.bit_length() - 1
        classes = [size_class] + [size_class + 1] * (100 * n >= percent * (1 << (size_class + 1)))
        out = []
        for c in classes:
            slots = max(1, ((1 << (c + 1)) * (100 - percent) // 100) // 4)
            slot = np.where(single, -1, (mix(token.view(np.uint64)) % np.uint64(slots)).astype(np.int64))
            fresh = np.zeros(len(token), dtype=np.int64)
            _, at = np.unique(slot, return_index=True)
            fresh[at] = 1
            fresh[single] = 0
            enough = alone + np.arange(1, len(token) + 1) - spare - np.cumsum(fresh) >= 1
            if alone - spare >= 1:
                stop = 0
            else:
                stop = int(np.argmax(enough)) + 1 if enough.any() else len(token)
            if n == 1:
                out.append(token[:stop])
                continue
            out.append(token[:stop][single[:stop]])
            many, group = token[:stop][~single[:stop]], slot[:stop][~single[:stop]]
            order = np.lexsort((many, group))
            many, group = many[order].view(np.uint64), group[order]
            for gap in range(1, len(many)):
                together = group[gap:] == group[:-gap]
                if not together.any():
                    break
                pair = mix(mix(many[:-gap][together] + np.uint64(c + 1)) + many[gap:][together])
                out.append(pair.view(np.int64))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column("held")
                pairs, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                sets, token = pairs.field("sets").to_numpy(), pairs.field("token").to_numpy()
                sigs = [
                    one(n, sets[offsets[i] : offsets[i + 1]], token[offsets[i] : offsets[i + 1]])
                    for i, n in enumerate(batch.column("n").to_pylist())
                ]
                node = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sigs])
                sig = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], names=["sig", "node"])

    return shared.select("node", "n", "held").mapInArrow(run, "sig long, node long")


def similar_documents(
    scratch: Scratch, docs: DataFrame, size: int = 3, percent: int = 90, rare: int = RARE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, text_key, n_shingles, component_id, group_id)``: one row per row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of ``size``-word shingles (``A``–``Z`` lower-cased; fewer words: the whole
    sequence as one). ``component_id`` is the smallest key reachable by links, the
    own one included. Texts without words, NULL texts and so empty sets link with
    nothing. Rows that repeat a text link with each other, even with one key;
    NULL keys count as larger than all others. ``group_id`` names the group of links
    (NULL for empty sets). Shingles are compared by 64-bit hashes.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), text_key(text).alias("_tk"))
    heads = scratch.keep(_prefixes(narrow, size, percent))
    sets = scratch.keep(
        heads.filter("n > 0").groupBy("d0", "d1")
        .agg(
            F.min("_key").alias("least"), F.min(F.struct(F.col("_tk").alias("tk"), F.xxhash64("_key").alias("kh"))).alias("at"),
            F.first("n").alias("n"), F.first("head").alias("head"),
        )
        .select("d0", "d1", "least", "at.tk", "at.kh", "n", "head")
        .withColumn("node", F.monotonically_increasing_id())
    )
    rows = scratch.keep(heads.drop("head"))
    scratch.drop(heads)
    lean = scratch.keep(sets.drop("head"))

    # 1. sets whose longer prefixes share enough tokens with others
    token = sets.select("node", F.explode("head").alias("token"))
    several = token.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1").select("token")
    shares = token.join(several, "token").groupBy("node").agg(F.count("*").alias("shared"))
    smallest_partner = F.expr(f"(n * {percent}L + 99) div 100")
    needed = F.expr(f"1 + least_n - (least_n * {percent}L + 99) div 100")
    active = scratch.keep(
        sets.select("node", "n", "tk", "kh").join(shares, "node").withColumn("least_n", smallest_partner)
        .filter(F.col("shared") >= needed).select("node", "tk", "kh")
    )
    scratch.drop(sets)
    # one row per set, by text and key, so that copies of a text do not meet in one task
    placed = narrow.select("_text", F.col("_tk").alias("tk"), F.xxhash64("_key").alias("kh"))
    texts = placed.join(active, ["tk", "kh"]).dropDuplicates(["tk", "kh"]).select("node", "_text")
    full = scratch.keep(_token_sets(texts, size))

    # 2. rare tokens first; single rare tokens and pairs of frequent ones
    token = full.select("node", F.explode("tokens").alias("token"))
    several = token.groupBy("token").agg(F.count("*").cast("int").alias("sets")).filter("sets > 1")
    held = token.join(several, "token").groupBy("node").agg(F.collect_list(F.struct("sets", "token")).alias("held"))
    buckets = scratch.keep(_signatures(full.select("node", "n").join(held, "node"), percent, rare))
    groups = linked_groups(scratch, buckets, full, percent)
    scratch.drop(full, buckets, active)

    rooted = scratch.keep(lean.select("d0", "d1", "node", "least").join(groups, "node", "left"))
    smallest = rooted.filter("root is not null").groupBy("root").agg(F.min("least").alias("group_least"), F.count("*").alias("_weight"))
    grouped = attached_to_group(rooted.filter("root is not null"), smallest, "root", "node")
    alone = rooted.filter("root is null").withColumn("group_least", F.lit(None).cast(rooted.schema["least"].dataType))
    placed = grouped.unionByName(alone).select(
        "d0", "d1", F.coalesce("group_least", "least").alias("component"), F.coalesce("root", "node").alias("group_id")
    )
    linked = rows.filter("n > 0").join(placed, ["d0", "d1"])
    empty = rows.filter("n = 0").withColumns({"component": F.col("_key"), "group_id": F.lit(None).cast("long")})
    columns = [
        F.col("_key").alias(key), F.col("_tk").alias("text_key"), F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"), "group_id",
    ]
    result = scratch.keep(linked.select(*columns).union(empty.select(*columns)))
    scratch.drop(lean, rows, groups, rooted)
    return result


def one_per_group(
    scratch: Scratch, docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay when each group of linked documents keeps one.

    The smallest key stays, a NULL key only if there is no other; of equal keys the
    text with the smallest digest, and one of rows that agree in both. Texts
    without words all stay. All columns are kept.
    """
    found = similar_documents(scratch, docs, size, percent, key=key, text=text)
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("text_key").alias("tk"))
    same = found.filter("group_id is not null").groupBy("group_id", key, "text_key").agg(F.count("*").alias("_rows"))
    won = same.groupBy("group_id").agg(F.min(F.struct(rank.alias("rank"), F.col("_rows").alias("rows"))).alias("best"))
    winners = scratch.keep(won.select(F.col("best.rank.id").alias("_k"), F.col("best.rank.tk").alias("_t"), F.col("best.rows").alias("_rows")))
    scratch.drop(found)
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.withColumn("_tk", F.when(worded, text_key(text)))
    joined = named.join(winners, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_tk") == F.col("_t")), "left")
    return attached(joined.filter(~worded | F.col("_t").isNotNull()), winners, [key, "_tk"]).select(*docs.columns)
