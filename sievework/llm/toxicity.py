"""Toxicity by a classifier chain over hashed words.

Categories are predicted in turn. Each model is a logistic regression on the
presence of a document's most telling words and on the probabilities of all
earlier categories. While fitting, those probabilities are out-of-fold
predictions, so later models see them as noisy as they will be in use.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, sub_batches, words

BUCKETS = 1 << 40
#: Labelled documents to fit on, at most (in expectation; chosen by a hash of the id).
SAMPLE = 20_000
FEATURES = 512
FOLDS = 5
LEAST_SCORE = 12.0  # likelihood ratio a word must reach to become a feature
RIDGE = 0.1


def distinct_buckets(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and word bucket of each distinct pair."""
    bucket = (found.hash >> np.uint64(24)).astype(np.int64)
    both = np.unique(found.row() * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


@dataclass
class Stage:
    """One link of the chain: chosen buckets, their weights, weights of earlier categories."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, row: np.ndarray, bucket: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.buckets, bucket)
        at[at == len(self.buckets)] = 0
        hit = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), dtype=bool)
        sums = np.bincount(row[hit], self.weights[at[hit]], minlength=n) if hit.any() else np.zeros(n)
        return sums + before @ self.earlier + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(x), 0.0, 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40))))


def _chosen(row: np.ndarray, bucket: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Buckets with the largest likelihood ratio between the classes."""
    n, ones = len(target), float(target.sum())
    if not 0 < ones < n:
        return np.zeros(0, dtype=np.int64)
    seen = np.bincount(bucket).astype(float)
    ids = np.flatnonzero(seen)
    seen = seen[ids]
    hits = np.bincount(bucket, target[row])[ids]

    def gain(k, m, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(k > 0, k * np.log(k / (m * p)), 0) + np.where(m > k, (m - k) * np.log((m - k) / (m * (1 - p))), 0)
        return np.where(m > 0, part, 0)

    score = 2 * (gain(hits, seen, ones / n) + gain(ones - hits, n - seen, ones / n))
    best = np.argsort(-score, kind="stable")[:FEATURES]
    return np.sort(ids[best[score[best] >= LEAST_SCORE]])


def _fit(row: np.ndarray, bucket: np.ndarray, before: np.ndarray, target: np.ndarray) -> Stage:
    chosen = _chosen(row, bucket, target)
    n, width = len(target), len(chosen)
    x = np.zeros((n, width + before.shape[1] + 1), dtype=np.float32)
    if width:
        at = np.searchsorted(chosen, bucket)
        at[at == width] = 0
        hit = chosen[at] == bucket
        x[row[hit], at[hit]] = 1.0
    x[:, width:-1] = before
    x[:, -1] = 1.0
    beta = np.zeros(x.shape[1])
    rate = (target.sum() + 0.5) / (n + 1.0)
    beta[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(beta), RIDGE)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = sigmoid((x @ beta.astype(np.float32)).astype(float))
        slope = x.T @ (p - target).astype(np.float32) + penalty * beta
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-4:
            break
    return Stage(chosen, beta[:width], beta[width:-1], float(beta[-1]))


def _fit_known(row: np.ndarray, bucket: np.ndarray, before: np.ndarray, target: np.ndarray, use: np.ndarray) -> Stage:
    """A link fitted on the rows in ``use``; where these do not show both answers, its probability is 0."""
    if len(np.unique(target[use])) < 2:
        return Stage(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(before.shape[1]), -np.inf)
    new = np.cumsum(use) - 1
    return _fit(new[row[use[row]]], bucket[use[row]], before[use], target[use])


class Chain:
    """Fitted links in the order of their categories."""

    def __init__(self, categories: list[str], stages: list[Stage]):
        self.categories, self.stages = categories, stages

    @classmethod
    def fit(cls, categories: list[str], rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> Chain:
        """``rows``: distinct word buckets of each document; ``labels``: a column per category, -1 where unknown.

        A link learns from the rows whose own category is known; all rows get its out-of-fold
        probability, so later links miss none.
        """
        n = len(rows)
        row = np.repeat(np.arange(n), [len(r) for r in rows])
        bucket = np.concatenate(rows) if n else np.zeros(0, dtype=np.int64)
        names, bucket = np.unique(bucket, return_inverse=True)  # small numbers while fitting
        before, stages = np.zeros((n, 0)), []
        for k in range(len(categories)):
            target, known = labels[:, k].astype(float), labels[:, k] >= 0
            stages.append(_fit_known(row, bucket, before, target, known))
            out = np.zeros(n)
            for f in np.unique(fold):
                inside = fold == f
                part = _fit_known(row, bucket, before, target, known & ~inside)
                mine, own = np.cumsum(inside) - 1, inside[row]
                logits = part.logits(mine[row[own]], bucket[own], int(inside.sum()), before[inside])
                out[inside] = sigmoid(logits)
            before = np.column_stack([before, out])
        for stage in stages:
            stage.buckets = names[stage.buckets]
        return cls(categories, stages)

    def probabilities(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        before = np.zeros((n, 0))
        for stage in self.stages:
            before = np.column_stack([before, sigmoid(stage.logits(row, bucket, n, before))])
        return before


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], sample: int = SAMPLE,
    key: str = "doc_id", text: str = "text",
) -> Chain:
    """Fit on at most about ``sample`` labelled documents; ``categories`` are columns over ``labels``.

    Labels with a NULL key, or without any category, are left out; of repeated keys the largest
    label holds. A category that no label answers both ways has probability 0 everywhere: so
    with an empty ``labels`` nothing is toxic. One task fits the bounded sample; the driver
    gets the weights only.
    """
    wanted = labels.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), *[c.cast("int").alias(f"_c{i}") for i, c in enumerate(categories.values())]
    )
    flags = [f"_c{i}" for i in range(len(categories))]
    wanted = wanted.dropna("all", subset=flags).groupBy("_key").agg(*[F.max(c).alias(c) for c in flags])
    total = wanted.count()
    share = F.pmod(F.xxhash64("_key", F.lit(2)), F.lit(1_000_000))
    picked = wanted.filter(share < int(1_000_000 * min(1.0, sample / max(total, 1))))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")
    rows = rows.select(F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(FOLDS)).cast("int").alias("_fold"), *flags, "_text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "_text"):
                row, bucket = distinct_buckets(words(batch.column("_text")))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "_words"])

    schema = ", ".join(["_fold int", *[f"{c} int" for c in flags], "_words array<long>"])
    names = list(categories)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([*batches], schema=pa.schema([
            ("_fold", pa.int32()), *[(c, pa.int32()) for c in flags], ("_words", pa.list_(pa.int64()))
        ]))
        lists = [np.asarray(r, dtype=np.int64) for r in got.column("_words").to_numpy()]
        answers = np.column_stack([got.column(c).fill_null(-1).to_numpy() for c in flags]) if lists else np.zeros((0, len(flags)))
        sums = np.array([r.sum() for r in lists], dtype=np.int64)
        order = np.lexsort((sums, np.array([len(r) for r in lists], dtype=np.int64)))
        chain = Chain.fit(names, [lists[i] for i in order], answers[order], got.column("_fold").to_numpy()[order])
        parts = [(s.buckets, s.weights, s.earlier, s.bias) for s in chain.stages]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], names=["chain"])

    hashed_rows = rows.mapInArrow(hashed, schema).repartition(1)
    parts = pickle.loads(hashed_rows.mapInArrow(fit, "chain binary").first()["chain"])
    return Chain(names, [Stage(*part) for part in parts])


def score_documents(docs: DataFrame, chain: Chain, prefix: str = "p_", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and one probability per category.

    NULL texts and texts without words get probability 0. Rows keep their place,
    so repeated rows stay repeated; an empty table stays empty.
    """
    names = [prefix + c for c in chain.categories]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, text):
                found = words(batch.column(text))
                row, bucket = distinct_buckets(found)
                p = chain.probabilities(row, bucket, batch.num_rows)
                p[np.diff(found.first) == 0] = 0.0
                columns = [*batch.columns, *[pa.array(p[:, k]) for k in range(len(names))]]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    fields = [*docs.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]]
    return docs.mapInArrow(scored, T.StructType(fields))


def label_categories() -> dict[str, F.Column]:
    """The categories that ``labels`` supports, from the broadest to the narrowest."""
    low = F.col("quality") == 0
    toxic = F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "toxic_low_quality": low & toxic}
