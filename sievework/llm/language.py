"""Language by the nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import buffers, sub_batches

WIDTH = 4096
#: Documents to fit on, at most (in expectation), shared evenly by the languages.
SAMPLE = 2000
CENTROIDS = 4
REJECT_AT = 0.995  # quantile of the distances from fitted documents to their centroid
UNKNOWN = "und"

_KEEP = np.full(256, 32, dtype=np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed runs of one to three bytes of letters, a row per text.

    ``A``–``Z`` and capital letters of the Latin-1 range are lower-cased, all
    other ASCII counts as space, and runs with two spaces do not count.
    """
    raw, ends = buffers(column)
    n, low = len(ends) - 1, int(ends[0])
    given = raw[low : int(ends[-1])]
    code = _KEEP[given]
    if len(code) > 1:
        capital = (given[:-1] == 0xC3) & (code[1:] >= 0x80) & (code[1:] <= 0x9E) & (code[1:] != 0x97)
        code[1:][capital] += 32
    row = np.repeat(np.arange(n), np.diff(ends))
    out = np.zeros(n * WIDTH)
    value = code.astype(np.uint32)
    gram = np.zeros(len(code), dtype=np.uint32)
    usable = np.ones(len(code), dtype=bool)
    for size in (1, 2, 3):
        m = len(code) - size + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(257) + value[size - 1 :] + np.uint32(1)
        usable = usable[:m] & (row[:m] == row[size - 1 :])
        if size > 1:
            usable &= ~((code[size - 2 : size - 2 + m] == 32) & (code[size - 1 :] == 32))
        else:
            usable &= code != 32
        if size == 2:
            usable |= (row[:m] == row[1:]) & (code[:m] == 32) & (code[1:] != 32)
        h = (gram[usable] * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(row[:m][usable] * WIDTH + h, minlength=n * WIDTH)
    return out.reshape(n, WIDTH)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


class Centroids:
    """IDF weights, unit centroids, the language of each and its largest accepted distance."""

    def __init__(self, idf: np.ndarray, points: np.ndarray, languages: list[str], limits: np.ndarray):
        self.idf, self.points, self.languages, self.limits = idf, points, languages, limits

    @classmethod
    def fit(cls, counts: np.ndarray, languages: np.ndarray, per_language: int = CENTROIDS) -> Centroids:
        idf = np.log((1.0 + len(counts)) / (1.0 + (counts > 0).sum(axis=0))) + 1.0
        x = _unit(np.log1p(counts) * idf)
        points, names, limits = [], [], []
        for name in sorted(set(languages)):
            own = x[languages == name]
            mid = _unit(own.mean(axis=0, keepdims=True))
            seeds = [int(np.argmax(own @ mid[0]))]
            near = own @ own[seeds[0]]
            while len(seeds) < min(per_language, len(own)):
                seeds.append(int(np.argmin(near)))
                near = np.maximum(near, own @ own[seeds[-1]])
            now = own[seeds]
            for _ in range(20):
                nearest = np.argmax(own @ now.T, axis=1)
                then = _unit(np.stack([own[nearest == k].mean(axis=0) if (nearest == k).any() else now[k] for k in range(len(now))]))
                if np.allclose(then, now):
                    break
                now = then
            closest = own @ now.T
            nearest = np.argmax(closest, axis=1)
            for k in range(len(now)):
                mine = 1.0 - closest[nearest == k, k]
                points.append(now[k])
                names.append(name)
                limits.append(np.quantile(mine, REJECT_AT) if len(mine) > 1 else 1.0)
        return cls(idf, np.array(points).reshape(-1, counts.shape[1]), names, np.array(limits))

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid and the cosine to it."""
        near = _unit(np.log1p(counts) * self.idf) @ self.points.T
        best = np.argmax(near, axis=1)
        return best, np.clip(near[np.arange(len(near)), best], 0.0, 1.0)


def fit_centroids(docs: DataFrame, learn: Column, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> Centroids:
    """Fit on texts with letters where ``learn`` holds and the language is known.

    Every language gets an equal part of ``sample``, drawn by a hash of the
    text; so the driver holds at most about ``sample`` gram vectors.
    """
    usable = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    usable = usable.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    sizes = {r[0]: r[1] for r in usable.groupBy("_lang").count().collect()}
    part = max(20, sample // max(1, len(sizes)))
    drawn = F.pmod(F.xxhash64("_text", F.lit(3)), F.lit(1_000_000))
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("_lang") == name) & (drawn < int(1_000_000 * min(1.0, part / n))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole, "_text"):
                grams = gram_counts(batch.column("_text")).astype(np.float32)
                packed = pa.array([row.tobytes() for row in grams], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_lang"), packed], names=["_lang", "_grams"])

    got = usable.filter(chosen).mapInArrow(counted, "_lang string, _grams binary").toArrow()
    counts = np.frombuffer(b"".join(got.column("_grams").to_pylist()), dtype=np.float32).reshape(-1, WIDTH).astype(float)
    languages = np.array(got.column("_lang").to_pylist(), dtype=object)
    order = np.lexsort((counts[:, 1], counts[:, 0], counts.sum(axis=1), languages.astype(str))) if len(counts) else []
    return Centroids.fit(counts[order], languages[order])


def _small(whole: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """At most 64 rows and about a megabyte at a time (one row, however long, at least)."""
    for at in range(0, whole.num_rows, 64):
        yield from sub_batches(whole.slice(at, 64), column, 1 << 20)


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``_lang_pred``, ``_lang_score`` and ``_lang_rejected``.

    NULL texts, and texts without a letter, are ``und`` with score 0 and
    rejected. Others get the language of the nearest centroid; ``_lang_rejected`` tells
    whether it is farther away than nearly all fitted documents of that
    centroid. Without anything learned, all are ``und``.
    """
    lettered = docs.withColumn("_lettered", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole, text):
                n = batch.num_rows
                known = batch.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                rejected = np.ones(n, dtype=bool)
                if len(model.languages):
                    nearest, cosine = model.nearest(gram_counts(batch.column(text)))
                    best, score = np.where(known, nearest, best), np.where(known, cosine, score)
                    rejected = ~known | (1.0 - cosine > model.limits[nearest])
                columns = [*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)]
                out = [*batch.schema.names[:-1], "_lang_pred", "_lang_score", "_lang_rejected"]
                yield pa.RecordBatch.from_arrays(columns, names=out)

    found = [("_lang_pred", T.StringType()), ("_lang_score", T.DoubleType()), ("_lang_rejected", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, kind) for n, kind in found]])
    return lettered.mapInArrow(named, schema)
