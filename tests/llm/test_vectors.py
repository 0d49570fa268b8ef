"""Vector operators against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import ann, graph
from sievework.llm.base import Scratch


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 16))
    for k in range(60):  # a dense group and exact copies
        x[100 + k] = x[99] + 0.05 * rng.standard_normal(16)
    x[200:215] = x[199]
    rows = [(i, [float(v) for v in row], 1, "clash") for i, row in enumerate(x)]
    rows += [(600, None, 1, ""), (700, [0.0] * 16, 1, ""), (701, [1.0] * 15 + [math.nan], 1, ""), (702, [1.0] * 15 + [None], 1, ""), (800, [math.inf] * 16, 1, ""), (900, [], 1, "")]
    rows += [rows[0], (901, [1.0, 2.0], 1, ""), (1000, [1.0, 2.1], 1, "")]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, node string"
BAD = {600, 700, 701, 702, 800, 900}


def test_nearest(spark, vectors):
    rows = ann.search(Scratch(spark), spark.createDataFrame(vectors, SCHEMA), lambda i: F.pmod(i, F.lit(100)) == 0, k=10).collect()
    good = {i: np.array(v) for i, v, *_ in vectors if i not in BAD}
    got, hit, total = defaultdict(list), 0, 0
    for r in rows:
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 100 == 0}
    for q, found in got.items():
        others = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        found.sort()
        assert [f[0] for f in found] == list(range(1, min(10, len(others)) + 1))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.sqrt(((good[i] - good[q]) ** 2).sum())), rel=1e-12)
        hit += len({i for _, i, _ in found} & {i for _, i in others[:10]})
        total += len(others[:10])
    assert hit / total >= 0.9


def test_near_vectors(spark, vectors):
    found, recall = graph.near_duplicates(Scratch(spark), spark.createDataFrame(vectors, SCHEMA), 0.9)
    ids = [i for i, *_ in vectors]
    links = np.zeros((len(ids), len(ids)), dtype=bool)
    for a, (i, v, *_) in enumerate(vectors):
        for b, (j, w, *_) in enumerate(vectors):
            if a != b and i not in BAD and j not in BAD and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                links[a, b] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9 - 1e-12
    label = list(ids)
    for _ in ids:
        label = [min([label[a], *[label[b] for b in np.flatnonzero(links[a])]]) for a in range(len(ids))]
    expected = sorted((i, int(links[a].sum()), label[a]) for a, i in enumerate(ids))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == expected
    assert recall >= 0.99


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.search(Scratch(spark), none, lambda i: i == 0).count() == 0
    assert graph.near_duplicates(Scratch(spark), none)[0].count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, "")], SCHEMA)
    assert ann.search(Scratch(spark), one, lambda i: i == 0).count() == 0
    assert [tuple(r) for r in graph.near_duplicates(Scratch(spark), one)[0].collect()] == [(0, 0, 0)]


def grown_links(x, threshold=0.9):
    """Links of each row and the smallest row of its component, by brute force."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= threshold
    np.fill_diagonal(links, False)
    label = np.arange(len(x))
    while True:
        least = np.minimum(label, np.where(links, label[None, :], len(x)).min(axis=1))
        if (least == label).all():
            return links.sum(axis=1), label
        label = least


def checked_links(spark, x):
    rows = [(i, [float(v) for v in row], 1, "") for i, row in enumerate(x)]
    found, recall = graph.near_duplicates(Scratch(spark), spark.createDataFrame(rows, SCHEMA), 0.9)
    n_links, component = grown_links(x)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == [
        (i, int(n_links[i]), int(component[i])) for i in range(len(x))
    ]
    assert recall >= graph.RECALL


def test_bridged_dense_groups(spark):
    """Links between two dense groups count although each vector has more nearer ones in its own."""
    rng = np.random.default_rng(7)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    centres = [a, 0.92 * a + math.sqrt(1 - 0.92**2) * b]
    x = np.vstack([rng.standard_normal((300, 64)), *[c + 0.002 * rng.standard_normal((40, 64)) for c in centres]])
    checked_links(spark, x)


def test_separate_pairs_beside_a_dense_group(spark):
    """The links of one dense group say nothing about the pairs beside it."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((300, 64))
    y -= (y * x[:300]).sum(axis=1, keepdims=True) * x[:300]
    x[300:600] = 0.92 * x[:300] + math.sqrt(1 - 0.92**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    x[600:1000] = x[600] + 0.002 * rng.standard_normal((400, 64))
    rows = [(i, [float(v) for v in row], 1, "") for i, row in enumerate(x)]
    found, recall = graph.near_duplicates(Scratch(spark), spark.createDataFrame(rows, SCHEMA), 0.9)
    links = {r.vec_id: r.n_links for r in found.collect()}
    assert all(links[i] == 399 for i in range(600, 1000))
    assert sum(links[i] == 1 for i in range(600)) >= 0.995 * 600
    assert recall >= graph.RECALL


def test_missed_bar_fails(spark, monkeypatch):
    monkeypatch.setattr(graph, "RECALL", 2.0)
    monkeypatch.setattr(graph, "ROUNDS", 0)
    rows = [(i, [float(i == k) + 0.01 for k in range(8)], 1, "") for i in range(8)]
    with pytest.raises(RuntimeError):
        graph.near_duplicates(Scratch(spark), spark.createDataFrame(rows, SCHEMA), 0.9)
