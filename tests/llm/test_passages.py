"""Repeated passages at any word of other texts, against a brute-force version of the removal."""

import random

import pyarrow as pa

from sievework.llm import substrings
from sievework.llm.base import Scratch

VOCABULARY = [f"word{i}" for i in range(3000)]


def prose(rng, n, marks):
    return " ".join(rng.choice(VOCABULARY) + ("." if marks and rng.random() < 0.08 else "") for _ in range(n))


def brute(texts):
    """Words of each text, in order of keys, that lie in a run of 30 words that an earlier text has too."""
    seen, gone = set(), []
    for text in texts:
        words = text.lower().split()
        runs = [tuple(words[i : i + substrings.LEAST_WORDS]) for i in range(len(words) - substrings.LEAST_WORDS + 1)]
        hit = set()
        for i, run in enumerate(runs):
            if run in seen:
                hit.update(range(i, i + substrings.LEAST_WORDS))
        gone.append(len(hit))
        seen.update(runs)
    return gone


def test_a_passage_anywhere_is_found_and_extended_to_its_ends(spark):
    rng = random.Random(5)
    rows, passages = [], []
    for case in range(200):
        marks, size = case % 2, (51, 60, 80, 35)[case // 2 % 4]
        passages.append(prose(rng, size, marks))
        for _ in range(2):
            parts = [prose(rng, rng.randint(0, 120), marks), passages[-1], prose(rng, rng.randint(0, 120), marks)]
            rows.append((len(rows), " ".join(p for p in parts if p)))
    rows += [(len(rows) + i, prose(rng, 200, 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in substrings.remove_repeats(Scratch(spark), df).collect()}
    assert all(passages[i // 2] not in found[i].text for i in range(1, 400, 2))
    expected = brute([t for _, t in rows])
    assert [found[i]._removed_words for i in range(len(rows))] == expected and sum(n > 0 for n in expected) == 200


def test_copies_keys_and_short_lines(spark):
    rng = random.Random(6)
    text, other = prose(rng, 40, 1), prose(rng, 60, 0)
    rows = [(3, text), (1, text), (1, text), (2, text), (None, text), (None, text), (None, other), (None, "Start " + other),
            (4, prose(rng, 29, 0)), (5, None), (6, ""), (None, None), (None, None)]
    rows.append((7, rows[8][1]))
    same, tail = prose(rng, 35, 0).split(), prose(rng, 20, 0)
    rows += [(8, " ".join(same)), (9, " ".join([*same[:17], "changed", *same[18:]])), (10, " ".join(same[:32]) + " " + tail)]
    found = [(r.doc_id, r.text, r._removed_words) for r in
             substrings.remove_repeats(Scratch(spark), spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(found) == len(rows)
    assert sorted((d, t) for d, t, _ in found if d in (1, 2, 3)) == [(1, text), (1, text), (2, ""), (3, "")]
    late = [t for d, t, _ in found if d is None]
    assert late.count("") in (2, 3) and late.count(None) == 2 and len({*late} & {other, "Start " + other}) == 1
    by_key = {d: (t, n) for d, t, n in found}
    assert by_key[4][1] == by_key[7][1] == 0  # 29 words are too few for a removal
    assert by_key[8][1] == 0 and by_key[10] == (tail, 32)
    assert by_key[9][1] in (0, 35)  # one other word in 35: similarity 0.72 below the bar, and two runs of 17 and 17
    assert by_key[5][0] is None and by_key[6][0] == ""


def test_taken_windows():
    rng = random.Random(7)
    texts = ["a b c", prose(rng, 80, 0), "", prose(rng, 29, 0), prose(rng, 28, 0), "x " * 60, None]
    together = substrings.Units(pa.array(texts))
    for row, text in enumerate(texts):
        alone = substrings.Units(pa.array([text], pa.string()))
        mine = together.window[together.row[together.window] == row]
        assert (mine - together.words.first[row]).tolist() == alone.window.tolist()
        n = len((text or "").split())
        gaps = [b - a for a, b in zip([-1, *alone.window], [*alone.window, n - substrings.WINDOW + 1])]
        assert n < substrings.LEAST_WORDS - 1 or max(gaps) <= substrings.GAP
