"""Token counts, token alignment and the filter audit against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import alignment, filter_audit, token_counts
from sievework.llm.base import Scratch

BPE, PIECES = "byte_bpe_50k", "piece_bpe_32k"
SCHEMA = "doc_id long, text string, lang string, _row string, keys string, part string, n string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, "r", "k", "p", "n") for i, t, la in rows], SCHEMA)


def awkward_rows():
    rng = random.Random(11)
    words = ["the", "Model", "don't", "we'll", "x" * 400, "42", "3.14", "—", "naïve", "über", "#tag", "$5", "a|b", "ÀÉ", "İ"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200))), rng.choice(["en", "de", None])) for i in range(40)]
    rows += [(50, None, None), (51, "", "en"), (52, " ", "en"), (53, "   \n\n a  b\t", "de"), (54, "<|endoftext|>", "en")]
    rows += [(55, "a<|endoftext|> b <s></s>", "en"), (56, "a▁b", "en"), (57, "漢字かな 한국어 🙂👩‍👩‍👧 x", "zh"), (58, "\x00\x01\u0085 　z", "")]
    rows += [(59, "Ⅷ²½ ﬁ é é", "fr"), (60, "long " * 90_000, "en"), (61, "q" * 600_000, "en"), (62, "՘₏ x", "hy")]
    rows += [(63, rows[0][1], "en"), (63, rows[0][1], "en"), (None, rows[1][1], None), (None, rows[1][1], None), (2, rows[3][1], "de")]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    return awkward_rows()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(f"{BPE}.json"))


@pytest.fixture(scope="module")
def proof():
    return token_counts.prove(BPE)


def test_token_counts_equal_the_library(spark, awkward, library, proof):
    docs = docs_of(spark, awkward)
    got = token_counts.count_tokens(docs, proof)
    assert got.columns == [*docs.columns, "_n_bytes", "_n_tokens", "_n_whole", "_n_merged"]
    found = Counter((r.doc_id, r.text, r._n_bytes, r._n_tokens) for r in got.collect())
    texts = [t or "" for _, t, _ in awkward]
    lengths = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert found == Counter((i, t, len((t or "").encode()), n) for (i, t, _), n in zip(awkward, lengths))


def test_shortcut_and_merges_share_the_pre_tokens(library, proof):
    count = token_counts.Counts(proof)
    assert count("the model") == (2, 2, 0)
    tokens, direct, merged = count("the qzxqzxqzx")
    assert (direct, merged) == (1, 1) and tokens == len(library.encode("the qzxqzxqzx").ids)
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(proof.whole), 500))


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab' \n\t1.<|>'s"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_counts_as_in_the_library(text):
    count = _shared()
    assert count(text)[0] == len(count.tokenizer.encode(text, add_special_tokens=False).ids)


_COUNTS = []


def _shared():
    if not _COUNTS:
        _COUNTS.append(token_counts.Counts(token_counts.prove(BPE)))
    return _COUNTS[0]


def test_parts_of_long_texts_end_between_pre_tokens(monkeypatch, library, proof):
    monkeypatch.setattr(token_counts, "PART", 5)
    count = token_counts.Counts(proof)
    for text in ["a  b   c\n\n d 'll e", "word " * 40, "   ", "x" * 50 + "  y"]:
        assert count(text)[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_empty_and_clashing_tables(spark, proof):
    docs = docs_of(spark, [])
    assert token_counts.count_tokens(docs, proof).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs.withColumn("_N_TOKENS", F.lit(1)), proof)


def brute_alignment(rows):
    """Token by token, with the libraries' own pieces."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{BPE}.json"))
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{PIECES}.model"))
    letters = alignment.byte_level_alphabet()
    out, pairs = [], Counter()
    for doc_id, text, _ in rows:
        a, b = [], []
        if text:
            encoded = tokenizer.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)]
            for i in model.encode(text):
                piece = model.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        groups, links, i, j, at, bt = [], [], 0, 0, 0, 0
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if at <= bt and i < len(a):
                at += len(a[i][1])
                ga.append(a[i][0])
                left = (at - len(a[i][1]), at, a[i][0])
                i += 1
            else:
                bt += len(b[j][1])
                gb.append(b[j][0])
                right = (bt - len(b[j][1]), bt, b[j][0])
                j += 1
            if ga and gb and left[0] < right[1] and right[0] < left[1]:
                links.append((left[2], right[2]))
            if at == bt:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        pairs.update(links)
        out.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return Counter(
        (d, na, nb, ng, len(li), sum(pairs[p] == best[p[1]] for p in li), sum(pairs[p] for p in li),
         hashlib.sha256(s.encode()).hexdigest() if s else "")
        for d, na, nb, ng, li, s in out
    )


@pytest.mark.parametrize("hot", [1, 50, alignment.HOT])
def test_alignment_equals_brute_force(spark, awkward, hot):
    """With few hot pairs most links take the join, with many of them most are looked up."""
    got = alignment.align_documents(Scratch(spark), docs_of(spark, awkward), hot=hot)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == names
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment(awkward)
    lost = {r.doc_id: r.n_a for r in got.filter("doc_id in (50, 51, 56)").collect()}
    assert lost == {50: 0, 51: 0, 56: 0}


def test_small_windows_change_nothing(awkward):
    align = alignment.Aligner(BPE, PIECES)
    texts = [t for _, t, _ in awkward if not t or len(t) < 50_000]
    whole, cut = align(texts), align(texts, size=7)
    assert all(whole[name].equals(cut[name]) for name in whole)


def test_coalescing_by_hand():
    a = alignment.side([np.array([0, 1, 2])], np.array([2, 3, 1]))
    b = alignment.side([np.array([0, 0, 1])], np.array([1, 4]))
    assert alignment.coalesce(a, b).tolist() == [0, 1, 1, 0, 0, 1]
    left, right = alignment.overlaps(a, b)
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2)]


def test_alignment_of_nothing(spark):
    assert alignment.align_documents(Scratch(spark), docs_of(spark, [])).count() == 0
    only = alignment.align_documents(Scratch(spark), docs_of(spark, [(1, None, None), (1, None, None)])).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def brute_audit(rows, labels):
    def mask(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = len(words) < 100
        found |= (100 * len(set(words)) < 80 * len(words)) << 1
        found |= (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) << 2
        found |= bool(re.search("[#$%&*|]", text)) << 3
        same = [i for i, t, _ in rows if (t or "") == text and i is not None]
        return found | (doc_id is not None and min(same) < doc_id) << 4

    docs = []
    for doc_id, text, lang in rows:
        mine = [x for x in labels if x[0] == doc_id and doc_id is not None]
        docs.append((lang or "", mask(doc_id, text or ""), any(q == 1 for _, q, _ in mine), any(t == 1 for *_, t in mine)))
    out = Counter()
    for part in {d[0] for d in docs}:
        here = [d[1:] for d in docs if d[0] == part]
        rows_of, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in here if d[0] & bit and not d[0] & before]
                total[letter] += len(gone)
                rows_of.append((
                    "".join(order), step, sum(not d[0] & (before | bit) for d in here), len(gone),
                    sum(bool(d[0] & bit and d[0] & before) for d in here), sum(d[0] == bit for d in here),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), letter,
                ))
                before |= bit
        out.update((part, *r[:-1], total[r[-1]]) for r in rows_of)
    return out


def test_filter_audit_equals_brute_force(spark, awkward):
    rng = random.Random(5)
    rows = [*awkward, *((100 + k, "same words again " * 40, "en") for k in range(30)), (70, "A%", "de"), (71, "\n\x0b\x1c A b ", "de")]
    rows += [(None, "same words again " * 40, "en"), (72, "ÀÉÎ" * 50, "fr"), (73, "A" * 10 + "b" * 90, "fr"), (74, "A" * 11 + "b" * 90, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), 63, 63, 100, 101, 101, None, 999]]
    table = spark.createDataFrame([(*x, "extra") for x in labels], "doc_id long, quality int, toxic int, _key string")
    got = filter_audit.filter_interactions(Scratch(spark), docs_of(spark, rows), table)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.METRICS, "shapley"]
    assert Counter(tuple(r) for r in got.collect()) == brute_audit(rows, labels)


def test_filter_audit_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(Scratch(spark), docs_of(spark, []), labels).count() == 0
    one = filter_audit.filter_interactions(Scratch(spark), docs_of(spark, [(1, None, None)]), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.shapley for r in one} == {0, 120}
