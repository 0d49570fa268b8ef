import hashlib
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import text as t

SAMPLES = [
    "", " acde f\tg ", "ACDXB", "straße\n", "a partial b", "_not_partial_", "partialé", "PARTIAL.",
    "x\x1cy", "aaaaaab", "PART\u0131AL", "part\u0130al", "the part", "XyzX xyzA xyzab", "naïve　\u0085z",
]


def column(spark, expr, values=SAMPLES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def test_normalise_and_strip_follow_unicode_space(spark):
    assert column(spark, t.normalise_sequence) == [re.sub(r"\s+", "", v).upper() for v in SAMPLES]
    assert column(spark, t.strip_text) == [v.strip() for v in SAMPLES]


def test_digest_word_and_alphabet(spark):
    assert column(spark, t.sha256) == [hashlib.sha256(v.encode()).hexdigest() for v in SAMPLES]
    pattern = re.compile(r"\bpartial\b", re.I)
    assert column(spark, lambda c: t.has_word(c, "partial")) == [bool(pattern.search(v)) for v in SAMPLES]
    expected = ["".join(sorted(set(v) - set(t.CANONICAL_RESIDUES))) for v in SAMPLES]
    assert column(spark, t.outside_alphabet) == expected


def test_low_complexity_is_strict(spark):
    values = ["", "AAAAAAACCC", "AAAAAACCCC", "AAAAAAA", "\U0001f600\U0001f600a"]
    expected = [bool(v) and max(Counter(v).values()) / len(v) > 0.6 for v in values]
    assert column(spark, t.is_low_complexity, values) == expected


def test_types_accept_null_list_and_text(spark):
    values = [None, "", "a,b;c|d", " b | a,,a", '["z", " y ", ""]', "[]", "[not json"]
    expected = [[], [], ["a", "b", "c", "d"], ["a", "b"], ["y", "z"], [], ["[not json"]]
    assert column(spark, t.split_types, values) == expected


def test_type_tags(spark):
    values = ["abcA abcb ABCC abcde", "abc1 xabcd", "nothing"]
    assert column(spark, lambda c: t.mine_type_tags(c, "abc"), values) == [["AbcA", "AbcB", "AbcC"], ["AbcD"], []]


def test_small_formats(spark):
    values = ["", "A" * 80, "A" * 81, "ab\U0001f600" * 60]
    expected = ["\n".join(v[i:i + 80] for i in range(0, len(v), 80)) for v in values]
    assert column(spark, t.wrap_lines, values) == expected
    row = spark.range(1).select(
        t.ordinal_id("ID_", F.lit(7)).alias("a"), t.version_id("v-", F.lit("abcdef"), 3, "-s1").alias("b"),
        t.bool_text(F.lit(True), capital=True).alias("c"), t.bool_text(F.lit(None).cast("boolean")).alias("d"),
        t.residue_letter(F.lit(" gly")).alias("e"), t.residue_letter(F.lit("MSE")).alias("f"),
        t.character_at(F.lit("ABC"), F.lit(2)).alias("g"), t.is_sha256(F.lit("A" * 64)).alias("h"),
        t.length_bin(F.lit(74)).alias("i"),
    ).first()
    assert list(row) == ["ID_000007", "v-abc-s1", "True", "", "G", "X", "B", False, 2]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=20, max_size=60))
def test_random_texts(spark, values):
    assert column(spark, t.strip_text, values) == [v.strip() for v in values]
    assert column(spark, t.outside_alphabet, values) == [
        "".join(sorted(set(v) - set(t.CANONICAL_RESIDUES))) for v in values
    ]
