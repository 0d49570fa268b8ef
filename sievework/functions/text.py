"""Column expressions over text and residue strings. All stay inside the JVM."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The twenty canonical residues.
CANONICAL_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Three-letter residue codes and their one-letter forms.
RESIDUE_CODES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}

# Unicode white space, plus the four separators Python also counts as space.
SPACE_CLASS = r"[\s\x1c-\x1f]"


def strip_text(col: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes only blanks)."""
    return F.regexp_replace(col, rf"(?U)^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def normalise_sequence(col: Column) -> Column:
    """Drop every Unicode white-space character and convert to upper case."""
    return F.upper(F.regexp_replace(col, rf"(?U){SPACE_CLASS}+", ""))


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def is_sha256(col: Column) -> Column:
    return F.coalesce(col.rlike("^[0-9a-f]{64}$"), F.lit(False))


def non_blank(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def has_word(col: Column, word: str) -> Column:
    """Whole-word, case-insensitive, Unicode-aware match (``_`` counts as a letter).

    The costly pattern runs only on texts that contain the longest part of the
    word to which no other sign folds; ``i``, ``k`` and ``s`` have such signs.
    """
    match = col.rlike(rf"(?iU)\b\Q{word}\E\b")
    part = max(re.split(r"[^a-hjl-rt-z]+", word.lower()), key=len)
    if len(part) > 2:
        match = F.when(F.lower(col).contains(part), match)
    return F.coalesce(match, F.lit(False))


def outside_alphabet(col: Column, alphabet: str = CANONICAL_RESIDUES) -> Column:
    """Sorted distinct characters of ``col`` that are not in ``alphabet``."""
    rest = F.regexp_replace(col, rf"[\Q{alphabet}\E]", "")
    letters = F.filter(F.split(rest, ""), lambda c: c != "")
    return F.array_join(F.array_sort(F.array_distinct(letters)), "")


def only_alphabet(col: Column, alphabet: str = CANONICAL_RESIDUES) -> Column:
    return F.coalesce(~col.rlike(rf"[^\Q{alphabet}\E]"), F.lit(False))


@F.pandas_udf(LongType())
def top_character_count(texts: pd.Series) -> pd.Series:
    """Occurrences of the most frequent character. Counting code points in numpy is
    several times faster than one string replacement per distinct character."""

    def top(text: str | None) -> int:
        if not text:
            return 0
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return int(np.unique(points, return_counts=True)[1].max())

    return texts.map(top).astype("int64")


def top_character_share(col: Column) -> Column:
    """Share of the most frequent character; NULL for an empty string."""
    return F.try_divide(top_character_count(col).cast("double"), F.length(col).cast("double"))


def is_low_complexity(col: Column, limit: float = 0.6) -> Column:
    return F.coalesce(top_character_share(col) > limit, F.lit(False))


def split_types(raw: Column) -> Column:
    """Normalise a type field that is NULL, a JSON list or delimited text."""
    listed = F.from_json(raw, "array<string>")
    items = F.when(
        F.ltrim(raw).startswith("["), F.coalesce(listed, F.split(raw, "[,;|]"))
    ).otherwise(F.split(raw, "[,;|]"))
    stripped = F.filter(F.transform(items, strip_text), lambda t: t != "")
    return F.coalesce(F.array_sort(F.array_distinct(stripped)), F.array().cast("array<string>"))


def split_type_set(raws: Column) -> Column:
    """Sorted distinct types of an array of type fields; equal fields are parsed once."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(raws), split_types))))


def mine_type_tags(text: Column, family: str, letter: str = "[a-z]") -> Column:
    """Family tags such as ``xyzA``: the family name and one letter, not followed by another."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\Q{family}\E({letter})(?!{letter})"), 1)
    name = family[:1].upper() + family[1:].lower()
    return F.array_sort(
        F.array_distinct(F.transform(found, lambda t: F.concat(F.lit(name), F.upper(t))))
    )


def join_reasons(reasons: list[tuple[Column, Column | str]], separator: str) -> Column:
    """Join the reasons whose condition holds, in the order given."""
    parts = [
        F.when(condition, F.lit(reason) if isinstance(reason, str) else reason)
        for condition, reason in reasons
    ]
    return F.array_join(F.array_compact(F.array(*parts)), separator)


def first_match(cases: list[tuple[Column, Column | str]], otherwise: Column | str) -> Column:
    """Ordered CASE: the first true condition decides."""
    expr = None
    for condition, value in cases:
        literal = F.lit(value) if isinstance(value, str) else value
        expr = F.when(condition, literal) if expr is None else expr.when(condition, literal)
    return expr.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def bool_text(col: Column, capital: bool = False) -> Column:
    """``true``/``false``, or ``True``/``False``; NULL becomes an empty cell."""
    text = col.cast("string")
    return F.coalesce(F.initcap(text) if capital else text, F.lit(""))


def ordinal_id(prefix: str, ordinal: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}%0{width}d", ordinal)


def version_id(prefix: str, digest: Column, length: int, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.left(digest, F.lit(length)), F.lit(suffix))


def wrap_lines(col: Column, width: int = 80) -> Column:
    """Break a string into lines of ``width`` characters, in time linear in its length."""
    return F.regexp_replace(col, rf"(?s)(.{{{width}}})(?=.)", "$1\n")


def length_bin(length: Column, width: int = 25) -> Column:
    return F.floor(length / F.lit(width)).cast("bigint")


def residue_letter(code: Column) -> Column:
    """One-letter residue for a three-letter code; unknown codes give ``X``."""
    table = F.create_map(*[F.lit(x) for pair in RESIDUE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(code))), F.lit("X"))


def character_at(col: Column, position: Column) -> Column:
    return F.substring(col, position, F.lit(1))


def line_ending_digests(col: Column) -> Column:
    """Digests of the text with its line ends as LF and as CRLF, for diagnosis only."""
    lf = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    return F.struct(
        sha256(lf).alias("lf"),
        sha256(F.replace(lf, F.lit("\n"), F.lit("\r\n"))).alias("crlf"),
    )
