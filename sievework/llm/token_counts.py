"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as exactly one token is proved once, with the
library itself. A text is cut into pre-tokens; those in the proved set count one
each, and only the rest is merged. Merges never cross a pre-token, so the sum is
the length of the ids that the library gives for the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import sub_batches

#: Below this code point the pattern is compared with the library one character at a time.
COMPARED = 0x3000
#: Longer texts are cut into pre-tokens in parts of about so many characters.
PART = 1 << 18
#: Numbers of tokens of merged pre-tokens that a task remembers, and the longest one it remembers.
REMEMBERED, LONGEST = 1 << 18, 64

_TOKENIZERS: dict[str, object] = {}


def public_tokenizer(vocabulary: str):
    """One tokenizer per process; special strings inside texts are tokens, as is its default."""
    if vocabulary not in _TOKENIZERS:
        import public_tokenizers
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[vocabulary] = loaded
    return _TOKENIZERS[vocabulary]


@dataclass(frozen=True)
class Proof:
    """What holds for a vocabulary; its size is bounded by that of the vocabulary.

    ``whole``: the strings that encode alone as one token. ``pattern``: the expression
    for pre-tokens. ``unlike``: characters below ``COMPARED`` that the library sorts
    into another class than the pattern does. ``special``: strings that are tokens
    wherever they stand in a text.
    """

    vocabulary: str
    whole: frozenset[str]
    pattern: str
    unlike: str
    special: tuple[str, ...]


def prove(vocabulary: str = "byte_bpe_50k") -> Proof:
    """Encode every vocabulary string alone; only byte-level vocabularies without a normaliser fit."""
    import public_tokenizers
    from tokenizers import decoders, pre_tokenizers

    tokenizer = public_tokenizer(vocabulary)
    if tokenizer.normalizer is not None or not isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
        raise ValueError(f"{vocabulary} is no byte-level vocabulary")
    decode = decoders.ByteLevel().decode
    strings = [decode([token]) for token in tokenizer.get_vocab(with_added_tokens=False)]
    whole = [s for s in strings if "�" not in s]  # parts of characters never are a whole pre-token
    alone = tokenizer.encode_batch(whole, add_special_tokens=False)
    pattern = regex.compile(public_tokenizers.PATTERN)
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    unlike = []
    for code in range(COMPARED):
        probe = "a{0}1{0}!{0} {0}{0} {0}".format(chr(code))
        if [probe[a:b] for _, (a, b) in cut(probe)] != pattern.findall(probe):
            unlike.append(chr(code))
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError(f"{vocabulary} has special strings that take their surroundings")
    special = sorted((t.content for t in added), key=lambda s: (-len(s), s))
    proved = frozenset(s for s, e in zip(whole, alone) if len(e.ids) == 1)
    return Proof(vocabulary, proved, public_tokenizers.PATTERN, "".join(unlike), tuple(special))


class Counts:
    """Counts the tokens of texts by a proof; one per task."""

    def __init__(self, proof: Proof):
        self.tokenizer = public_tokenizer(proof.vocabulary)
        self.whole = proof.whole
        self.pieces = regex.compile(proof.pattern).findall
        alike = "".join(c for c in map(chr, range(COMPARED)) if c not in proof.unlike)
        self.other = re.compile(f"[^{re.escape(alike)}]")
        self.split = regex.compile("|".join(map(regex.escape, proof.special))).split if proof.special else None
        self.special = proof.special
        self.border = regex.compile(r"\S(?=\s)")
        self.known: dict[str, int] = {}

    def _parts(self, text: str) -> Iterator[str]:
        """``text`` cut between a character and a following blank, where every pre-token ends."""
        at = 0
        while len(text) - at > PART and (found := self.border.search(text, at + PART)):
            yield text[at : found.end()]
            at = found.end()
        yield text[at:] if at else text

    def _cut(self, text: str) -> list[str]:
        if not text.isascii() and self.other.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pieces(text)

    def _merged(self, rest: list[str]) -> int:
        new = list(set(rest).difference(self.known))
        if new:  # one call for all of them; each is merged alone
            owners = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False).word_ids
            self.known.update(zip(new, np.bincount(owners, minlength=len(new)).tolist()))
        total = sum(map(self.known.__getitem__, rest))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for piece in new:
            if len(piece) > LONGEST:
                self.known.pop(piece, None)
        return total

    def __call__(self, text: str) -> tuple[int, int, int]:
        """Tokens, pre-tokens that are whole tokens, and pre-tokens that were merged."""
        runs = [text]
        if self.split and any(s in text for s in self.special):
            runs = self.split(text)
        tokens, direct, merged = len(runs) - 1, 0, 0
        for run in runs:
            for part in self._parts(run):
                pieces = self._cut(part)
                rest = list(filterfalse(self.whole.__contains__, pieces))
                direct += len(pieces) - len(rest)
                merged += len(rest)
                tokens += len(pieces) - len(rest) + (self._merged(rest) if rest else 0)
        return tokens, direct, merged


def count_tokens(docs: DataFrame, proof: Proof, text: str = "text", prefix: str = "_") -> DataFrame:
    """All columns of ``docs`` with ``n_bytes``, ``n_tokens``, ``n_whole`` and ``n_merged`` under ``prefix``.

    ``n_whole`` counts the pre-tokens that the shortcut covers, ``n_merged`` the
    others. NULL texts are empty, with zeros. Rows are independent of each other:
    nothing is shuffled, repeated rows count alike, an empty table gives no rows, and
    a long text is handled in parts. Clashing column names are the caller's to avoid
    by ``prefix``; they raise an error.
    """
    names = [f"{prefix}{n}" for n in ("n_bytes", "n_tokens", "n_whole", "n_merged")]
    if clash := {n.lower() for n in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(proof)
        for whole in batches:
            for batch in sub_batches(whole, text):
                column = batch.column(text)
                sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
                found = np.array([count(x.as_py() or "") for x in column], dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, sizes, *(pa.array(found[:, k]) for k in range(3))], names=[*batch.schema.names, *names]
                )

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    return docs.mapInArrow(counted, schema)
