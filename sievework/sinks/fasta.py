"""FASTA output: one header and wrapped lines per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wrap_lines


def fasta_entry(identity: Column, sequence: Column, width: int | None = 80) -> Column:
    body = wrap_lines(sequence, width) if width else sequence
    return F.concat(F.lit(">"), identity, F.lit("\n"), body)


def write_fasta(
    df: DataFrame, path: str, identity: str, sequence: str, width: int | None = 80
) -> None:
    """Write records in the order of ``identity``; refuses an existing folder.

    Parts are range-sorted, so their concatenation in name order is the file.
    """
    df.orderBy(identity).select(fasta_entry(F.col(identity), F.col(sequence), width)).write.text(path)
