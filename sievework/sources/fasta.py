"""FASTA input: records split by Spark at header lines, so large files are read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CANONICAL_RESIDUES, only_alphabet, strip_text
from ..operators import constraints as c


def parse_entry(entry: Column, first_token: bool = False) -> Column:
    """Header and joined sequence of one entry, with or without its leading ``>``."""
    entry = F.regexp_replace(entry, "^>", "")
    header = strip_text(F.substring_index(entry, "\n", 1))
    body = F.when(F.locate("\n", entry) > 0, F.substring(entry, F.locate("\n", entry) + 1, F.length(entry)))
    identity = F.regexp_extract(header, r"^(\S*)", 1) if first_token else header
    return F.struct(
        identity.alias("internal_id"),
        F.regexp_replace(F.coalesce(body, F.lit("")), r"[\r\n]", "").alias("sequence"),
    )


def read_fasta(spark: SparkSession, path: str, first_token: bool = False) -> DataFrame:
    """Records (internal_id, sequence) of a FASTA file or folder. Check them with ``fasta_violations``."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    return (
        raw.filter(F.regexp_replace("value", r"\s", "") != "")
        .select(parse_entry(F.col("value"), first_token).alias("r"))
        .select("r.*")
    )


def headless_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that have text before their first header. Only a file's first piece keeps its ``>``; blank lines may precede it."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")
    )
    first = raw.groupBy("file_path").agg(F.min_by("value", F.struct("file_block_start", "at")).alias("value"))
    return c.violation(
        first.filter(~F.col("value").startswith(">") & (F.regexp_replace("value", r"\s", "") != "")), "FASTA sequence before header", F.col("file_path"), ""
    )


def fasta_violations(
    records: DataFrame, alphabet: str = CANONICAL_RESIDUES, id_pattern: str = r"^\S+$"
) -> DataFrame:
    """Bad or repeated identifiers, empty sequences and letters outside the alphabet."""
    key, sequence = F.col("internal_id"), F.col("sequence")
    return c.all_violations(
        [
            c.check_all(
                records, key,
                [
                    ("invalid FASTA ID", ~key.rlike(id_pattern)),
                    ("empty sequence", sequence == ""),
                    ("invalid FASTA sequence", ~only_alphabet(sequence, alphabet)),
                ],
            ),
            c.unique_key(records, ["internal_id"], "repeated FASTA ID"),
        ]
    )
