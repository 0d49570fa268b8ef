"""Fixed-width structure files: modelled residues, deposited sequence, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import residue_letter
from ..operators import constraints as c
from ..operators.intervals import label_by_interval


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines per file. Files are decoded as Latin-1; each is small, and there may be many."""
    text = F.decode("content", "ISO-8859-1")
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("n", "line")
    )


def _cut(start: int, end: int) -> Column:
    """Columns ``start..end`` of a line, counted from 0, end excluded."""
    return F.substring("line", start + 1, end - start)


def _number(start: int, end: int) -> Column:
    return F.trim(_cut(start, end)).try_cast("int")


def secondary_intervals(lines: DataFrame, chain: str) -> DataFrame:
    """Helix (H) and sheet (E) intervals whose both ends lie on the chain."""
    long_enough = F.length("line") >= 38

    def part(word: str, code: str, first: int, last: int, start: tuple[int, int]) -> DataFrame:
        return lines.filter(
            F.col("line").startswith(word) & long_enough
            & (_cut(first, first + 1) == chain) & (_cut(last, last + 1) == chain)
        ).select(
            "file", F.lit(code).alias("code"), _number(*start).alias("lo"), _number(33, 37).alias("hi")
        )

    return part("HELIX", "H", 19, 31, (21, 25)).unionByName(part("SHEET", "E", 21, 32, (22, 26)))


def modelled_residues(lines: DataFrame, chain: str) -> DataFrame:
    """Alpha carbons of a chain: first per (number, insertion code), main position only."""
    if len(chain) != 1:
        raise ValueError("PDB chain must be one character")
    atoms = lines.filter(
        F.col("line").startswith("ATOM") & (F.length("line") >= 27)
        & (F.trim(_cut(12, 16)) == "CA") & (_cut(21, 22) == chain) & _cut(16, 17).isin(" ", "A")
    ).select(
        "file", "n", _number(22, 26).alias("residue_number"),
        F.trim(_cut(26, 27)).alias("insertion_code"),
        residue_letter(_cut(17, 20)).alias("amino_acid"),
    )
    firsts = atoms.groupBy("file", "residue_number", "insertion_code").agg(
        F.min_by("amino_acid", "n").alias("amino_acid")
    )
    return label_by_interval(
        firsts, "residue_number", secondary_intervals(lines, chain), ["file"], "lo", "hi", "code",
        ["H", "E"], "C", "secondary_structure",
    )


def deposited_residues(lines: DataFrame, chain: str) -> DataFrame:
    """One row per deposited residue with its 1-based position, from the SEQRES lines."""
    fields = F.split(F.trim("line"), r"\s+")
    rows = lines.filter(F.col("line").startswith("SEQRES") & (fields[2] == chain)).select(
        "file", "n", fields[3].try_cast("int").alias("declared"),
        F.posexplode(F.slice(fields, F.lit(5), F.size(fields))).alias("i", "code"),
    )
    codes = rows.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("n", "i", residue_letter(F.col("code")).alias("residue")))).alias("r"),
        F.min("declared").alias("least"), F.max("declared").alias("most"),
    )
    right = (F.col("least") == F.col("most")) & (F.size("r") == F.col("most")) & ~F.exists(
        "r", lambda x: x["residue"] == "X"
    )
    checked = codes.withColumn(
        "r",
        F.when(right, F.col("r")).otherwise(
            F.raise_error(F.lit("PDB SEQRES is missing, inconsistent or noncanonical"))
        ),
    )
    return checked.select("file", F.posexplode("r").alias("i", "x")).select(
        "file", (F.col("i") + 1).alias("deposited_position"), F.col("x.residue").alias("residue")
    )


def numbering_violations(deposited: DataFrame, modelled: DataFrame) -> DataFrame:
    """Modelled residues must carry plain numbers that match the deposited sequence."""
    joined = modelled.join(
        deposited.select("file", F.col("deposited_position").alias("residue_number"), "residue"),
        ["file", "residue_number"], "left",
    )
    wrong = (F.col("insertion_code") != "") | F.col("residue").isNull() | (
        F.col("residue") != F.col("amino_acid")
    )
    name = F.concat_ws(":", "file", F.col("residue_number").cast("string"))
    return c.all_violations(
        [
            c.check(joined, "modelled residue", wrong, name, F.coalesce("residue", F.lit("out of range"))),
            c.unique_key(modelled, ["file", "residue_number"], "modelled residue number"),
        ]
    )
