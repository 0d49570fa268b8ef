"""CSV and TSV input with the checks that Spark's reader leaves out."""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_text
from ..operators import constraints as c


BAD_LINE = "_bad_line"


def _header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line. Only that line is read on the driver."""
    first = spark.read.option("wholetext", "false").text(path).limit(1).collect()
    if not first:
        return []
    return next(csv.reader([first[0]["value"].lstrip("﻿")]), [])


def _cell_count():
    """Cells of a malformed line; runs on such lines only."""

    @F.pandas_udf("int")
    def count(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: len(next(csv.reader([line]), []))).astype("int32")

    return count


def read_csv(
    spark: SparkSession,
    path: str,
    required: set[str] | None = None,
    strict: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """All columns as text, with '' for empty cells.

    Strict reading rejects repeated headers, missing columns, rows with surplus
    cells and empty files. ``multi_line`` allows line feeds inside quotes, at
    the price of one task per file.
    """
    names = _header(spark, path)
    if strict:
        if not names or len(names) != len(set(names)):
            raise ValueError(f"Missing or repeated CSV headers: {path}")
        lacking = sorted((required or set()) - set(names))
        if lacking:
            raise ValueError(f"Missing {lacking} in {path}")
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)  # every part must have this header
        .schema(", ".join(f"`{n}` string" for n in [*names, BAD_LINE]))
        .option("columnNameOfCorruptRecord", BAD_LINE)
    )
    if strict:
        # A short row is padded with blanks, so only surplus cells count as malformed.
        checked = reader.option("columnPruning", False).csv(path)
        surplus = checked.filter(F.col(BAD_LINE).isNotNull()).filter(
            _cell_count()(BAD_LINE) > len(names)
        )
        # Every column is asked for: Spark refuses to look at malformed lines alone.
        if checked.isEmpty() or surplus.limit(1).collect():
            raise ValueError(f"Empty or malformed CSV: {path}")
    return reader.csv(path).select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])


def eligible_rows(metadata: DataFrame, flag: str = "sequence_qc_eligible") -> DataFrame:
    """Rows whose flag reads true in any case, with stripped identifiers."""
    kept = metadata.filter(F.lower(strip_text(F.col(flag))) == "true")
    return kept.withColumns(
        {name: strip_text(F.col(name)) for name in ("internal_id", "sequence_id")}
    )


def eligible_violations(eligible: DataFrame) -> DataFrame:
    return c.all_violations(
        [
            c.unique_key(eligible, ["internal_id"], "eligible id"),
            c.check(eligible, "blank sequence id", F.col("sequence_id") == "", F.col("internal_id")),
        ]
    )


def read_cluster_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, member) pairs of a headerless TSV. Blank lines are skipped."""
    lines = spark.read.text(path).filter(F.regexp_replace("value", r"[\r\n]", "") != "")
    cells = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t")
    return lines.select(
        "value",
        strip_text(cells[0]).alias("cluster"),
        strip_text(F.try_element_at(cells, F.lit(2))).alias("member"),
        (F.size(cells) == 2).alias("_two"),
    )


def cluster_violations(pairs: DataFrame, expected: DataFrame, member: str = "member") -> DataFrame:
    """Malformed lines, and members that are unknown, missing or listed twice."""
    bad = ~F.col("_two") | (F.coalesce("cluster", F.lit("")) == "") | (
        F.coalesce("member", F.lit("")) == ""
    )
    good = pairs.filter(~bad)
    return c.all_violations(
        [
            c.check(pairs, "malformed cluster row", bad, F.col("value")),
            c.partition_coverage(expected.select(member), good.select(member), member),
        ]
    )
