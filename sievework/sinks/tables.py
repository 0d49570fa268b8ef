"""CSV, JSON-lines and JSON output. Existing output is never overwritten."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Place


def require_fresh(path: str | Path | Place) -> Place:
    """A folder that is not there yet or empty; anything in it is an error."""
    folder = Place(path)
    if folder.exists() and (folder.is_file() or not folder.is_empty()):
        raise ValueError(f"Refusing to overwrite: {folder} already has content")
    return folder


def write_csv(
    df: DataFrame, path: str, fields: list[str], order: list[str] | None = None, strict: bool = True
) -> None:
    """Exactly these columns in this order. Strict writing rejects unknown columns;

    otherwise unknown ones are dropped and missing ones are left blank.
    ``order`` range-sorts the parts, so no single task writes everything.
    """
    if strict and set(df.columns) != set(fields):
        raise ValueError(f"columns {sorted(set(df.columns) ^ set(fields))} do not match the field list")
    rows = df.orderBy(*order) if order else df
    cells = [
        (F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")).alias(name)
        for name in fields
    ]
    rows.select(*cells).write.mode("errorifexists").csv(
        path, header=True, escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def canonical_json(value: Any) -> bytes:
    """Sorted keys, no spaces, UTF-8 and a final line feed: equal values give equal bytes."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return (text + "\n").encode("utf-8")


def write_document(path: str | Path | Place, value: dict[str, Any], canonical: bool = False) -> None:
    """A small JSON document, new each time."""
    body = canonical_json(value) if canonical else (
        json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    ).encode("utf-8")
    Place(path).write_bytes(body)


def markdown_table(rows: list[dict[str, Any]], columns: list[str]) -> list[str]:
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return lines + ["| " + " | ".join(str(row[c]) for c in columns) + " |" for row in rows]


def upsert_rows(table: DataFrame, rows: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """A new version of a registry: rows appended, or replaced by key.

    Appending a key that is already there is an error.
    """
    if not replace and not table.join(rows.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"{key} already registered")
    kept = table.join(rows.select(key), key, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)
