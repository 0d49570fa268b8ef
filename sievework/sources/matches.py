"""Scan results in XML, read by Spark's own XML source, one row per protein."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements and attributes of a scan result. ``_`` marks attributes.
LOCATION = (
    "struct<_start: string, _end: string, _evalue: string, `_hmm-start`: string, "
    "`_hmm-end`: string, `_hmm-length`: string>"
)
SIGNATURE = (
    "struct<_ac: string, _name: string, entry: struct<_ac: string>, "
    "`signature-library-release`: struct<_library: string, _version: string>>"
)
MATCH = (
    "struct<_score: string, _evalue: string, signature: {signature}, "
    "locations: struct<`{kind}-location`: array<{location}>>>"
)


def protein_schema(kind: str) -> str:
    match = MATCH.format(signature=SIGNATURE, location=LOCATION, kind=kind)
    return (
        "sequence struct<_VALUE: string, _md5: string>, xref array<struct<_id: string>>, "
        f"matches struct<`{kind}-match`: array<{match}>>"
    )


def read_proteins(spark: SparkSession, path: str, kind: str = "hmmer3") -> DataFrame:
    """Proteins with their matches. An empty container and a missing one stay apart."""
    return (
        spark.read.format("xml")
        .schema(protein_schema(kind))
        .option("rowTag", "protein")
        .option("ignoreNamespace", True)
        .option("mode", "FAILFAST")
        .load(path)
    )


def _root_tag(pieces: Iterator[str]) -> str | None:
    """The start tag of the root; ``pieces`` are the text before each ``>``.

    Comments, instructions and a document type come before it and may hold ``>``
    and tags; so may the values of attributes.
    """
    kind, parts = "", []
    for piece in pieces:
        if not kind:
            start = piece.find("<")
            if start < 0:
                continue
            piece = piece[start:]
            kind = next((k for k in ("<!--", "<?", "<!") if piece.startswith(k)), "<")
            parts = []
        parts.append(piece)
        if kind == "<!--":
            done = piece.endswith("--")
        elif kind == "<?":
            done = piece.endswith("?")
        else:
            text = re.sub(r"\"[^\"]*\"|'[^']*'", "", ">".join(parts))
            done = '"' not in text and "'" not in text and (kind == "<" or text.count("[") == text.count("]"))
        if done and kind == "<":
            return ">".join(parts)
        kind = "" if done else kind
    return None


def root_attributes(spark: SparkSession, path: str) -> dict[str, str]:
    """Attributes of the root element.

    A task reads the beginning of the file in pieces that end with ``>`` and stops at the
    root's start tag, which alone comes to the driver.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = _root_tag(x for batch in batches for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([tag] if tag else [], pa.string())], names=["tag"])

    pieces = spark.read.option("lineSep", ">").text(path).filter("_metadata.file_block_start = 0").select("value")
    tags = pieces.mapInArrow(first, "tag string").collect()
    if not tags:
        return {}
    found = re.findall(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tags[0]["tag"])
    return {name: unescape(a or b, {"&quot;": '"', "&apos;": "'"}) for name, a, b in found}
