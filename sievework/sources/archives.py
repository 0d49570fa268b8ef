"""ZIP members as a Spark data source: JSON arrays become rows, one per element.

A deflated member has to be read from its start, so each archive is one input
partition. The array is cut in chunks, so a task holds one record at a time and
never the whole member. ``outer.zip::inner.zip``
style members reach into nested archives.
"""

from __future__ import annotations

import glob
import hashlib
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .arrays import CHUNK, array_elements, read_json_array


def open_member(archive: str, member: str):
    """Open a member for reading; ``::`` steps into archives within the archive."""
    handle = zipfile.ZipFile(archive)
    *outer, last = member.split("::")
    for name in outer:
        handle = zipfile.ZipFile(handle.open(name))  # Seeks instead of holding it in memory.
    if last not in handle.namelist():
        base = last.rsplit("/", 1)[-1].lower()
        similar = [n for n in handle.namelist() if n.rsplit("/", 1)[-1].lower() == base]
        hint = f"; possible members: {similar}" if similar else ""
        raise ValueError(f"Missing expected ZIP member {member}{hint}")
    return handle.open(last)


@dataclass
class ArchivePart(InputPartition):
    archive: str
    member: str


class _MemberReader(DataSourceReader):
    def __init__(self, options):
        self.member = options["member"]
        self.provenance = options.get("rows", "records") == "provenance"
        self.archives = sorted(glob.glob(options["path"]))
        if not self.archives:
            raise FileNotFoundError(options["path"])

    def partitions(self):
        return [ArchivePart(a, self.member) for a in self.archives]

    def read(self, partition):
        if self.provenance:
            yield self._provenance(partition)
            return
        with open_member(partition.archive, partition.member) as stream:
            texts = array_elements(stream, f"{partition.archive}::{partition.member}")
            for ordinal, text in enumerate(texts, 1):
                yield (partition.archive, ordinal, text)

    @staticmethod
    def _provenance(partition):
        def digest(handle):
            sha, size = hashlib.sha256(), 0
            for block in iter(lambda: handle.read(CHUNK), b""):
                sha.update(block)
                size += len(block)
            return sha.hexdigest(), size

        with open(partition.archive, "rb") as handle:
            archive_sha, _ = digest(handle)
        with open_member(partition.archive, partition.member) as handle:
            member_sha, size = digest(handle)
        return (
            partition.archive.rsplit("/", 1)[-1], archive_sha, partition.member, size, member_sha
        )


class ZipMemberSource(DataSource):
    """``format("zipmember")``: option ``member``; ``rows=provenance`` gives digests instead."""

    @classmethod
    def name(cls):
        return "zipmember"

    def schema(self):
        if self.options.get("rows", "records") == "provenance":
            return (
                "source_zip string, source_zip_sha256 string, source_member string, "
                "source_member_size bigint, source_member_sha256 string"
            )
        return "input string, ordinal bigint, record string"

    def reader(self, schema):
        return _MemberReader(self.options)


def read_zip_records(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Rows (input, ordinal, record) of a JSON array held in a ZIP member."""
    spark.dataSource.register(ZipMemberSource)
    return spark.read.format("zipmember").option("member", member).load(path)


def read_zip_provenance(spark: SparkSession, path: str, member: str) -> DataFrame:
    spark.dataSource.register(ZipMemberSource)
    return (
        spark.read.format("zipmember").option("member", member).option("rows", "provenance").load(path)
    )


def continuous_ordinals(rows: DataFrame) -> DataFrame:
    """Ordinals that run on from one ``input`` to the next, by name, and so are unique over all files.

    Starts are a running sum over one row per file. The reader has listed these
    files on the driver, so the starts are small enough to broadcast too.
    """
    files = rows.groupBy("input").agg(F.max("ordinal").alias("_last"))
    earlier = Window.orderBy("input").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("input", F.coalesce(F.sum("_last").over(earlier), F.lit(0)).alias("_start"))
    placed = rows.join(F.broadcast(starts), "input")
    return placed.withColumn("ordinal", F.col("ordinal") + F.col("_start")).drop("_start")


def source_summary(provenance: DataFrame) -> dict[str, Any]:
    """The provenance of one archive, or of several as digests over their digests and a list."""
    rows = [r.asDict() for r in provenance.orderBy(*provenance.columns).collect()]
    if len(rows) == 1:
        return rows[0]
    together = {
        name: hashlib.sha256("\n".join(r[name] for r in rows).encode()).hexdigest()
        for name in ("source_zip_sha256", "source_member_sha256")
    }
    size = sum(r["source_member_size"] for r in rows)
    return {**together, "source_member": rows[0]["source_member"], "source_member_size": size, "archives": rows}


def read_record_array(spark: SparkSession, spec: str) -> DataFrame:
    """Records of ``path`` or ``archive::member``."""
    if "::" in spec:
        archive, member = spec.split("::", 1)
        return read_zip_records(spark, archive, member)
    return read_json_array(spark, spec)
