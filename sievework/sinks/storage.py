"""Small files and folders on any storage that Spark can reach, through Hadoop's file systems."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import SparkSession


class Place:
    """A file or folder by path or URI; plain paths belong to the cluster's default file system."""

    def __init__(self, path: str | Path | Place):
        self.path = str(path)

    def __str__(self) -> str:
        return self.path

    def __truediv__(self, name: str) -> Place:
        return Place(f"{self.path.rstrip('/')}/{name}")

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]

    @property
    def parent(self) -> Place:
        head = self.path.rstrip("/").rpartition("/")
        return Place(head[0] if head[0] else head[1] or ".")

    @property
    def _context(self):
        return SparkSession.active().sparkContext

    @property
    def _at(self):
        return self._context._jvm.org.apache.hadoop.fs.Path(self.path)

    @property
    def _files(self):
        return self._at.getFileSystem(self._context._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._files.exists(self._at)

    def is_file(self) -> bool:
        return self.exists() and self._files.getFileStatus(self._at).isFile()

    def size(self) -> int:
        return self._files.getFileStatus(self._at).getLen()

    def qualified(self) -> str:
        """The path with scheme and host, as Spark's readers name it."""
        return self._files.makeQualified(self._at).toString()

    def literal(self) -> str:
        """The path for a reader that takes patterns, meaning this file alone."""
        return re.sub(r"([\\\[\]{}*?])", r"\\\1", self.path)

    def is_empty(self) -> bool:
        """Whether a folder holds nothing."""
        return not len(self._files.listStatus(self._at))

    def make(self) -> None:
        self._files.mkdirs(self._at)

    def remove(self, whole: bool = False) -> None:
        """Delete a file or an empty folder, or all of a folder with ``whole``."""
        self._files.delete(self._at, whole)

    def rename(self, target: Place) -> None:
        if not self._files.rename(self._at, target._at):
            raise OSError(f"cannot rename {self} to {target}")

    def read_bytes(self) -> bytes:
        """The content of a small file."""
        stream = self._files.open(self._at)
        try:
            return bytes(self._context._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, data: bytes) -> None:
        """A new small file; one that is there already is an error."""
        if self.exists():
            raise FileExistsError(self.path)
        stream = self._files.create(self._at, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        self.write_bytes(text.encode("utf-8"))

    def digest(self) -> str:
        """SHA-256 of the bytes, read as a stream by the JVM, so of a file of any size."""
        stream = self._files.open(self._at)
        try:
            return self._context._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
