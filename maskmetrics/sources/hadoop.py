"""Files through Hadoop's file systems, so that any scheme works that Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .storage import shared_folder


class File(NamedTuple):
    address: str
    name: str
    size: int
    changed_ms: int


def address_of(source: str | Path) -> str:
    """An address with a scheme as it is, any other path as that of a local file with all links followed."""
    return str(source) if "://" in str(source) else Path(source).expanduser().resolve().as_uri()


class Hadoop:
    """The file system of one address."""

    def __init__(self, spark: SparkSession, address: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        # through a URI, in which blanks and other characters are escaped
        self.path = self.at(address)
        fs = self.path.getFileSystem(self.conf)
        self.fs = fs.getRaw() if fs.getScheme() == "file" else fs  # without files of checksums beside ours

    def at(self, address: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(self.jvm.java.net.URI(address)) if "%" in address else self.jvm.org.apache.hadoop.fs.Path(address)

    def kind(self) -> str:
        """``file``, ``folder`` or nothing."""
        if not self.fs.exists(self.path):
            return ""
        return "file" if self.fs.getFileStatus(self.path).isFile() else "folder"

    def files(self) -> Iterator[File]:
        """Every file below the address, or the file itself, one at a time."""
        found = self.fs.listFiles(self.path, True)
        while found.hasNext():
            status = found.next()
            path = status.getPath()
            yield File(path.toUri().toString(), path.getName(), status.getLen(), status.getModificationTime())


def copy(spark: SparkSession, source: str, target: str) -> None:
    a, b = Hadoop(spark, source), Hadoop(spark, target)
    a.jvm.org.apache.hadoop.fs.FileUtil.copy(a.fs, a.path, b.fs, b.path, False, a.conf)


def make_folder(spark: SparkSession, address: str) -> None:
    at = Hadoop(spark, address)
    at.fs.mkdirs(at.path)


def delete(spark: SparkSession, address: str) -> None:
    at = Hadoop(spark, address)
    at.fs.delete(at.path, True)


def write_joined(rows: DataFrame, target: str, head: bytes = b"", separator: str = "\n", tail: bytes = b"", between: bool = False) -> None:
    """The texts of ``rows(value)`` in their order as one file: ``head``, each text with ``separator`` after it (``between``: not after the last), ``tail``.

    Executors write ordered parts to the shared folder by Spark's own commit; the driver then copies their bytes one after the other
    to a file beside the target and renames it.  If anything fails, the target stays as it was and nothing is left behind.
    """
    spark = rows.sparkSession
    parts = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    out = Hadoop(spark, target)
    folder = out.path.getParent()
    half = out.jvm.org.apache.hadoop.fs.Path(folder, f".{out.path.getName()}-{uuid.uuid4().hex}")
    try:
        rows.select("value").write.option("lineSep", separator).text(parts)
        made = Hadoop(spark, parts)
        own = sorted((s for s in made.fs.listStatus(made.path) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
        out.fs.mkdirs(folder)
        stream = out.fs.create(half, True)
        try:
            stream.write(bytearray(head))
            for k, status in enumerate(own):
                size = status.getLen() - (len(separator.encode()) if between and k == len(own) - 1 else 0)
                part = made.fs.open(status.getPath())
                try:
                    out.jvm.org.apache.hadoop.io.IOUtils.copyBytes(out.jvm.org.apache.hadoop.util.LimitInputStream(part, size), stream, 1 << 16, False)
                finally:
                    part.close()
            stream.write(bytearray(tail))
        finally:
            stream.close()
        out.fs.delete(out.path, False)
        if not out.fs.rename(half, out.path):
            raise OSError(f"cannot write {target}")
    finally:
        out.fs.delete(half, False)
        delete(spark, parts)
