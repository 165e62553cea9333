"""Heads of files through Spark's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

SNIFF_BYTES = 8192


def heads(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> Iterator[bytes]:
    """The bytes of a file, or of each file of a folder in the order of their names, in pieces of at most `size`; the first
    piece of a file is `size` long if the file is. What isn't asked for isn't read. Files without bytes give nothing."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    files = [fs.getFileStatus(at)]
    if files[0].isDirectory():
        files = sorted((f for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: str(f.getPath()))
        if not files:
            raise FileNotFoundError(path)
    for f in files:
        left = f.getLen()
        if left:
            stream = fs.open(f.getPath())
            try:
                while left:
                    piece = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, left)))
                    left -= len(piece)
                    yield piece
            finally:
                stream.close()


def head(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file (of a folder: of its first file that has any), without reading the rest."""
    return next(heads(spark, path, size), b"")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share; on one machine any folder is."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    return f"{root.rstrip('/')}/siftwell-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes a small file through Spark's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch(), if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
