"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and all runs on one machine, as in tests, is a temporary folder used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    return f"{root.rstrip('/')}/siftwell-{uuid.uuid4().hex}"


def materialise(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write as Parquet into the shared folder and read again; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = at or work_dir(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, what is run takes batches of at most so many rows to Python, for rows that hold long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that what is made from a part is bounded too."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def tidy(*memos: dict) -> None:
    """At the end of a task in a Python worker, which goes on to other stages: empties the memos and returns what memory
    is free."""
    for memo in memos:
        memo.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def points_at_or_below(value: Column, points: list[int]) -> Column:
    """How many of the ascending `points` are at or below the value (0 for null), by binary search in a constant."""
    n = 1 << max(1, len(points).bit_length())
    held = F.from_json(F.lit(json.dumps(points)), "array<bigint>")
    steps = F.from_json(F.lit(json.dumps([n >> k for k in range(1, n.bit_length())])), "array<int>")
    # the value goes through the accumulator: filters inferred from a column captured by a lambda can lose that column
    start = F.struct(value.cast("bigint").alias("v"), F.lit(0).alias("at"))
    step_on = lambda acc, step: F.struct(acc["v"].alias("v"), F.when(F.get(held, acc["at"] + step - 1) <= acc["v"], acc["at"] + step).otherwise(acc["at"]).alias("at"))
    return F.aggregate(steps, start, step_on, lambda acc: acc["at"])


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending values that cut an integer key into at most `parts` about equal ranges.

    They come from approximate percentiles of the key column alone: sampling by repartitionByRange would run all that
    stands between the scan and the exchange twice.
    """
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    got = df.select(F.percentile_approx(F.col(key), shares, max(10_000, 20 * parts)).alias("p")).first()["p"]
    return sorted(set(got or []))


def deal_by_range(df: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """Partition k holds the rows between bound k - 1 (included) and bound k; nulls are in the first."""
    part = points_at_or_below(F.col(key), bounds) if bounds else F.lit(0)
    return df.repartitionById(len(bounds) + 1, part)
