"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring; a row belongs to the shard whose point precedes the hash of
its key. A shard takes at most its bound. The rows that fit at home stay there, in ring order; what a
full shard can't take continues clockwise, arc by arc, to the next shard with room. With slack 0 the
bounds are exact quotas, so that counts differ by one at most; with slack e no shard holds more than
(1 + e) times the mean, and less moves when shards are added.

How rows are counted: ring positions fall into small cells. A cell's rows are numbered by a window over
that cell alone, and cells are summed along their arc; so no window holds more than a few thousand rows
in expectation, and neither texts nor arcs come together in one task. Only the counts of the arcs (shards x
vnodes, independent of the data) reach the driver, which walks the ring.

Null keys share one ring position, as do repeated keys; such rows are told apart by checksum and size and
spread over sub-cells: SUBCELLS for a key, and for the null key as many times that as the table has cells, since
it may hold any share of the rows. Null texts have size 1. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.llm.common import points_at_or_below, table

RING_BITS = 40
CELL_ROWS = 32_768
SUBCELLS = 16
_SEGMENT = "struct<arc:int,lo:bigint,hi:bigint,shard:int,base:bigint>"


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order. A shard's points don't depend on how many shards there are."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at.setdefault(int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - RING_BITS), shard)
    return sorted(at.items())


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [max(1, -int(-(1 + slack) * rows // shards))] * shards


def walk(owners: list[int], counts: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, from, to, shard, first slot) of each arc's rows in ring order.

    owners, counts: shard and rows of each arc, clockwise.
    """
    room, filled = list(capacity), [0] * len(capacity)
    segments, left = [], []

    def take(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            segments.append((arc, lo, lo + n, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return lo + n

    for arc, (owner, n) in enumerate(zip(owners, counts, strict=True)):
        at = take(arc, 0, n, owner)
        if at < n:
            left.append((arc, at, n))
    for arc, at, n in left:
        k = arc
        while at < n:
            k = (k + 1) % len(owners)
            at = take(arc, at, n, owners[k])
    return segments


def _arc(position: Column, points: list[int]) -> Column:
    """Index of the last point at or before the position, by binary search; before the first it is the last arc."""
    below = points_at_or_below(position, points)
    return F.pmod(below - 1, F.lit(len(points))).cast("int")


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slack: float = 0.0, vnodes: int = 64) -> DataFrame:
    """Columns `key`, size, text_crc32, shard and slot (gapless from 0 in every shard), a row for each row."""
    spark = df.sparkSession
    points = ring(shards, vnodes)
    position = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - RING_BITS)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = df.select(key, (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), position.alias("position"))
    rows = rows.withColumn("arc", _arc(F.col("position"), [p for p, _ in points]))

    # the positions alone decide the arcs' counts: this pass reads only the key column
    arcs = df.select(_arc(position, [p for p, _ in points]).alias("arc")).groupBy("arc").count().collect()
    counts = [0] * len(points)
    for r in arcs:
        counts[r["arc"]] = r["count"]
    total = sum(counts)
    segments = walk([s for _, s in points], counts, bounds(total, shards, slack))
    held = F.from_json(F.lit(json.dumps([dict(zip(("arc", "lo", "hi", "shard", "base"), s, strict=True)) for s in segments])), f"array<{_SEGMENT}>")

    bits = min(RING_BITS, max(10, (total // CELL_ROWS).bit_length() + 1))
    # the arc that wraps around the ring starts at its own point: its positions below the first point come last
    rows = rows.withColumn("turn", (F.col("position") < F.lit(points[0][0])).cast("int"))
    subcells = F.when(F.col(key).isNull(), SUBCELLS * max(1, total // CELL_ROWS)).otherwise(SUBCELLS)
    rows = rows.withColumn("cell", F.struct("turn", F.shiftright("position", RING_BITS - bits).alias("at"), F.pmod("text_crc32", subcells).alias("sub")))
    numbered = rows.withColumn("within", F.row_number().over(W.partitionBy("arc", "cell").orderBy("position", F.col(key).asc_nulls_first(), "text_crc32", "size")).cast("long") - 1)
    cells = rows.groupBy("arc", "cell").count()
    cells = cells.withColumn("before", F.sum("count").over(W.partitionBy("arc").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("count"))
    # a cell meets only the segments that its ranks overlap, nearly always one
    cells = cells.withColumn("s", F.explode(F.filter(held, lambda s: (s["arc"] == F.col("arc")) & (s["lo"] < F.col("before") + F.col("count")) & (s["hi"] > F.col("before")))))
    rank = F.col("within") + F.col("before")
    placed = numbered.join(cells.drop("count"), ["arc", "cell"]).filter((rank >= F.col("s.lo")) & (rank < F.col("s.hi")))
    return placed.select(key, "size", "text_crc32", F.col("s.shard").alias("shard"), (rank - F.col("s.lo") + F.col("s.base")).alias("slot"))


def home(position: int, points: list[tuple[int, int]]) -> int:
    """The shard that owns a ring position, before bounds."""
    return points[bisect_right([p for p, _ in points], position) - 1][1]


SHARDS = 8


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
