"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

Every window of WINDOW bytes has the Shannon entropy of its byte counts. Its rarity is how seldom that entropy, in
steps, occurs among all windows of the corpus; runs of one or two bytes are never chosen. Among each POPULAR
consecutive windows the rarest (the first of several) wins; windows that win THRESHOLD times or more are the features,
by a quarter of both in short texts. They go in the order of the text into Bloom filters of FILTER_BITS bits, FEATURES to a filter, as many filters as needed.

Two digests are compared filter by filter: the common bits over those that chance would give, as a share of the most
there could be; each filter of the digest with fewer counts with its best partner, weighted by its bits.

Entropies are exact and take no loop over bytes: a step of the window takes away a byte that occurs F times in it and
brings one that then occurs B times, where F and B are counts of equal bytes ahead and behind within WINDOW, found by
one stable sort of the bytes.

Too short for a choice among windows, a text of fewer than TINY bytes has all its runs of 8 bytes as features; empty and
null texts have none and are like each other only. The
rarities are a table of a few hundred numbers counted over the corpus, which can be kept and given again.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import points_at_or_below, range_bounds, table, text_bytes
from siftwell.llm.shingles import mix

WINDOW, POPULAR, THRESHOLD = 32, 64, 16
#: In texts of fewer bytes than SHORT windows compete with a quarter of the others and need a quarter of the wins.
SHORT = 768
#: In texts of fewer bytes than TINY all runs of 8 bytes are features.
TINY = 3 * WINDOW
FILTER_BITS, FEATURES, HASHES = 2048, 128, 5
PART_BYTES = 16 << 20
#: Bytes of a text whose windows are held at once.
STRETCH = 1 << 20
_STEP = 2_000
_COUNT = np.arange(WINDOW + 1)
_F = np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0.0)
_GAIN = np.concatenate([[0], np.round(1000 * np.diff(_F))]).astype(np.int64)
BINS = int(_GAIN.sum()) // _STEP + 1
#: From this step on a window has an entropy below one bit.
_DULL = int(1000 * WINDOW * (np.log2(WINDOW) - 1)) // _STEP


def entropy_steps(b: np.ndarray) -> np.ndarray:
    """For each window of the bytes the sum of c log2 c over its byte counts, in steps; high where entropy is low."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(b, kind="stable")
    key = b[order].astype(np.int64) * (n + 2 * WINDOW) + order
    at = np.arange(n)
    behind, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    behind[order] = at - np.searchsorted(key, key - (WINDOW - 1), "left") + 1
    ahead[order] = np.searchsorted(key, key + (WINDOW - 1), "right") - at
    first = _GAIN[behind[:WINDOW]].sum()
    change = _GAIN[behind[WINDOW:]] - _GAIN[ahead[: n - WINDOW]]
    return np.concatenate([[first], first + np.cumsum(change)]) // _STEP


def _stretches(raw: bytes, over: int) -> Iterator[tuple[int, np.ndarray]]:
    b = np.frombuffer(raw, np.uint8)
    for a in range(0, max(1, len(b) - over), STRETCH):
        yield a, b[a : a + STRETCH + over]


def rarities(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each entropy step its rank, least for the rarest, from the windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for value in batch.column(text):
                for _, b in _stretches((value.as_py() or "").encode(), WINDOW - 1):
                    total += np.bincount(entropy_steps(b), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["step", "n"])

    counts = np.zeros(BINS, np.int64)
    for r in docs.select(text).mapInArrow(run, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r["step"]] = r["n"]
    return ranks(counts)


def ranks(counts: np.ndarray) -> np.ndarray:
    out = np.argsort(np.lexsort((np.arange(BINS), counts))).astype(np.int64)
    out[_DULL:] = BINS
    return out


def features(raw: bytes, rank: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows in the order of the text."""
    if len(raw) < TINY:
        return np.array([xxhash.xxh3_64_intdigest(raw[i : i + 8]) for i in range(max(1, len(raw) - 7))] if raw else [], np.uint64)
    out, best = [], None
    popular, threshold = (POPULAR, THRESHOLD) if len(raw) >= SHORT else (POPULAR // 4, THRESHOLD // 4)
    # a stretch overlaps the next so that every run of POPULAR windows lies within one; runs count where they start
    for a, b in _stretches(raw, WINDOW + POPULAR - 2):
        r = rank[entropy_steps(b)]
        key = r << 32 | np.arange(len(r))
        width = 1
        while 2 * width <= min(popular, len(r)):
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        wins = np.bincount(key & 0xFFFFFFFF, minlength=len(r))
        chosen = np.flatnonzero((wins >= threshold) & (r < BINS))
        out.append(_hash(b, chosen))
        at = int(np.argmin(r))
        if best is None or r[at] < best[0]:
            best = r[at], _hash(b, np.array([at]))
    found = np.concatenate(out)
    return found if len(found) else best[1]


def _hash(b: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    parts = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, WINDOW)[chosen]).view("<u8")
    h = np.zeros(len(chosen), np.uint64)
    for j in range(parts.shape[1]):
        h = mix(h ^ parts[:, j] ^ np.uint64(j + 1))
    return h


def digest(text: str | None, rank: np.ndarray) -> np.ndarray:
    """(filters, bytes) of packed bits."""
    h = features((text or "").encode(), rank)
    bits = np.zeros((-(-len(h) // FEATURES), FILTER_BITS), np.uint8)
    own = np.arange(len(h)) // FEATURES
    for j in range(HASHES):
        bits[own, (h >> np.uint64(11 * j) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):
        a, b = b, a
    size_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = weight = 0.0
    for f in a:
        size = int(np.bitwise_count(f).sum(dtype=np.int64))
        common = np.bitwise_count(f[None, :] & b).sum(axis=1, dtype=np.int64)
        chance, most = size * size_b / FILTER_BITS, np.minimum(size, size_b)
        total += size * float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
        weight += size
    return total / weight


def to_text(d: np.ndarray) -> str:
    return base64.b64encode(d.tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, FILTER_BITS // 8)


def fingerprints(docs: DataFrame, rank: np.ndarray, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """Adds column `to`, replacing one of that name."""
    from pyspark.sql import types as T

    kept = [f for f in docs.schema if f.name != to]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [to_text(digest(v.as_py(), rank)) for v in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.string())], [*names, to])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.StringType())]))


def with_next(docs: DataFrame, run, schema: str, key: str, text: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """run(rows) over (key, text) pairs in ascending key order, nulls first, ties by the text's hash; each part is
    followed by the first row of the next part, after the last part by the first row of all, as the last pair.

    Ranges of the key are sorted each; the rows that a part begins with are sent to the part before as well.
    """
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    bounds = range_bounds(own, "k", max(1, -(-text_bytes(own, "t") // part_bytes)))
    part = points_at_or_below(F.col("k"), bounds) if bounds else F.lit(0)
    starts = own.select(part.alias("part"), "k").groupBy("part").agg(F.min("k").alias("k"), F.count_if(F.col("k").isNull()).alias("nulls")).orderBy("part").collect()
    held: list[dict] = [{"known": False, "k": None, "before": None}] * (len(bounds) + 1)
    for j, r in enumerate(starts):
        held[r["part"]] = {"known": True, "k": None if r["nulls"] else r["k"], "before": starts[j - 1]["part"]}
    first = F.get(F.from_json(F.lit(json.dumps(held)), "array<struct<known:boolean,k:bigint,before:int>>"), part)
    here = F.struct(part.alias("to"), F.lit(False).alias("tail"))
    also = F.when(F.col("k").eqNullSafe(first["k"]), F.struct(first["before"].alias("to"), F.lit(True).alias("tail")))
    sent = own.select("k", "t", F.explode(F.filter(F.array(here, also), lambda x: x.isNotNull())).alias("at"))
    dealt = sent.select("k", "t", F.xxhash64("t").alias("h"), "at.*").repartitionById(len(bounds) + 1, F.col("to"))
    ordered = dealt.sortWithinPartitions("tail", F.col("k").asc_nulls_first(), "h", "t")

    def batches_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k, t, tail in zip(batch.column("k").to_pylist(), batch.column("t"), batch.column("tail").to_pylist(), strict=True):
                    yield k, t.as_py(), tail
                    if tail:
                        return

        yield from run(rows())

    return ordered.select("k", "t", "tail").mapInArrow(batches_in, schema)


def compare_edited(docs: DataFrame, rank: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half the next document's beginning replaces, and
    the likeness of its fingerprint to the edited text's and to the next document's."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(rows) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        last = None
        for k, value, _ in rows:
            value = value or ""
            now = (k, value, digest(value, rank))
            if last is not None:
                n = len(last[1])
                edited = last[1][: n - n // 2] + value[: n // 2]
                d = last[2] if edited == last[1] else digest(edited, rank)
                made = (last[0], n, hashlib.sha256(edited.encode()).hexdigest(), to_text(last[2]), to_text(d), likeness(last[2], d), likeness(last[2], now[2]))
                for c, v in zip(out, made, strict=True):
                    c.append(v)
                if len(out[0]) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in names]
            last = now
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, run, schema, key, text)


def op5_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compare_edited(docs, rarities(docs))
