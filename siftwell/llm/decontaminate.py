"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

An item of w words is compared with the windows of w words of every document, and with the whole of a document that has
fewer words. Features are shingles of k words (all of
an item's words where it has fewer), weighted by how rare they are among the items. A window's 128-bit SimHash is looked
up in the index of the items of its size: fingerprints are cut into BLOCKS blocks, and two within RADIUS bits differ by
at most RADIUS // BLOCKS in some block, so probing each block's values within that distance finds all of them. What the
index returns within RADIUS is verified by the exact weighted Jaccard similarity of the two shingle sets.

Weights come from all items, whatever block an item is in: shingles of two items at least are counted in one job before
the blocks are made and go with each block; a shingle of one item weighs as much as one of none.

Windows whose shingles could not reach the threshold with any item of their size, even if all that they share with
the items were one item's, get no fingerprint; that bound is exact, so nothing is lost by it.

Words are runs of other than ASCII white space, A-Z lower-cased, without punctuation at their ends. The items are a stated
query set: they are taken in blocks of at most ITEM_BYTES of text, each broadcast to one pass over the documents. Null
and empty texts and items match nothing. Repeated items are reported each; repeated rows are judged each. Of windows that
match equally well the first counts. A very long text is taken a stretch at a time. Empty tables give an empty result, and
no documents are dropped without items. contaminations() returns none of the documents' other columns, whatever they are
called; drop_contaminated() all of them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwell.llm.common import slices, table, tidy
from siftwell.llm.shingles import grams, mix, word_hashes, words

BLOCKS, RADIUS = 8, 31
ITEM_BYTES = 8 << 20
#: Shingles of a document whose bit sums are held at once.
STRETCH = 8_192
_EDGE = b".,;:!?\"'()[]{}<>*_-"
_MASKS = np.array([sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(16), r)], np.uint16)
#: A block is compared with so many values of an index at most; of a larger index its neighbours are looked up.
SCAN = len(_MASKS)
_MEMO = 150_000


class _Bare(dict):
    """Hashes of words without punctuation at their ends."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.strip(_EDGE) or word)
        return h


_BARE = _Bare()


def hashes(text: str | None) -> np.ndarray:
    own = words(text)
    return np.fromiter(map(_BARE.__getitem__, own), np.uint64, len(own))


def item_grams(h: np.ndarray, k: int) -> np.ndarray:
    """An item's shingles: of k words, or of all its words where it has fewer."""
    return grams(h, min(k, len(h))) if len(h) else np.zeros(0, np.uint64)


def _signs(g: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted +1 and -1 for the 128 bits of each shingle."""
    both = np.stack([g, mix(g ^ np.uint64(0x5851F42D4C957F2D))], axis=1).astype("<u8")
    bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    return (2 * bits - 1) * weight[:, None]


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """(m, 8) blocks of 16 bits from (m, 128) sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u2")


class Matcher:
    """The items, ready to be looked for."""

    def __init__(self, items: list[tuple[object, str | None]], k: int = 5, percent: int = 80, counted: tuple[int, np.ndarray, np.ndarray] | None = None):
        """counted: of the whole benchmark the number of items, and the shingles of two items at least, ascending, with
        their numbers of items. Without it `items` are the whole benchmark."""
        self.k, self.percent = k, percent
        self.names = [name for name, _ in items]
        held = [hashes(text) for _, text in items]
        seen: Counter = Counter()
        own = []
        for h in held:
            g = item_grams(h, k)
            own.append(g)
            seen.update(set(g.tolist()))
        total = len(items)
        if counted:
            total, shared, counts = counted
            among = dict(zip(shared.tolist(), counts.tolist(), strict=True))
            seen = Counter({g: among.pop(g, 1) for g in seen})
        else:
            among = {}
        self.rare = round(1024 * math.log(1 + total))
        weight = lambda n: round(1024 * math.log(1 + total / n))
        self.weights = {g: weight(n) for g, n in seen.items()}
        #: shingles of several items of other blocks alone
        self.others = np.array(sorted(among), np.uint64)
        self.others_weight = np.array([weight(among[x]) for x in self.others.tolist()], np.int64)
        self.sets = [frozenset(g.tolist()) for g in own]
        self.mass = [sum(self.weights[x] for x in s) for s in self.sets]
        self.known = np.array(sorted(self.weights), np.uint64)
        self.known_weight = np.array([self.weights[x] for x in self.known.tolist()], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        by: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(held):
            if len(h):
                by[len(h)].append(i)
        #: by words: (items, their fingerprints, for each block its sorted values and their order, least mass)
        self.sizes = {}
        for w, ids in sorted(by.items()):
            prints = _fingerprints(np.stack([_signs(own[i], self.weigh(own[i])).sum(axis=0) for i in ids]))
            order = [np.argsort(prints[:, b], kind="stable") for b in range(BLOCKS)]
            self.sizes[w] = (np.array(ids), prints, [(prints[o, b], o) for b, o in enumerate(order)], min(self.mass[i] for i in ids))

    def weigh(self, g: np.ndarray) -> np.ndarray:
        """Weights of shingles; those of no item weigh as much as the rarest."""
        hit = self.hits(g)
        if len(self.others):
            at = np.minimum(np.searchsorted(self.others, g), len(self.others) - 1)
            hit = np.where(self.others[at] == g, self.others_weight[at], hit)
        return np.where(hit > 0, hit, self.rare)

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Weights of the shingles that are some item's of this block, else 0."""
        out = np.zeros(len(g), np.int64)
        maybe = np.flatnonzero(self.filter[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, g[maybe]), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == g[maybe], self.known_weight[at], 0)
        return out

    def candidates(self, w: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within RADIUS among the items of w words."""
        ids, own, index, _ = self.sizes[w]
        rows, cols = [], []
        for b, (values, order) in enumerate(index):
            asked = prints[:, b]
            if len(values) <= SCAN:
                r, c = np.nonzero(np.bitwise_count(asked[:, None] ^ values[None, :]) <= RADIUS // BLOCKS)
                rows.append(r)
                cols.append(order[c])
                continue
            probe = asked[:, None] ^ _MASKS[None, :]
            lo, hi = np.searchsorted(values, probe, "left"), np.searchsorted(values, probe, "right")
            for r, c in np.argwhere(hi > lo):
                found = order[lo[r, c] : hi[r, c]]
                rows.append(np.full(len(found), r))
                cols.append(found)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(cols)]), axis=1)
        near = np.bitwise_count(prints[pairs[0]] ^ own[pairs[1]]).sum(axis=1) <= RADIUS
        return pairs[0][near], ids[pairs[1][near]]

    def find(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """For each item found its best similarity, with the window's first word and number of words."""
        h = hashes(text)
        best: dict[int, tuple[float, int, int]] = {}
        by_k: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}
        for w, (_, _, _, least) in self.sizes.items():
            kk = min(self.k, w)
            if kk not in by_k:
                g = grams(h, kk)
                hit = self.hits(g)
                by_k[kk] = g, np.concatenate([[0], np.cumsum(hit)]) if hit.any() else None
            g, sums = by_k[kk]
            if sums is None:
                continue
            size = min(w, len(h))
            span = size - kk + 1
            starts = np.flatnonzero(100 * (sums[span:] - sums[:-span]) >= self.percent * least)
            for chunk in _chunks(starts, STRETCH):
                a, b = chunk[0], chunk[-1] + span
                total = np.concatenate([np.zeros((1, 128), np.int64), np.cumsum(_signs(g[a:b], self.weigh(g[a:b])), axis=0)])
                prints = _fingerprints(total[chunk - a + span] - total[chunk - a])
                for r, i in zip(*self.candidates(w, prints), strict=True):
                    s = int(chunk[r])
                    window = np.unique(g[s : s + span])
                    both = sum(self.weights[x] for x in self.sets[i].intersection(window.tolist()))
                    union = self.mass[i] + int(self.weigh(window).sum()) - both
                    if 100 * both >= self.percent * union and (i not in best or both / union > best[i][0]):
                        best[int(i)] = (both / union, s, size)
        return best


def _chunks(starts: np.ndarray, stretch: int) -> Iterator[np.ndarray]:
    """Runs of ascending numbers, each within a stretch."""
    at = 0
    while at < len(starts):
        stop = int(np.searchsorted(starts, starts[at] + stretch))
        yield starts[at:stop]
        at = stop


def count_items(items: DataFrame, k: int, text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items, and the shingles that two of them hold at least, ascending, with their numbers of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(text):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(item_grams(hashes(value.as_py()), k)).view(np.int64))], ["g"])

    rows = items.select(text).mapInArrow(run, "g bigint").groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").toArrow()
    g, n = rows.column("g").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(g)
    return items.count(), g[order], n[order]


def matchers(items: DataFrame, k: int, percent: int, item: str, text: str, item_bytes: int = ITEM_BYTES) -> list[Matcher]:
    """The items in blocks of at most item_bytes of text (one item at least), in the order of their ids."""
    rows = items.select(F.col(item).alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator()
    counted = count_items(items, k, text)
    out: list[Matcher] = []
    held: list[tuple[object, str | None]] = []
    size = 0
    for r in rows:
        n = len(r["t"] or "")
        if held and size + n > item_bytes:
            out.append(Matcher(held, k, percent, counted))
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    return out + [Matcher(held, k, percent, counted)] if held else out


def contaminations(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (doc_id, item_id, similarity, start_word, n_words) for each document and item that it holds."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("item_id", items.schema[item].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.IntegerType())])
    spark, typed = docs.sparkSession, to_arrow_schema(schema)

    def one(matcher: Matcher) -> DataFrame:
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out: dict[str, list] = {f.name: [] for f in schema}
                for d, value in zip(batch.column(key), batch.column(text), strict=True):
                    for i, (similarity, start, n) in sorted(shared.value.find(value.as_py()).items()):
                        for c, v in zip(out, (d.as_py(), shared.value.names[i], similarity, start, n), strict=True):
                            out[c].append(v)
                if out["doc_id"]:
                    yield pa.RecordBatch.from_pydict(out, schema=typed)
            tidy(_BARE)

        return docs.select(key, text).mapInArrow(run, schema)

    found = [one(m) for m in matchers(items, k, percent, item, item_text)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no item, with the columns of `docs`."""
    out = docs
    for matcher in matchers(items, k, percent, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array([not shared.value.find(v.as_py()) for v in batch.column(text)], pa.bool_()))
            tidy(_BARE)

        out = out.mapInArrow(run, docs.schema)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
