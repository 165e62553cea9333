"""N-gram Jaccard join by adaptive multi-match prefixes.

Documents are sets of word shingles; two link when 100 * |A and B| >= percent * |A or B|. Equal sets are one class, so
copies cost one set. Within a class's set shingles are ordered from rare to frequent. Two sets that link share at least
l shingles of their l-prefixes, the first n - ceil(t n) + l in that order. A document whose prefix holds frequent
shingles, which many candidates would share, takes a longer prefix: l is chosen so that the estimated candidates,
the frequencies' sum over l, and the prefix itself cost least. A pair must share min(l, l') prefix shingles before its
sets are compared.

1. frequencies: shingle codes are counted over all documents (packed by code range); the HOT most frequent are shared.
2. prefixes: each class emits its prefix packed by shingle range; ranges keep the shingles that two classes share.
3. candidates: for components a class needs no comparison with one that it is already connected to. So each shingle's
   classes are first compared with one pivot, then, where they aren't all connected, with another. Of what is still
   unconnected the pairs of shingles with few classes are counted, class by class, from packed lists; shingles with more
   than SMALL classes form clusters whose prefixes, then sets, are compared a pair of blocks a task. No step makes a row
   for each pair of a group.
   all_links() does not stop at what is connected: it counts all pairs of shingles with few classes and compares all of
   the clusters of others, so that every link is found and counted.
4. verification: exact, on the sets of the classes that stand in a candidate pair.

Everything is written to the shared folder between the steps. Null and empty texts, or texts without words, have the
empty set, which links with nothing. Equal doc_ids are separate rows; a null doc_id takes part, and a component's id is
the least doc_id that isn't null in it. A very long text is one set as any other; an empty table gives an empty result;
other columns aren't returned, but for keep_one(). Shingles are 64-bit hashes; classes are told
apart by a 128-bit hash of the whole set: half of it names a class, and the few classes that share that half (a handful
in ten thousand million) are named by the other half.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import shingles
from siftwell.llm.common import materialise, slices, table, text_bytes, tidy
from siftwell.llm.components import components
from siftwell.llm.shingles import shingle_set

#: Frequent shingles whose order is known exactly: 8 MB at most in each worker.
HOT = 500_000
#: Shingles counted together in a task, and bytes of text a range of shingles stands for.
FLUSH = 1_000_000
RANGE_BYTES = 4 << 20
#: Other classes that a shingle outside the frequent ones is expected in, and comparing two sets of n shingles against
#: emitting as many; both only steer the length of prefixes.
CHANCE, COMPARE = 0.3, 0.125
#: Classes that share a prefix shingle beyond which they are compared by blocks of so many classes.
SMALL, BLOCK = 64, 1024
#: Rows of prefix shingles that are listed together.
RANGE_ROWS = 50_000
LEVELS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
#: Bits of a class's name, fewer in tests.
CLASS_BITS = 64
_POSTING = np.dtype([("token", "<u8"), ("kid", "<i8"), ("n", "<u4"), ("l", "<u4")])


def needed(n: np.ndarray | int, percent: int):
    """Least overlap with any partner: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


class ClassNames:
    """Names of sets: one half of a 128-bit hash, or the other half where several sets share the first."""

    def __init__(self, twins: frozenset[int] = frozenset(), bits: int = 64):
        self.twins, self.bits = twins, bits

    def halves(self, shingles: np.ndarray) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(shingles.tobytes())
        # as signed numbers; the first of fewer bits in tests
        first, second = h & ((1 << self.bits) - 1), h >> 64
        return first - (first >> 63 << 64), second - (second >> 63 << 64)

    def __call__(self, shingles: np.ndarray) -> int:
        first, second = self.halves(shingles)
        return second if first in self.twins else first


def class_id(shingles: np.ndarray) -> int:
    return ClassNames()(shingles)


def _zip(a: np.ndarray) -> bytes:
    """Compressed by byte planes."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def signatures(docs: DataFrame, k: int, key: str, text: str, name: ClassNames, code_bits: int, range_bits: int) -> DataFrame:
    """One pass: rows (doc_id, n, kid, other), with both halves of the set's hash, for the documents, and rows (range, m,
    codes, counts) of packed shingle counts.

    A code is the leading code_bits of a shingle, a range its leading range_bits.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n int, kid bigint, other bigint, range int, m int, codes binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(held) >> np.uint64(64 - code_bits), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            ranges = codes >> np.uint64(code_bits - range_bits)
            starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(codes) else np.zeros(0, np.int64)
            stops = np.r_[starts[1:], len(codes)] if len(codes) else starts
            rows = {"range": [], "m": [], "codes": [], "counts": []}
            for a, b in zip(starts, stops, strict=True):
                part = codes[a:b]
                rows["range"].append(int(ranges[a]))
                rows["m"].append(int(b - a))
                rows["codes"].append(_zip(np.diff(part, prepend=np.uint64(0))))
                rows["counts"].append(_zip(np.minimum(counts[a:b], 2**32 - 1).astype("<u4")))
            n = len(starts)
            return pa.RecordBatch.from_arrays([pa.nulls(n, batch_type), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(rows["range"], pa.int32()), pa.array(rows["m"], pa.int32()), pa.array(rows["codes"], pa.binary()), pa.array(rows["counts"], pa.binary())], names)

        names = ["doc_id", "n", "kid", "other", "range", "m", "codes", "counts"]
        batch_type = pa.int64()
        for batch in batches:
            batch_type = batch.column(key).type
            ns, kids, others = [], [], []
            for value in batch.column(text):
                s = shingle_set(value.as_py(), k)
                ns.append(len(s))
                first, second = name.halves(s) if len(s) else (None, None)
                kids.append(first)
                others.append(second)
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= FLUSH:
                    size = 0
                    yield flush()
            r = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ns, pa.int32()), pa.array(kids, pa.int64()), pa.array(others, pa.int64()), pa.nulls(r, pa.int32()), pa.nulls(r, pa.int32()), pa.nulls(r, pa.binary()), pa.nulls(r, pa.binary())], names)
        if held:
            yield flush()
        tidy(shingles._HASHES)

    return docs.select(key, text).mapInArrow(run, schema)


def hot_codes(counts: DataFrame, code_bits: int, range_bits: int, limit: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the most frequent shingles, ascending, and the binary order of their frequency.

    Frequencies are summed range by range. All codes of an order are taken, down to the least order (2 at least) at
    which no more than `limit` codes are taken in all.
    """

    def merge(batch: pa.Table) -> pa.Table:
        codes = np.concatenate([np.cumsum(_unzip(c, m, "<u8"), dtype=np.uint64) for c, m in zip(batch.column("codes").to_pylist(), batch.column("m").to_pylist(), strict=True)])
        counts = np.concatenate([_unzip(c, m, "<u4") for c, m in zip(batch.column("counts").to_pylist(), batch.column("m").to_pylist(), strict=True)]).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        total = np.add.reduceat(counts, first)
        codes = codes[first]
        level = np.log2(total).astype(np.int32)
        out = {"level": [], "m": [], "codes": []}
        for x in np.unique(level[level >= 2]):
            part = codes[level == x]
            out["level"].append(int(x))
            out["m"].append(len(part))
            out["codes"].append(part.astype("<u8").tobytes())
        return pa.table({"level": pa.array(out["level"], pa.int32()), "m": pa.array(out["m"], pa.int64()), "codes": pa.array(out["codes"], pa.binary())})

    merged = materialise(counts.select("range", "m", "codes", "counts").groupBy("range").applyInArrow(merge, "level int, m bigint, codes binary"))
    left, least = limit, 64
    for r in sorted(merged.groupBy("level").agg(F.sum("m").alias("m")).collect(), key=lambda r: -r["level"]):
        if r["m"] > left:
            break
        left -= r["m"]
        least = r["level"]
    rows = merged.filter(F.col("level") >= least).select("level", "codes").collect()
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    codes = np.concatenate([np.frombuffer(r["codes"], "<u8") for r in rows])
    levels = np.concatenate([np.full(len(r["codes"]) // 8, r["level"], np.uint8) for r in rows])
    order = np.argsort(codes)
    return codes[order], levels[order]


def prefix(s: np.ndarray, percent: int, hot: np.ndarray, levels: np.ndarray, code_bits: int) -> tuple[np.ndarray, int]:
    """The l-prefix of a set and l."""
    n = len(s)
    base = n - int(needed(n, percent))
    weight = np.zeros(n, np.int64)
    if len(hot):
        codes = s >> np.uint64(64 - code_bits)
        at = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
        weight = np.where(hot[at] == codes, levels[at], 0).astype(np.int64)
    order = np.lexsort((s, weight)) if weight.any() else np.arange(n)
    cost = np.cumsum(np.where(weight[order] > 0, np.exp2(weight[order]), CHANCE)) * (COMPARE * n)
    best, chosen = None, 1
    for level in LEVELS:
        if level > max(1, n // 10) or base + level > n:
            break
        guess = cost[base + level - 1] / level + (base + level)
        if best is None or guess < best:
            best, chosen = guess, level
    return s[order[: base + chosen]], chosen


def postings(docs: DataFrame, k: int, text: str, name: ClassNames, cut: Callable[[np.ndarray], tuple[np.ndarray, int]], range_bits: int) -> DataFrame:
    """Shingles that stand in the prefixes of two classes at least: (token, kid, n, l), a row for each such class, and
    the token's pivot (its least class) with its n and l."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        met: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.zeros(0, _POSTING)
            held.clear()
            # shingles are dealt by other bits than their order, so that hot and rare ones mix
            ranges = (rows["token"] & np.uint64((1 << range_bits) - 1)).astype(np.int64)
            order = np.argsort(ranges, kind="stable")
            rows, ranges = rows[order], ranges[order]
            starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(rows) else np.zeros(0, np.int64)
            stops = np.r_[starts[1:], len(rows)] if len(rows) else starts
            packed = [_zip(rows[a:b]) for a, b in zip(starts, stops, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ranges[starts], pa.int32()), pa.array(stops - starts, pa.int32()), pa.array(packed, pa.binary())], ["range", "m", "rows"])

        for batch in batches:
            for value in batch.column(text):
                s = shingle_set(value.as_py(), k)
                if not len(s) or (kid := name(s)) in met:
                    continue
                if len(met) >= 200_000:
                    met.clear()
                met.add(kid)
                tokens, level = cut(s)
                rows = np.zeros(len(tokens), _POSTING)
                rows["token"], rows["kid"], rows["n"], rows["l"] = tokens, kid, len(s), level
                held.append(rows)
                size += len(tokens)
                if size >= FLUSH // 4:
                    size = 0
                    yield flush()
        if held:
            yield flush()
        tidy(shingles._HASHES)

    def meet(group: pa.Table) -> pa.Table:
        rows = np.concatenate([_unzip(r, m, _POSTING) for r, m in zip(group.column("rows").to_pylist(), group.column("m").to_pylist(), strict=True)])
        rows = rows[np.lexsort((rows["kid"], rows["token"]))]
        same = np.r_[False, (rows["token"][1:] == rows["token"][:-1]) & (rows["kid"][1:] == rows["kid"][:-1])]
        rows = rows[~same]
        first = np.flatnonzero(np.r_[True, rows["token"][1:] != rows["token"][:-1]])
        count = np.diff(np.r_[first, len(rows)])
        keep = np.repeat(count >= 2, count)
        pivot = np.repeat(first, count)[keep]
        own = rows[keep]
        return pa.table({"token": own["token"].astype(np.int64), "kid": own["kid"], "n": own["n"].astype(np.int32), "l": own["l"].astype(np.int32), "pivot": rows["kid"][pivot], "pn": rows["n"][pivot].astype(np.int32), "pl": rows["l"][pivot].astype(np.int32)})

    packed = docs.select(text).mapInArrow(emit, "range int, m int, rows binary")
    return packed.groupBy("range").applyInArrow(meet, "token bigint, kid bigint, n int, l int, pivot bigint, pn int, pl int")


def sets(docs: DataFrame, wanted: DataFrame, sig: DataFrame, k: int, key: str, text: str, name: ClassNames) -> DataFrame:
    """(kid, shingles) of the wanted classes, each from one of its documents."""
    reps = sig.join(wanted, "kid", "left_semi").groupBy("kid").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    reps = materialise(reps.distinct())
    few = reps.count() <= 1_000_000  # 8 MB of ids; beyond that both sides are shuffled
    own = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    chosen = own.join(F.broadcast(reps) if few else reps, F.col("__id").eqNullSafe(F.col("doc_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            got = [s for value in batch.column("__text") if len(s := shingle_set(value.as_py(), k))]
            yield pa.RecordBatch.from_arrays([pa.array(map(name, got), pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["kid", "shingles"])
        tidy(shingles._HASHES)

    return chosen.select("__text").mapInArrow(run, "kid bigint, shingles binary").dropDuplicates(["kid"])


def verify(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    x = held.select(F.col("kid").alias("a"), F.col("shingles").alias("x"))
    y = held.select(F.col("kid").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int(np.count_nonzero(t[at] == s))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(run, "a bigint, b bigint")


def _counted(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with sizes and levels from rows (kid, n, l, pivot, pn, pl) that share a token each."""
    fit = pairs.filter(100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
    return fit.groupBy(F.col("pivot").alias("a"), F.col("kid").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("l", "pl")).alias("l")).filter("c >= l").select("a", "b")


def _rest(open_rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different roots that share enough prefix tokens; rows (token, kid, n, l, root).

    For each token a class gets the packed list of the classes of other components and greater ids; a class's lists
    are then counted together.
    """

    def lists(group: pa.Table) -> pa.Table:
        c = {x: group.column(x).to_numpy() for x in ("kid", "n", "l", "root", "token")}
        out = {"a": [], "others": []}
        order = np.argsort(c["token"], kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(c["token"][order]) != 0])
        for part in np.split(order, cuts[1:]):
            kid, n, level, root = (c[x][part] for x in ("kid", "n", "l", "root"))
            for i in range(len(kid)):
                # the class of the lesser id lists the pair, for whatever token: so its shared tokens meet
                other = (root != root[i]) & (kid > kid[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                if other.any():
                    packed = np.stack([kid[other], np.minimum(level[other], level[i]).astype(np.int64)])
                    out["a"].append(int(kid[i]))
                    out["others"].append(packed.astype("<i8").tobytes())
        return pa.table({"a": pa.array(out["a"], pa.int64()), "others": pa.array(out["others"], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, "<i8").reshape(2, -1) for x in group.column("others").to_pylist()]
        kid, least = np.concatenate(held, axis=1)
        order = np.lexsort((least, kid))
        kid, least = kid[order], least[order]
        first = np.flatnonzero(np.r_[True, kid[1:] != kid[:-1]])
        good = first[np.diff(np.r_[first, len(kid)]) >= least[first]]
        return pa.table({"a": pa.array([group.column("a")[0].as_py()] * len(good), pa.int64()), "b": pa.array(kid[good], pa.int64())})

    ranges = max(64, open_rows.count() // RANGE_ROWS)
    listed = open_rows.withColumn("range", F.pmod(F.xxhash64("token"), F.lit(ranges))).groupBy("range").applyInArrow(lists, "a bigint, others binary")
    return listed.groupBy("a").applyInArrow(count, "a bigint, b bigint")


def _start(docs: DataFrame, k: int, percent: int, key: str, text: str, hot: int) -> tuple[DataFrame, DataFrame, Callable[[np.ndarray], tuple[np.ndarray, int]], ClassNames]:
    """(doc_id, n, kid) of every document and the shared prefix shingles of postings(), written; what gives a set's
    prefix and l on an executor; and what names a set's class."""
    size = text_bytes(docs, text)
    range_bits = min(20, max(4, (size // RANGE_BYTES).bit_length()))
    code_bits = min(56, max(30, (size // 6 + 1).bit_length() + 6))
    name = ClassNames(bits=CLASS_BITS)
    first = materialise(signatures(docs, k, key, text, name, code_bits, range_bits))
    sig = first.filter("range is null").select("doc_id", "n", "kid", "other")
    halves = sig.filter("n > 0").groupBy("kid").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    # of N classes N * N / 2**65 are expected: none below a thousand million
    twins = frozenset(r["kid"] for r in halves.filter("least <> most").select("kid").collect())
    if twins:
        name = ClassNames(twins, CLASS_BITS)
        sig = sig.withColumn("kid", F.when(F.col("kid").isin(*twins), F.col("other")).otherwise(F.col("kid")))
    sig = sig.drop("other")
    frequent = hot_codes(first.filter("range is not null"), code_bits, range_bits, hot)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    cut = lambda s: prefix(s, percent, *shared.value, code_bits)
    return sig, materialise(postings(docs, k, text, name, cut, range_bits)), cut, name


def link_classes(docs: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, kid) of every document and (node, root) of every class that links with another."""
    sig, alive, cut, name = _start(docs, k, percent, key, text, hot)

    def checked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs, written, and those that link."""
        pairs = materialise(pairs)
        held = materialise(sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("kid")).distinct(), sig, k, key, text, name))
        return pairs, materialise(verify(pairs, held, percent))

    tested, links = checked(_counted(alive.filter("kid <> pivot"), percent))
    # a class linked to the pivot takes it as its label
    label = links.groupBy(F.col("b").alias("kid")).agg(F.min("a").alias("root"))
    rows = alive.select("token", "kid", "n", "l").join(label, "kid", "left").withColumn("root", F.coalesce("root", "kid"))
    rows = materialise(_open(rows))
    if rows.limit(1).count():
        # another pivot, the same for most shingles of a group
        last = F.xxhash64("kid")
        drawn = rows.groupBy("token").agg(F.min_by(F.struct(F.col("kid").alias("pivot"), F.col("n").alias("pn"), F.col("l").alias("pl"), F.col("root").alias("proot")), last).alias("p"))
        tried = rows.join(drawn, "token").select("kid", "n", "l", "root", "p.*").filter("root <> proot")
        more, found = checked(_ordered(_counted(tried, percent)).join(_ordered(tested), ["a", "b"], "left_anti"))
        tested, links = tested.select("a", "b").union(more), links.union(found)
        joined = components(links).withColumnRenamed("node", "kid")
        rows = materialise(_open(rows.drop("root").join(joined, "kid", "left").withColumn("root", F.coalesce("root", "kid"))))
        if rows.limit(1).count():
            sizes = materialise(rows.groupBy("token").agg(F.count("*").alias("m"), F.min("kid").alias("cluster")))
            few = rows.join(sizes.filter(F.col("m") <= SMALL).select("token"), "token", "left_semi")
            _, found = checked(_ordered(_rest(few, percent)).join(_ordered(tested), ["a", "b"], "left_anti"))
            links = links.union(found)
            many = rows.select("token", "kid").join(sizes.filter(F.col("m") > SMALL), "token")
            many = materialise(many.groupBy("kid").agg(F.sort_array(F.collect_set("cluster")).alias("clusters"), F.lit(1).cast("long").alias("w")))
            if many.limit(1).count():
                held = sets(docs, many.select("kid"), sig, k, key, text, name)
                found = materialise(_blocks(many, held, percent, cut, False))
                links = links.union(found.select(F.col("kid").alias("a"), F.explode("tree").alias("b")))
    return sig, components(links)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def all_links(docs: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text", hot: int = HOT, listed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, kid) of every document, and rows (kid, n_links, others, tree) of all links between classes.

    Every candidate pair is verified, whatever is connected already. A class has several rows: n_links, the documents
    of the classes it links with, is to be summed; others holds, where listed, each link in one of its two classes;
    tree holds links that connect the same classes as all do.
    """
    sig, alive, cut, name = _start(docs, k, percent, key, text, hot)
    copies = materialise(sig.filter("n > 0").groupBy("kid").agg(F.count("*").alias("w")))
    rows = alive.select("token", "kid", "n", "l", F.col("kid").alias("root"))
    sizes = materialise(rows.groupBy("token").agg(F.count("*").alias("m"), F.min("kid").alias("cluster")))
    many = rows.select("token", "kid").join(sizes.filter(F.col("m") > SMALL), "token")
    many = materialise(many.groupBy("kid").agg(F.sort_array(F.collect_set("cluster")).alias("clusters")))
    pairs = materialise(_rest(rows.join(sizes.filter(F.col("m") <= SMALL).select("token"), "token", "left_semi"), percent))
    held = materialise(sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("kid")).distinct(), sig, k, key, text, name))
    # pairs of one cluster are found there
    x, y = (many.select(F.col("kid").alias(c), F.col("clusters").alias(f"of_{c}")) for c in "ab")
    apart = verify(pairs, held, percent).join(x, "a", "left").join(y, "b", "left").filter(~F.coalesce(F.arrays_overlap("of_a", "of_b"), F.lit(False)))
    apart = materialise(apart.select("a", "b"))
    none = F.expr("cast(array() as array<bigint>)")
    there = apart.join(copies.withColumnRenamed("kid", "b"), "b").select(F.col("a").alias("kid"), F.col("w").alias("n_links"), F.array("b").alias("others"), F.array("b").alias("tree"))
    back = apart.join(copies.withColumnRenamed("kid", "a"), "a").select(F.col("b").alias("kid"), F.col("w").alias("n_links"), none.alias("others"), none.alias("tree"))
    found = there.union(back)
    if many.limit(1).count():
        held = sets(docs, many.select("kid"), sig, k, key, text, name)
        found = found.union(materialise(_blocks(many.join(copies, "kid"), held, percent, cut, listed)))
    return sig, found


def _blocks(many: DataFrame, held: DataFrame, percent: int, cut: Callable[[np.ndarray], tuple[np.ndarray, int]], listed: bool) -> DataFrame:
    """All links within clusters of classes that share a frequent prefix shingle, as in all_links(); many: (kid, clusters,
    w), clusters sorted.

    A cluster is cut into blocks of about BLOCK classes, and each pair of blocks is a task of its own: no task grows with
    the cluster, and no row is made for a pair. Within a task, too, a pair must share min(l, l') prefix shingles before
    its sets are compared. A pair that stands in several clusters counts in the least of them.
    """
    members = many.select("kid", "clusters", "w", F.explode("clusters").alias("cluster"))
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(sizes, "cluster").withColumn("i", F.pmod(F.xxhash64("kid"), F.col("blocks")).cast("int"))
    sent = own.select("cluster", "kid", "clusters", "w", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    sent = sent.select("cluster", "kid", "clusters", "w", "i", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"))

    def compare(group: pa.Table) -> pa.Table:
        kids, weight, side = (group.column(c).to_numpy() for c in ("kid", "w", "i"))
        held = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("shingles")]
        p, q, cluster = (group.column(c)[0].as_py() for c in ("p", "q", "cluster"))
        of = group.column("clusters").to_pylist()
        place = {c: i for i, c in enumerate(sorted(set().union(*of)))}
        within = np.zeros((len(kids), len(place)), bool)
        for x, cs in enumerate(of):
            within[x, [place[c] for c in cs]] = True
        left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)
        size = np.array([len(held[x]) for x in right], np.int64)
        prefixes, levels = zip(*(cut(s) for s in held), strict=True)
        level = np.array([levels[x] for x in right], np.int64)
        whole, begun = _Index([held[x] for x in right]), _Index([prefixes[x] for x in right])
        root = list(range(len(kids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        total = np.zeros(len(kids), np.int64)
        others: list[list[int]] = [[] for _ in kids]
        tree: list[list[int]] = [[] for _ in kids]
        for x in left if len(right) else ():
            near = begun.shared(prefixes[x]) >= np.minimum(level, levels[x])
            near &= (within[x] & within[right]).argmax(axis=1) == place[cluster]
            if p == q:
                near &= right > x
            if not near.any():
                continue
            both = whole.shared(held[x])
            met = right[near & (100 * both >= percent * (len(held[x]) + size - both))]
            total[x] += weight[met].sum()
            total[met] += weight[x]
            if listed:
                others[x] = kids[met].tolist()
            for y in met.tolist():
                if find(int(x)) != find(y):
                    root[find(int(x))] = find(y)
                    tree[x].append(int(kids[y]))
        some = np.flatnonzero(total).tolist()
        lists = pa.list_(pa.int64())
        return pa.table({"kid": pa.array(kids[some], pa.int64()), "n_links": pa.array(total[some], pa.int64()), "others": pa.array([others[x] for x in some], lists), "tree": pa.array([tree[x] for x in some], lists)})

    return sent.join(held, "kid").groupBy("cluster", "p", "q").applyInArrow(compare, "kid bigint, n_links bigint, others array<bigint>, tree array<bigint>")


class _Index:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(self.n), [len(s) for s in sets])[order]

    def shared(self, s: np.ndarray) -> np.ndarray:
        """For each set the number of shingles that s shares with it."""
        lo, hi = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        count = hi - lo
        places = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
        return np.bincount(self.owner[places], minlength=self.n)


def class_links(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, kid) of every document, and all links (a, b) between different classes, each once."""
    sig, found = all_links(docs, k, percent, key, text, hot, listed=True)
    return sig, found.select("kid", F.explode("others").alias("b")).select(F.least("kid", "b").alias("a"), F.greatest("kid", "b").alias("b"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the tokens whose classes aren't all under one root."""
    several = rows.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("token")
    return rows.join(several, "token", "left_semi")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per document doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    sig, linked = link_classes(docs, k, percent, key, text, hot)
    out = sig.join(_named(sig, linked), "kid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_documents(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """As near_duplicates(), from all links, with n_links: the other documents that the document links with, copies too."""
    sig, found = all_links(docs, k, percent, key, text, hot)
    named = _named(sig, components(found.select(F.col("kid").alias("a"), F.explode("tree").alias("b"))))
    counted = found.groupBy("kid").agg(F.sum("n_links").alias("to"))
    copies = sig.filter("n > 0").groupBy("kid").agg(F.count("*").alias("w"))
    links = copies.join(counted, "kid", "left").select("kid", (F.col("w") - 1 + F.coalesce("to", F.lit(0))).alias("n_links"))
    out = sig.join(named.join(links, "kid"), "kid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _named(sig: DataFrame, linked: DataFrame) -> DataFrame:
    """(kid, component_id) of every class."""
    classes = sig.filter("n > 0").groupBy("kid").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(linked.withColumnRenamed("node", "kid"), "kid", "left").withColumn("root", F.coalesce("root", "kid"))
    rooted = materialise(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialise(rooted.select("kid", "root").join(least, "root").select("kid", "component_id"))


def op7_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"), k=4, percent=85)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates; all columns of `docs` stay.

    Rows are told apart by doc_id and text: of a group the row of the least doc_id stays, of equal doc_ids that of the
    least text hash, of equal doc_ids and texts any one. Rows whose doc_id is null are chosen from by themselves, so a
    group that has both keeps one of each. Texts without words stay.
    """
    row = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("id"), F.xxhash64(text).alias("h"))
    found = near_duplicates(docs.select(row.alias("__row"), F.col(text).alias("__text")), k, percent, "__row", "__text").filter("n_shingles > 0")
    found = materialise(found.select(F.col("doc_id").alias("__row"), "component_id"))
    stay = found.groupBy("component_id", "__row.unnamed").agg(F.min("__row").alias("__row")).select("__row")
    rows = found.groupBy("__row").agg(F.count("*").alias("__n"))
    # the rows that aren't chosen, and the chosen ones that stand there several times
    marked = rows.join(stay.withColumn("__stays", F.lit(True)), "__row", "left").filter("__stays is null or __n > 1")
    marked = materialise(marked.select("__row", F.col("__stays").isNotNull().alias("__stays")))
    few = marked.count() <= 1_000_000
    lone = docs.withColumn("__row", row).join(F.broadcast(marked) if few else marked, "__row", "left")
    left = lone.filter("__stays is null").select(*docs.columns)
    if not marked.filter("__stays").limit(1).count():
        return left
    return left.union(lone.filter("__stays").dropDuplicates(["__row"]).select(*docs.columns))
