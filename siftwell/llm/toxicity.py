"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of two learned lexicons (whole words; word beginnings, for languages that inflect), their densest
stretch, how near hits stand to a second person, the rates of second persons, capitals, punctuation, runs of marks,
obfuscated and stretched words, lexicon words found after undoing obfuscation, and length.

Fitting takes at most FIT_ROWS labelled rows, those with the least hash of their doc_id, and only rows that `fits`
allows. They are split by doc_id in three: the lexicons come from one part, the trees from a second, the calibration
from a third, so that each judges words and margins on rows not used before. Lexicon entries are what stands in
significantly more toxic documents than its share. The model (lexicons of at most LEXICON entries, trees, steps) is
bounded and broadcast; scoring is one pass without shuffle.

A null text is scored as the empty one; a very long one is one row as any other. Rows without a label are not used; of a
doc_id labelled repeatedly the largest label counts, of one that several rows have the text of the least hash. Repeated
rows are scored each; an empty table gives an empty result. Without any labels of both kinds every score is the constant rate. Other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from siftwell.llm.common import materialise, slices, table, tidy

FIT_ROWS = 30_000
LEXICON = 2_000
THRESHOLD = 0.7
#: Lengths of word beginnings.
STEMS = range(3, 7)
#: Words on either side of a hit in which a second person counts as near; words of a dense stretch.
NEAR, STRETCH = 6, 40
MEMO = 150_000

SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split())
_PLAIN = str.maketrans("013457@$!|+*", "oieastasiiti")
_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…-–—¡¿*_~"
_WORD, _STEM, _SECOND, _CAPS, _ODD, _LONG, _UNDONE = (1 << k for k in range(7))
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_LETTER[192:] = 1  # one for each character beyond ASCII
_MARK = np.zeros(256)
_MARK[[ord(c) for c in "!?*#@$%&"]] = 1
_PUNCT = np.zeros(256)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
FEATURES = ("word_density", "stem_density", "hits", "stretch", "near_second", "second_density", "capitals", "caps_words", "punctuation", "marks", "runs", "odd_words", "long_words", "undone_density", "digits", "length")
_RUN = re.compile(rb"[!?*]{2,}")
_SAME = re.compile(r"(.)\1\1")


def normal(word: str) -> str:
    return word.lower().strip(_EDGE)


def undone(word: str) -> str:
    """Without obfuscation: look-alike signs read as letters, other signs dropped, stretched letters shortened."""
    plain = "".join(c for c in word.lower().strip(".,;:\"'()[]").translate(_PLAIN) if c.isalpha())
    return re.sub(r"(.)\1{2,}", r"\1", plain)


@dataclass
class Lexicon:
    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()

    def flags(self, raw: bytes) -> int:
        word = raw.decode(errors="replace")
        w = normal(word)
        out = _WORD * (w in self.words) | _SECOND * (w in SECOND_PERSON)
        if len(w) >= STEMS[0] and any(w[:k] in self.stems for k in STEMS if k <= len(w)):
            out |= _STEM
        if len(w) > 2 and w.upper() == word.strip(_EDGE) and w.lower() != w.upper():
            out |= _CAPS
        inner = word.strip(".,;:!?\"'()[]-")
        if len(inner) > 2 and not inner.isalpha() and any(map(str.isalpha, inner)):
            if any(c in "013457@$!|+*" for c in inner):
                out |= _ODD
                if undone(word) in self.words:
                    out |= _UNDONE
        if _SAME.search(w):
            out |= _LONG
            if undone(word) in self.words:
                out |= _UNDONE
        return out


class _Flags(dict):
    """Flags of the words met so far, at most MEMO."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = self.lexicon.flags(word)
        return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    steps: Isotonic

    def __post_init__(self):
        self.flags = _Flags(self.lexicon)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "flags"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def features(self, text: str | None) -> np.ndarray:
        return features(text, self.flags)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return self.steps(self.trees.margin(x))


def features(text: str | None, flags: _Flags) -> np.ndarray:
    raw = (text or "").encode(errors="replace")
    words = raw.split()
    n, chars = max(1, len(words)), max(1, len(raw))
    out = np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1.0, float(counts @ _LETTER))
    out[6], out[8], out[9], out[14] = counts @ _UPPER / letters, counts @ _PUNCT / chars, counts @ _MARK / chars, counts @ _DIGIT / chars
    out[10] = len(_RUN.findall(raw)) / n if counts[33] + counts[63] + counts[42] > 1 else 0.0
    out[15] = math.log1p(len(words))
    codes = np.fromiter(map(flags.__getitem__, words), np.uint8, len(words))
    if codes.any():
        share = [np.count_nonzero(codes & k) / n for k in (_WORD, _STEM, _SECOND, _CAPS, _ODD, _LONG, _UNDONE)]
        out[0], out[1], out[5], out[7], out[11], out[12], out[13] = share
        hits = np.flatnonzero(codes & (_WORD | _STEM | _UNDONE))
        if len(hits):
            out[2] = math.log1p(len(hits))
            out[3] = (np.searchsorted(hits, hits + STRETCH) - np.arange(len(hits))).max()
            second = np.flatnonzero(codes & _SECOND)
            if len(second):
                gap = np.abs(second[np.clip(np.searchsorted(second, hits), 0, len(second) - 1)] - hits)
                before = np.abs(second[np.clip(np.searchsorted(second, hits) - 1, 0, len(second) - 1)] - hits)
                out[4] = np.mean(np.minimum(gap, before) <= NEAR)
    return out


def _terms(text: str | None) -> set[str]:
    words = {w for raw in set((text or "").split()) if (w := normal(raw)) and len(w) <= 40}
    return {"w" + w for w in words} | {"s" + w[:k] for w in words for k in STEMS if len(w) >= k}


def mine(sample: DataFrame) -> Lexicon:
    """Lexicons from rows (text, toxic): document counts by class are summed over the cluster, only the significant
    terms (at most LEXICON of each kind) come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "no": pa.array([held[0][t] for t in terms], pa.int64()), "yes": pa.array([held[1][t] for t in terms], pa.int64())})
            held[0].clear()
            held[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                held[toxic].update(_terms(text))
                if len(held[0]) + len(held[1]) > 500_000:
                    yield flush()
        yield flush()

    rows = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = rows.get(1, 0), rows.get(0, 0)
    if not pos or not neg:
        return Lexicon()
    counts = sample.select("text", "toxic").mapInArrow(count, "term string, no bigint, yes bigint").groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    lift = (F.col("yes") / pos) / ((F.col("no") + 0.5) / neg)
    expected = (F.col("yes") + F.col("no")) * (pos / (pos + neg))
    gain = 2 * F.col("yes") * F.log(F.col("yes") / expected)
    good = counts.filter((F.col("yes") >= max(4, pos // 400)) & (lift >= 8)).withColumn("gain", gain).filter(F.col("gain") >= 16)
    top = lambda kind: frozenset(r["term"][1:] for r in good.filter(F.substring("term", 1, 1) == kind).orderBy(F.desc("gain"), "term").limit(LEXICON).collect())
    good = materialise(good)
    return Lexicon(top("w"), top("s"))


def fit(docs: DataFrame, labels: DataFrame, fits: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """fits: which labelled rows may be used, a condition on `key` (all by default)."""
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    if fits is not None:
        known = known.filter(fits)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # a doc_id on several rows counts once, so that no more than `rows` texts are learnt from
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic")
    sample = materialise(sample.withColumn("part", F.pmod(F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")), F.lit(10))))
    lexicon = mine(sample.filter("part < 4"))
    shared = docs.sparkSession.sparkContext.broadcast(Model(lexicon, Trees(0), Isotonic(np.zeros(1), np.zeros(1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["part", "toxic", "x"])

    got = sample.filter("part >= 4").select("text", "part", "toxic").mapInArrow(run, "part bigint, toxic int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    y, grow = got["toxic"].to_numpy(float), (got["part"] < 8).to_numpy()
    trees = fit_trees(x[grow], y[grow])
    return Model(lexicon, trees, fit_isotonic(trees.margin(x[~grow]), y[~grow]))


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Adds column `to` (0 to 1), replacing one of that name."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema if f.name != to]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            got = shared.value.scores([t.as_py() for t in batch.column(text)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(got, pa.float64())], [*names, to])
        tidy()

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.DoubleType())]))


def remainder(modulus: int, key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fits=remainder(3) != 1)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows scored below the threshold, with the columns of `docs`."""
    return score(docs, fit(docs, labels), to="__toxicity").filter(F.col("__toxicity") < threshold).drop("__toxicity")
