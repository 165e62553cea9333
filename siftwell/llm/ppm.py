"""LM scoring by prediction by partial matching over bytes, pretrained on the corpus.

A trie of byte contexts up to ORDER bytes holds how often each symbol (a byte, or the end of a text) followed each context
in the training documents. A symbol is coded in the longest known context; where it hasn't followed it, an escape
(method C: distinct symbols over occurrences plus distinct symbols) leads to the next shorter one, in which the symbols
of the longer one are excluded; the last resort is uniform over what is left. A document's score is the sum of the
log10 probabilities of its bytes and its end.

Nothing that grows with the corpus is broadcast or sent to the driver. Documents are dealt into blocks of about
BLOCK_BYTES by a hash of id and text. A block asks for the distinct (context, symbol) codes and words that it holds and
brings its own training counts; askings meet in ranges. A range holds all contexts with the same last two symbols, or,
where two symbols are frequent (as "e" and a blank are), with the same last three, so it has all the longer contexts'
nodes. What the shorter contexts need is in fixed tables: 257 x 257 counts of pairs, and for each frequent pair, HOT of
them at most, 257 counts of what follows. The range answers each block with probabilities, in the order of its codes, and
the block's documents add them up. Words (for the base score) are
counted the same way. Askings are compressed; only the documents themselves move twice.

Null texts are empty: one token, the end. A null doc_id is in training. Repeated rows count and are scored each; those
with the same id and text share a block. A very long text is taken a stretch at a time. An empty table gives an empty
result. Other columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import materialise, table, text_bytes
from siftwell.llm.jaccard_join import _unzip, _zip
from siftwell.llm.shingles import mix, word_hashes, words

ORDER = 5
BLOCK_BYTES = 6 << 20
#: Positions of text handled at once.
STRETCH = 1_000_000
#: Frequent pairs of symbols at most whose contexts are dealt by three symbols.
HOT = 4096
S = 257  # bytes and the boundary, 0, which pads the beginning and ends a text
END = b""  # no word is empty
_ASK = "range int, kind string, block int, m int, codes binary, counts binary"
_ANSWER = "block int, kind string, range int, m int, answer binary, total bigint, distinct bigint"


def symbols(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(ORDER + len(raw) + 1, np.int64)
    out[ORDER : ORDER + len(raw)] = raw
    out[ORDER : ORDER + len(raw)] += 1
    return out


def codes_of(sym: np.ndarray, order: int = ORDER) -> np.ndarray:
    """context * 257 + symbol for every symbol but the padding; the context's last symbol is its lowest digit."""
    n = len(sym) - ORDER
    out = sym[ORDER - order : ORDER - order + n].copy()
    for j in range(1, order + 1):
        out *= S
        out += sym[ORDER - order + j : ORDER - order + j + n]
    return out


def tokens_of(text: str | None) -> np.ndarray:
    return word_hashes([*words(text), END])


class _Counts:
    """Distinct codes with their training counts, gathered a stretch at a time."""

    def __init__(self):
        self.held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size = 0
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, train: bool) -> None:
        self.held[train].append(codes.view(np.uint64))
        self.size += len(codes)
        if self.size >= STRETCH:
            self.close()

    def close(self) -> None:
        parts, counts = [self.codes], [self.counts]
        for train, held in self.held.items():
            if held:
                c, n = np.unique(np.concatenate(held), return_counts=True)
                parts.append(c)
                counts.append(n if train else np.zeros(len(c), np.int64))
                held.clear()
        self.codes, self.counts = summed(np.concatenate(parts), np.concatenate(counts))
        self.size = 0


class _Places:
    """Codes of documents, kept as distinct codes and places among them, a stretch at a time."""

    def __init__(self):
        self.held: list[tuple[int, np.ndarray]] = []
        self.size = 0
        self.stretches: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc: int, codes: np.ndarray) -> None:
        self.held.append((doc, codes))
        self.size += len(codes)
        if self.size >= STRETCH:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            distinct, places = np.unique(np.concatenate([c for _, c in self.held]), return_inverse=True)
            starts = np.cumsum([0, *(len(c) for _, c in self.held[:-1])])
            self.stretches.append((distinct, places.astype(np.int32), np.array([d for d, _ in self.held]), starts))
        self.held, self.size = [], 0

    def close(self) -> np.ndarray:
        """All distinct codes, ascending."""
        self._flush()
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s[0] for s in self.stretches)]))
        return self.codes

    def sums(self, values: np.ndarray, docs: int) -> np.ndarray:
        """For each document the sum of its codes' values; values: one for each of the distinct codes."""
        out = np.zeros(docs)
        for distinct, places, doc, starts in self.stretches:
            np.add.at(out, doc, np.add.reduceat(values[np.searchsorted(self.codes, distinct)][places], starts))
        return out


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def split(codes: np.ndarray, kind: str, ranges: int, low: Low) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places) for ascending codes."""
    key = low.key_of(codes) if kind == "gram" else codes
    at = (mix(key) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(at[part[0]]), part


def gather(group: pa.Table, text: str) -> tuple[_Counts, _Counts]:
    grams, tokens = _Counts(), _Counts()
    for value, train in zip(group.column(text), group.column("__train").to_pylist(), strict=True):
        sym = symbols(value.as_py())
        for a in range(0, len(sym) - ORDER, STRETCH):
            grams.add(codes_of(sym[a : a + ORDER + STRETCH]), train)
        tokens.add(tokens_of(value.as_py()), train)
    grams.close()
    tokens.close()
    return grams, tokens


class Low:
    """Order 1 and order 0 from the table of symbol pairs, and order 2 of the frequent pairs."""

    def __init__(self, pairs: np.ndarray, frequent: np.ndarray, after: np.ndarray):
        """frequent: the numbers of the frequent pairs; after: for each of them the counts of the symbols that follow."""
        self.c1 = pairs.reshape(S, S)
        self.c0 = self.c1.sum(axis=0)
        self.n1, self.d1 = self.c1.sum(axis=1), (self.c1 > 0).sum(axis=1)
        self.n0, self.d0 = int(self.c0.sum()), int((self.c0 > 0).sum())
        self.e0 = (self.c1 > 0) @ self.c0  # order-0 counts of the symbols that each order-1 context excludes
        self.place = np.full(S * S, -1)
        self.place[frequent] = np.arange(len(frequent))
        # the last row is that of no frequent pair
        self.c2 = np.concatenate([after.reshape(-1, S), np.zeros((1, S), np.int64)])
        self.n2, self.d2 = self.c2.sum(axis=1), (self.c2 > 0).sum(axis=1)
        self.e2 = ((self.c2 > 0) * self.c1[np.r_[frequent % S, 0]]).sum(axis=1)

    def key_of(self, codes: np.ndarray) -> np.ndarray:
        """What codes of one range have in common: the context's last two symbols, or three."""
        pair = codes // np.uint64(S) % np.uint64(S * S)
        third = codes // np.uint64(S**3) % np.uint64(S) + np.uint64(1)
        return pair * np.uint64(S + 1) + np.where(self.place[pair.astype(np.int64)] >= 0, third, np.uint64(0))


def _look(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def probabilities(asked: np.ndarray, codes: np.ndarray, counts: np.ndarray, low: Low, order: int = ORDER) -> np.ndarray:
    """log10 of each asked code's probability, given the training codes with the same key_of()."""
    asked = asked.astype(np.int64)
    codes = codes.astype(np.int64)
    out = np.zeros(len(asked))
    open_ = np.ones(len(asked), bool)
    # of the context one longer, where it is known: its distinct symbols and the count here of those symbols
    gone_n, gone_d = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    level_codes, level_counts = summed(codes, counts)
    for k in range(order, -1, -1):
        node = (asked // S) % S**k
        if k >= 2:
            node_codes, first = np.unique(level_codes // S, return_index=True)
            n_of = np.add.reduceat(level_counts, first) if len(first) else np.zeros(0, np.int64)
            d_of = np.diff(np.r_[first, len(level_codes)])
            at, known = _look(node_codes, node)
            place, found = _look(level_codes, asked % S ** (k + 1))
            n = np.where(known, n_of[at] if len(n_of) else 0, 0)
            d = np.where(known, d_of[at] if len(d_of) else 0, 0)
            c = np.where(found, level_counts[place] if len(level_counts) else 0, 0)
            if k == 2:
                hot = low.place[node]
                n, d, c = (np.where(hot >= 0, x, y) for x, y in ((low.n2[hot], n), (low.d2[hot], d), (low.c2[hot, asked % S], c)))
        elif k == 1:
            n, d, c = low.n1[node], low.d1[node], low.c1[node, asked % S]
        else:
            n, d, c = np.full(len(asked), low.n0), np.full(len(asked), low.d0), low.c0[asked % S]
        free_n, free_d = n - gone_n, d - gone_d
        total = free_n + free_d
        hit = open_ & (c > 0)
        out[hit] += np.log10(c[hit] / total[hit])
        open_ &= c == 0
        escape = open_ & (free_n > 0)
        out[escape] += np.log10(free_d[escape] / total[escape])
        # what the next shorter context must leave out
        if k >= 3:
            shorter, shorter_counts = summed(level_codes % S**k, level_counts)
            if k == 3:
                hot = low.place[shorter // S]
                shorter_counts = np.where(hot >= 0, low.c2[hot, shorter % S], shorter_counts)
            below = shorter_counts[np.searchsorted(shorter, level_codes % S**k)] if len(level_codes) else level_counts
            e_of = np.add.reduceat(below, first) if len(first) else below
            gone_n, gone_d = np.where(known, e_of[at] if len(e_of) else 0, 0), d
            level_codes, level_counts = shorter, shorter_counts
        elif k == 2:
            below = low.c1[level_codes // S % S, level_codes % S] if len(level_codes) else level_counts
            e_of = np.add.reduceat(below, first) if len(first) else below
            gone_n, gone_d = np.where(hot >= 0, low.e2[hot], np.where(known, e_of[at] if len(e_of) else 0, 0)), d
        elif k == 1:
            gone_n, gone_d = low.e0[node], d
    out[open_] -= np.log10(S - low.d0)
    return out


def _trained(batches: Iterator[pa.RecordBatch], text: str, order: int) -> Iterator[np.ndarray]:
    """Codes of the training documents, about a stretch at a time."""
    held, size = [], 0
    for batch in batches:
        for value, train in zip(batch.column(text), batch.column("__train").to_pylist(), strict=True):
            sym = symbols(value.as_py()) if train else ()
            for a in range(0, len(sym) - ORDER, STRETCH):
                held.append(codes_of(sym[a : a + ORDER + STRETCH], order))
                size += len(held[-1])
                if size >= STRETCH:
                    yield np.concatenate(held)
                    held, size = [], 0
    if held:
        yield np.concatenate(held)


def _tabled(docs: DataFrame, text: str, order: int, size: int, place: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Counts of the training documents' codes in a table of `size` numbers, by their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for codes in _trained(batches, text, order):
            total += np.bincount(place(codes), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "c"])

    rows = docs.select(text, "__train").mapInArrow(run, "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("c").to_numpy()
    return out


def low_orders(docs: DataFrame, text: str, ranges: int, most: int = HOT) -> Low:
    """The tables of short contexts. A pair is frequent if it makes half a range by itself; `most` of them at most."""
    pairs = _tabled(docs, text, 1, S * S, lambda codes: codes)
    order = np.argsort(-pairs, kind="stable")[:most]
    frequent = np.sort(order[2 * ranges * pairs[order] > pairs.sum()])
    if not len(frequent):
        return Low(pairs, frequent, np.zeros(0, np.int64))
    known = np.full(S * S, -1)
    known[frequent] = np.arange(len(frequent))

    def place(codes: np.ndarray) -> np.ndarray:
        at = known[codes // S]
        return (at * S + codes % S)[at >= 0]

    return Low(pairs, frequent, _tabled(docs, text, 2, len(frequent) * S, place))


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row; train: which rows are learnt from."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"), F.coalesce(train, F.lit(True)).alias("__train"))
    blocks = max(1, -(-text_bytes(own, "__text") // block_bytes))
    ranges = max(16, blocks)
    low = own.sparkSession.sparkContext.broadcast(low_orders(own, "__text", ranges))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "__text"), F.lit(blocks)).cast("int"))

    def ask(group: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("range", "kind", "m", "codes", "counts")}
        for kind, held in zip(("gram", "word"), gather(group, "__text"), strict=True):
            for r, places in split(held.codes, kind, ranges, low.value):
                codes = held.codes[places]
                for c, v in zip(out, (r, kind, len(places), _zip(np.diff(codes, prepend=np.uint64(0))), _zip(held.counts[places].astype("<u4"))), strict=True):
                    out[c].append(v)
        n = len(out["m"])
        return pa.table({"range": pa.array(out["range"], pa.int32()), "kind": out["kind"], "block": pa.array([group.column("block")[0].as_py()] * n, pa.int32()), "m": pa.array(out["m"], pa.int32()), "codes": pa.array(out["codes"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        ms = group.column("m").to_pylist()
        codes = [np.cumsum(_unzip(c, m, "<u8"), dtype=np.uint64) for c, m in zip(group.column("codes").to_pylist(), ms, strict=True)]
        counts = [_unzip(c, m, "<u4").astype(np.int64) for c, m in zip(group.column("counts").to_pylist(), ms, strict=True)]
        all_codes, all_counts = summed(np.concatenate(codes), np.concatenate(counts))
        kind, known = group.column("kind")[0].as_py(), all_counts > 0
        if kind == "gram":
            value = probabilities(all_codes, all_codes[known], all_counts[known], low.value).astype("<f8")
        else:
            value = all_counts.astype("<u8")
        sent = [_zip(value[np.searchsorted(all_codes, c)]) for c in codes]
        first = [k == 0 and kind == "word" for k in range(len(ms))]
        return pa.table({"block": group.column("block"), "kind": group.column("kind"), "range": group.column("range"), "m": group.column("m"), "answer": pa.array(sent, pa.binary()), "total": pa.array([int(all_counts.sum()) * f for f in first], pa.int64()), "distinct": pa.array([int(known.sum()) * f for f in first], pa.int64())})

    asked = dealt.select("block", "__text", "__train").groupBy("block").applyInArrow(ask, _ASK)
    answers = materialise(asked.groupBy("range", "kind").applyInArrow(answer, _ANSWER))
    totals = answers.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    n_all, v_all = totals["n"] or 0, totals["v"] or 0

    def add_up(group: pa.Table, got: pa.Table) -> pa.Table:
        sent = {(k, r): (a, m) for k, r, a, m in zip(got.column("kind").to_pylist(), got.column("range").to_pylist(), got.column("answer").to_pylist(), got.column("m").to_pylist(), strict=True)}

        def values_of(kind: str, codes: np.ndarray, as_: str) -> np.ndarray:
            out = np.zeros(len(codes))
            for r, places in split(codes, kind, ranges, low.value):
                out[places] = _unzip(*sent[kind, r], as_)
            return out

        n = len(group)
        grams, tokens = _Places(), _Places()
        for i, value in enumerate(group.column("__text")):
            sym = symbols(value.as_py())
            for a in range(0, len(sym) - ORDER, STRETCH):
                grams.add(i, codes_of(sym[a : a + ORDER + STRETCH]).view(np.uint64))
            tokens.add(i, tokens_of(value.as_py()))
        counts = values_of("word", tokens.close(), "<u8")
        n_tokens = tokens.sums(np.ones(len(counts)), n).astype(np.int64)
        base = tokens.sums(np.log10(counts + 1), n) - n_tokens * np.log10(n_all + v_all + 1)
        known = tokens.sums((counts > 0).astype(float), n).astype(np.int64)
        total = grams.sums(values_of("gram", grams.close(), "<f8"), n)
        return pa.table({"doc_id": group.column("doc_id"), "n_tokens": pa.array(n_tokens), "n_known": pa.array(known), "train_tokens": pa.array([n_all] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(total)})

    kind = docs.schema[key].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.toxicity import remainder

    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    out = score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
