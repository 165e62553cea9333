"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash (hash and displace: one displacement per bucket, every slot used) resolves
pre-tokens that are themselves in the vocabulary; a pre-token that isn't goes through the merges, a heap of
(rank, position) over a doubly linked list of its bytes, O(n log n) however long it is.

A worker remembers what the two tiers gave for the words it has met, at most MEMO of KEPT characters each, and for a
quarter as many pre-tokens of texts that aren't cut into words. Texts are cut at single spaces where that provably
doesn't change the pre-tokens; texts with runs of spaces are matched whole. Rows are taken a few hundred at a time. Null texts are encoded as empty ones. Rows and their other columns stay as they are,
except that a column named like a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftwell.llm.common import slices, table

MEMO, KEPT = 400_000, 48
#: Longer texts are encoded in blocks of about so many characters.
BLOCK = 4_000_000
_MIX = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: slot(key) is a different number below n for each of them.

    Other keys get an arbitrary slot, so the caller compares the key that it keeps there.
    """

    def __init__(self, keys: Sequence[bytes], load: int = 4):
        self.n = len(keys)
        self.buckets = max(1, self.n // load)
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            held[h % self.buckets].append(h)
        self.shift = [0] * self.buckets
        free = [True] * self.n
        order = sorted(range(self.buckets), key=lambda b: -len(held[b]))
        singles = []
        for b in order:
            if len(held[b]) < 2:
                singles += [b] * len(held[b])
                continue
            d = 0
            while True:
                d += 1
                slots = {self._at(h, d) for h in held[b]}
                if len(slots) == len(held[b]) and all(free[s] for s in slots):
                    break
                if d > 1_000_000:
                    raise ValueError("two keys have the same hash")
            self.shift[b] = d
            for s in slots:
                free[s] = False
        rest = (s for s in range(self.n) if free[s])
        for b in singles:  # a bucket of one key names its slot
            self.shift[b] = -next(rest) - 1

    def _at(self, h: int, d: int) -> int:
        return (((h ^ (d * _MIX)) * _MIX & _ALL) >> 32) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._at(h, d)


class _Memo(dict):
    """Calls `make` for what it doesn't hold. When full, it keeps what it holds aside as long as it fills again, so that
    what is asked for often stays. Longer keys than KEPT aren't kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        if len(key) > KEPT:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value


class Codec:
    """Encodes and decodes by ranks (bytes to id, all single bytes among them) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, memo: int = MEMO):
        self.ranks, self.pattern, self.memo = ranks, pattern, memo
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slots: list[tuple[bytes, bytes]] = [(b"", b"")] * len(keys)
        for key in keys:
            self.slots[self.hash.slot(key)] = (key, ranks[key].to_bytes(4, "little"))
        self._ready()

    @classmethod
    @cache
    def from_file(cls, path: str, **more) -> Codec:
        """Built once in a process."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, **more)

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.open_space = re.compile(r" (?:\s|\Z)").search
        self.packed = {key: rank.to_bytes(4, "little") for key, rank in self.ranks.items()}
        self.words = _Memo(self._word, self.memo)
        self.pretokens = _Memo(lambda p: self.pretoken(p.encode()), max(2, self.memo // 4))
        self.table = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for key, rank in self.ranks.items():
            self.table[rank] = key

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "open_space", "words", "pretokens", "packed", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def pretoken(self, piece: bytes) -> bytes:
        """Ids of one pre-token."""
        key, packed = self.slots[self.hash.slot(piece)]
        return packed if key == piece else self._merge(piece)

    def _merge(self, piece: bytes) -> bytes:
        n, get, packed = len(piece), self.ranks.get, self.packed
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry is one integer: rank, start and end of the pair
        bits = (n + 1).bit_length()
        mask = (1 << bits) - 1
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            to, i = entry & mask, entry >> bits & mask
            if end[i] < 0 or (j := after[i]) >= n or end[j] != to:  # one of its parts has been merged meanwhile
                continue
            end[i], end[j] = to, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(piece[i : (e := end[k])])) is not None:
                    push(heap, (r << bits | i) << bits | e)
            if (h := before[i]) >= 0 and (r := get(piece[h:to])) is not None:
                push(heap, (r << bits | h) << bits | to)
        out, i = [], 0
        while i < n:
            out.append(packed[piece[i : end[i]]])
            i = after[i]
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a word with the space before it; words of letters and a full stop or comma need no pattern."""
        if word.isalpha():
            return self.pretoken(b" " + word.encode())
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self.words[word[:-1]] + self.pretokens[word[-1]]
        return self._match(" " + word)

    def _match(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.find(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self._block, _blocks(text))) if len(text) > BLOCK else self._block(text)

    def _block(self, text: str) -> bytes:
        # at a space before something that is no space a pre-token begins: what precedes can't reach over it
        if self.open_space(text):
            return self._match(text)
        head, *words = text.split(" ")
        return self._match(head) + b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _blocks(text: str) -> Iterator[str]:
    """Cuts before spaces that stand alone between other characters."""
    start = 0
    alone = regex.compile(r"(?<=\S) (?=\S)")
    while start < len(text):
        cut = alone.search(text, start + BLOCK) if start + BLOCK < len(text) else None
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


_KINDS = {
    "n_tokens": ("bigint", pa.int64()),
    "ids": ("binary", pa.binary()),
    "decoded": ("binary", pa.binary()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}
_RESULTS = {
    "n_tokens": lambda ids, raw: len(ids) // 4,
    "ids": lambda ids, raw: ids,
    "decoded": lambda ids, raw: raw,
    "ids_sha256": lambda ids, raw: hashlib.sha256(ids).hexdigest(),
    "decoded_sha256": lambda ids, raw: hashlib.sha256(raw).hexdigest(),
}


def _schema(df: DataFrame, gone: Sequence[str], add: Sequence[str]) -> T.StructType:
    kept = [f for f in df.schema if f.name not in {*gone, *add}]
    return T.StructType(kept + [T.StructField(c, T._parse_datatype_string(_KINDS[c][0])) for c in add])


def encode(df: DataFrame, codec: Codec, text: str = "text", add: Sequence[str] = ("n_tokens", "ids"), drop_text: bool = True) -> DataFrame:
    """Adds the columns `add` (n_tokens, ids, ids_sha256; decoded and decoded_sha256 by decoding the ids again).

    Without text if drop_text. The codec, bounded by its vocabulary, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(codec)
    schema = _schema(df, [text] if drop_text else [], add)
    kept = [f.name for f in schema if f.name not in add]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            made: dict[str, list] = {c: [] for c in add}
            for value in batch.column(text):
                ids = own.encode(value.as_py())
                raw = own.decode(ids) if "decoded" in made or "decoded_sha256" in made else b""
                for c, put in made.items():
                    put.append(_RESULTS[c](ids, raw))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(made[c], _KINDS[c][1]) for c in add)], [*kept, *add])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, codec: Codec, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (binary); null ids give empty bytes."""
    shared = df.sparkSession.sparkContext.broadcast(codec)
    schema = _schema(df, [], ["decoded"])
    kept = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [shared.value.decode(x.as_py() or b"") for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(raw, pa.binary())], [*kept, "decoded"])

    return df.mapInArrow(run, schema)


VOCABULARY = "byte_bpe_50k.tiktoken"


def op2_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    codec = Codec.from_file(vocabulary or public_tokenizers.path(VOCABULARY))
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), codec, add=("n_tokens", "ids_sha256", "decoded_sha256"))
