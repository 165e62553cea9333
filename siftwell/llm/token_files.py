"""Token-id files: concatenated ids with Elias-Fano coded document boundaries and document ids.

A file holds documents in ascending doc_id order (nulls first; equal ids by their token ids):

    "SWTK0001" | u32 header length | header | doc ids (Elias-Fano) | ends (Elias-Fano) | ids

The header (JSON) gives width (bytes of an id, the least that the vocabulary needs), documents, nulls (documents
whose doc_id is null), ids, and the lengths of the two codes. `ends` are the counts of ids up to and including each
document, so document k spans select(k - 1) to select(k). Files are cut at about FILE_IDS ids between documents; one
document is never split. A manifest in the same folder, a Parquet table with one row per file, tells what the files
hold and how many ids precede each.

Writing: documents are dealt into ranges of doc_id, sorted within each and written by its task through a temporary
name, then renamed; names depend on the data alone, so a task that runs again replaces its own files. Reading takes
whole files by Spark's binaryFile source and needs no other order. Null texts are empty; an empty table gives no file. Other
columns than key and text aren't read. doc_ids are integers.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm import elias_fano
from siftwell.llm.common import deal_by_range, range_bounds, slices, small_batches, table, text_bytes, work_dir

MAGIC = b"SWTK0001"
FILE_IDS = 4_000_000
#: Bytes of text whose ids go to one range.
RANGE_BYTES = 48 << 20
MEMO, KEPT = 200_000, 48
#: Characters that code the bytes 0 to 255 in byte-level vocabularies: the printable ones code themselves, the others
#: follow in order from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CODED = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
#: The steps of a specification that _Words repeats by itself.
_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


class _Words(dict):
    """Packed ids of words of at most KEPT bytes, made when first asked for. When full, what it holds is kept aside while
    it fills again."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > KEPT:
            return self.make(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(word)) is None:
            ids = self.make(word)
        self[word] = ids
        return ids


class WordTokenizer:
    """A tokenizer of the tokenizers library that lower-cases and drops white space, so that it can be asked by word.

    Words are cut at ASCII white space, A-Z are lower-cased; what a word gives is remembered, for at most MEMO words. A
    printable word of Latin-1 is cut by the specification's pattern and goes straight to the library's model; any other
    is encoded by the whole library. A text that holds a special token's string goes to the library as it is, which
    takes it for the special token, its default; with special=False such strings are ordinary text.
    """

    def __init__(self, spec: str, memo: int = MEMO, special: bool = True):
        from tokenizers import Tokenizer

        self.spec, self.memo = spec, memo
        self.whole = Tokenizer.from_str(spec)
        self.own = Tokenizer.from_str(spec)
        self.own.encode_special_tokens = True
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()] if special else []
        self.width = 2 if self.own.get_vocab_size() <= 1 << 16 else 4
        self.model = self.own.model
        read = json.loads(spec)
        normal, cuts = (read["normalizer"] or {}).get("normalizers", []), (read["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = ([x["type"] for x in normal], [x["type"] for x in cuts]) == _STEPS and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not cuts[1]["add_prefix_space"]
        self.find = regex.compile(cuts[0]["pattern"]["Regex"]).findall if plain else None
        self.words = _Words(self._word, memo)

    def __reduce__(self):
        return WordTokenizer, (self.spec, self.memo, bool(self.special))

    def _pack(self, ids: Iterable[int]) -> bytes:
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha() and self.find:
            return self._pack([t.id for t in self.model.tokenize(word.decode())])
        s = word.decode()
        if not self.find or not s.isprintable() or max(s) > "\xff":
            return self._pack(self.own.encode(s, add_special_tokens=False).ids)
        pieces = self.find(s.lower())
        if len(pieces) == 1:
            return self._pack([t.id for t in self.model.tokenize(pieces[0].encode().decode("latin-1").translate(_CODED))])
        return b"".join([self.words[p.encode()] for p in pieces])

    def encode(self, texts: Iterable[str | None], end: int | None = None) -> Iterator[bytes]:
        """Ids of each text, `width` bytes each, little-endian; `end` is appended."""
        close = b"" if end is None else end.to_bytes(self.width, "little")
        get = self.words.__getitem__
        for text in texts:
            if not text:
                yield close
            elif "<" in text and any(x in text for x in self.special):
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes() + close
            else:
                yield b"".join(map(get, text.encode().lower().split())) + close


def tokenise(df: DataFrame, tokenizer: WordTokenizer, end: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key and ids (binary, `width` bytes each)."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    schema = T.StructType([df.schema[key], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = list(shared.value.encode((x.as_py() for x in part.column(text)), end))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, pa.binary())], [key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    nulls = sum(d is None for d in doc_ids)
    known = doc_ids[nulls:]
    docs = elias_fano.encode(known, known[0] if known else 0)
    ends = elias_fano.encode(np.cumsum([len(x) // width for x in ids], dtype=np.int64))
    head = json.dumps({"width": width, "documents": len(ids), "nulls": nulls, "ids": sum(map(len, ids)) // width, "doc_ids_bytes": len(docs), "ends_bytes": len(ends)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, docs, ends, *ids])


class TokenFile:
    """One file's content: document k by select, without unpacking the boundaries."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", view, 8)
        self.head = json.loads(bytes(view[12 : 12 + size]))
        at = 12 + size
        self.doc_ids = elias_fano.EliasFano(view[at : at + self.head["doc_ids_bytes"]])
        at += self.head["doc_ids_bytes"]
        self.ends = elias_fano.EliasFano(view[at : at + self.head["ends_bytes"]])
        self.ids = np.frombuffer(view, f"<u{self.head['width']}", self.head["ids"], at + self.head["ends_bytes"])

    def __len__(self) -> int:
        return self.head["documents"]

    def doc_id(self, k: int) -> int | None:
        return None if k < self.head["nulls"] else self.doc_ids.select(k - self.head["nulls"])

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def spans(self, first: int, stop: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Doc ids, starts and ends of the documents first to stop - 1, by select."""
        nulls = self.head["nulls"]
        ends = self.ends.select_run(max(0, first - 1), stop)
        starts = ends[:-1] if first else np.concatenate([[0], ends[:-1]]).astype(np.int64)
        known = self.doc_ids.select_run(max(0, first - nulls), max(0, stop - nulls)).tolist()
        return [None] * (stop - first - len(known)) + known, starts, ends[1:] if first else ends

    def document(self, k: int) -> np.ndarray:
        start, stop = self.span(k)
        return self.ids[start:stop]


@cache
def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(tokens: DataFrame, folder: str, width: int, bounds: list[int], key: str = "doc_id", file_ids: int = FILE_IDS) -> None:
    """Writes `tokens` (key, ids) as token files and their manifest into a new folder that all executors share.

    bounds: of doc_id, from range_bounds().
    """
    ordered = deal_by_range(tokens, key, bounds).sortWithinPartitions(F.col(key).asc_nulls_first(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _store(folder)
        part, number = TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[bytes] = []
        size = 0

        def put() -> pa.RecordBatch:
            nonlocal docs, held, size, number
            name = f"part-{part:06d}-{number:05d}.tok"
            store.create_dir(root, recursive=True)
            temp = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as out:
                out.write(pack(docs, held, width))
            store.move(temp, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "documents": [len(docs)], "ids": [size // width]})
            docs, held, size, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for d, ids in zip(batch.column(key).to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and size + len(ids) > file_ids * width:
                    yield put()
                docs.append(d)
                held.append(ids)
                size += len(ids)
        if held:
            yield put()

    with small_batches(tokens.sparkSession, 500):
        ordered.mapInArrow(run, "file string, part int, number int, documents bigint, ids bigint").write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit)."""
    manifest = spark.read.parquet(f"{folder}/manifest").withColumn("some", F.shiftright("part", 10))
    # one row a file, about 8 MB of ids each: sums within a thousand parts, then over what stands before them
    sums = manifest.groupBy("some").agg(F.sum("ids").alias("held"))
    sums = sums.select("some", (F.sum("held").over(W.orderBy("some")) - F.col("held")).alias("earlier"))
    within = F.sum("ids").over(W.partitionBy("some").orderBy("part", "number")) - F.col("ids")
    before = manifest.select("file", "some", within.alias("within_some")).join(sums, "some").select("file", (F.col("within_some") + F.col("earlier")).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                own = TokenFile(content.as_buffer())
                name = path.rsplit("/", 1)[-1]
                for k in range(0, len(own), 250):
                    docs, starts, stops = own.spans(k, min(k + 250, len(own)))
                    ids = [own.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(docs, pa.int64()), pa.array(starts), pa.array(stops - starts), pa.array(ids, pa.binary())], ["file", "doc_id", "within", "n_tokens", "ids"])

    docs = files.select("path", "content").mapInArrow(run, "file string, doc_id bigint, within bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(before) if manifest.count() <= 100_000 else before, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


VOCABULARY = "word_bpe_49k.json"
END = 2


def op8_elias_fano_tokens(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as spec:
        tokenizer = WordTokenizer(spec.read())
    docs = table(spark, sf_dir, "documents")
    parts = max(1, -(-text_bytes(docs) // RANGE_BYTES))
    bounds = range_bounds(docs, "doc_id", parts)
    folder = work_dir(spark)
    write(tokenise(docs, tokenizer, END), folder, tokenizer.width, bounds)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
