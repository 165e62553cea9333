import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from siftwell.llm import bpe, elias_fano, token_files
from siftwell.llm.common import range_bounds, work_dir

TEXTS = ["", None, "a", "Hello  world,\n it's  fine ", "tab\t and \x85 nbsp\xa0 \xa0x", "é" * 3000, "x" * 5000, "<|endoftext|> 12345", "日本語 テキスト 😀", "same words same words", "same words same words", " lead", "trail \n"]
PIECES = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "1", "!", "é", "ß", "漢", "\xa0", "　", "\x85", "😀", "the", "ing", "\r\n", ".", ","]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(3000))


def test_bpe_equals_tiktoken(codec):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t), t
        assert codec.decode(ids).decode() == t
    small = bpe.BLOCK
    try:
        bpe.BLOCK = 50
        long = " ".join(texts[:300])
        assert np.frombuffer(codec.encode(long), "<u4").tolist() == own.encode_ordinary(long)
    finally:
        bpe.BLOCK = small


def test_bpe_over_a_table(spark, codec):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, codec), codec).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in got] == [t or "" for t in TEXTS] and got[0]["n_tokens"] == 0
    out = bpe.encode(df, codec, add=("n_tokens", "ids_sha256", "decoded_sha256")).orderBy("doc_id").collect()
    assert [r["decoded_sha256"] for r in out] == [hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS]
    assert out[2]["ids"] == "kept" and bpe.encode(df.limit(0), codec).count() == 0


@pytest.mark.parametrize("values", [[], [0], [0, 0, 5], [7], [3] * 1500, list(range(2000)), sorted(random.Random(1).choices(range(10**12), k=3000)), [-5, -5, 0, 2**40]])
def test_elias_fano(values):
    data = elias_fano.encode(values, values[0] if values else 0)
    e = elias_fano.EliasFano(data)
    for a, b in ((0, len(values)), (len(values) // 3, len(values) // 2), (len(values) // 2, len(values))):
        assert e.select_run(a, b).tolist() == values[a:b]
    assert e.all().tolist() == values and [e.select(i) for i in range(0, len(values), 37)] == values[::37]
    assert e.bytes == len(data)
    with pytest.raises(IndexError):
        e.select(len(values))


@pytest.fixture(scope="module")
def words():
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as f:
        return token_files.WordTokenizer(f.read(), memo=40)


@pytest.mark.parametrize("special", [True, False])
def test_words_equal_the_library(words, special):
    own = Tokenizer.from_str(words.spec)
    own.encode_special_tokens = not special
    rng = random.Random(9)
    more = ["İstanbul", "ΣΑΣ", "Erst.", "á", "ΐ,", "Straße!", "É", "\xad", "\x1c", "\x7f", "ª", "²", "''S", "x" * 60, "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|"]
    texts = TEXTS + ["x<|endoftext|>y"] + ["".join(rng.choice([*PIECES, *more]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    got = list(token_files.WordTokenizer(words.spec, memo=40, special=special).encode(texts, 2))
    if special:
        assert np.frombuffer(got[len(TEXTS)], "<u2").tolist() == [343, 49407, 344, 2]
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*own.encode(t or "", add_special_tokens=False).ids, 2], t


def test_token_files_round_trip(spark, words):
    rows = [(i * 3 - 10, f"text number {i} " * (i % 7)) for i in range(200)] + [(None, "no id"), (5, None), (5, "same id"), (5, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as start").repartition(5)
    folder = work_dir(spark)
    token_files.write(token_files.tokenise(df, words, 2), folder, words.width, range_bounds(df, "doc_id", 4), file_ids=300)
    got = token_files.read(spark, folder).orderBy("start").collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    assert [r["doc_id"] for r in got] == [rows[i][0] for i in order]
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids[-1] == 2
        at += len(ids)
    want = sorted(zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in words.encode([t for _, t in rows], 2))
    assert sorted(zlib.crc32(bytes(r["ids"])) for r in got) == want
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).first()["content"]
    f = token_files.TokenFile(bytes(content))
    assert sum(len(f.document(k)) for k in range(len(f))) == f.head["ids"]
    docs, starts, stops = f.spans(0, len(f))
    assert [(d, a, b) for d, a, b in zip(docs, starts.tolist(), stops.tolist(), strict=True)] == [(f.doc_id(k), *f.span(k)) for k in range(len(f))]


def test_no_documents(spark, words):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = work_dir(spark)
    token_files.write(token_files.tokenise(df, words, 2), folder, words.width, range_bounds(df, "doc_id", 4))
    assert token_files.read(spark, folder).count() == 0
