import os

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ITEM = "the benchmark asks which of these nine curious answers is the right one for this long question today"
COPY = "a document about something that was copied with a small change somewhere near its very end by a person who writes often and says many different things in long sentences of plain words"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(240)]
    toxic = [i % 4 == 0 for i in range(240)]
    texts = [t.replace(" ", " vilo ", 3).replace(" ", " scurn ", 2) if bad else t for t, bad in zip(texts, toxic, strict=True)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(1000, COPY, "en", "s", 1), (1001, COPY + " indeed", "en", "s", 1), (1002, COPY, None, None, None), (1003, "w1 w2 " + ITEM.upper() + " w3", "en", "s", 1), (1004, None, "en", "s", None), (1005, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    names, kept = [], [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, folder)
        names.append(name)
        kept.append({r["doc_id"] for r in docs.collect()})
        if name != "byte_bpe":
            assert docs.columns == before
    clean = {i for i in range(240) if i % 4}
    assert len(clean - kept[1]) <= 2 and len({i for i in range(0, 240, 4)} & kept[1]) <= 3 and {1000, 1001, 1002, 1003, 1004, 1005} <= kept[1]
    assert kept[1] - kept[2] == {1001, 1002}
    assert kept[2] - kept[3] == {1003}
    assert kept[3] == kept[4]
    assert {"n_tokens", "ids"} <= set(docs.columns) and "text" not in docs.columns


def test_run_equals_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.filter("doc_id = 1000").first()["n_tokens"] > 20 and out.filter("doc_id = 1005").first()["n_tokens"] == 0


def test_stages_equal_brute_force_on_awkward_rows(spark, folder, tmp_path):
    """Null and repeated ids, empty and very long texts, further columns: each stage against plain Python on its input."""
    import base64
    from collections import Counter

    import public_tokenizers
    import tiktoken

    from siftwell.llm import toxicity

    at = str(tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    rng = np.random.default_rng(9)
    long = " ".join(f"u{x}" for x in rng.integers(0, 10**9, 200_000))
    say = lambda x: " ".join(f"{x}{i}" for i in range(40))
    more = [(None, say("a")), (None, say("a")), (None, say("b")), (5000, say("c")), (5000, say("c")), (5000, say("d")), (5001, say("c") + " more"), (5002, long), (5003, long + " end"), (5004, ""), (None, None), (5005, " \n"), (None, "x " + ITEM), (5006, ITEM[:-6])]
    base = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(d, t, None, "s", 1) for d, t in more], base.schema)
    docs = base.union(extra).selectExpr("*", "1 as score", "'k' as kid", "cast(null as string) as root", "2 as block").repartition(5)
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    shingles = lambda t: (lambda w: {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split())
    (_, toxic), (_, near), (_, clean), (_, bpe) = corpus_pipeline.STAGES

    first = corpus_pipeline.materialise(toxic(spark, docs, at))
    model = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    rows = pairs(docs)
    assert Counter(pairs(first)) == Counter(r for r, x in zip(rows, model.scores([t for _, t in rows]), strict=True) if x < toxicity.THRESHOLD)

    second = corpus_pipeline.materialise(near(spark, first, at))
    rows = pairs(first)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                root = [root[j] if r == root[i] else r for r in root]
    groups: dict = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault((root[i], d is None) if sets[i] else i, []).append((d, t))
    got = pairs(second)
    assert len(got) == len(groups) and Counter(d for d, _ in got) == Counter(min(g, key=lambda r: r[0] or 0)[0] for g in groups.values())
    assert not Counter(got) - Counter(rows) and {t for d, t in got if d == 5000} == {say("c"), say("d")}

    third = corpus_pipeline.materialise(clean(spark, second, at))
    own = shingles(ITEM)
    rows = pairs(second)
    size = len(ITEM.split())

    def holds(t):
        w = (t or "").lower().split()
        return any(5 * len(own & (s := shingles(" ".join(w[i : i + size])))) >= 4 * len(own | s) for i in range(max(1, len(w) - size + 1))) if "benchmark" in w else False

    assert Counter(pairs(third)) == Counter(r for r in rows if not holds(r[1])) and len(rows) - third.count() == 3
    assert first.columns == second.columns == third.columns == docs.columns

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((d, np.array(own.encode_ordinary(t or ""), "<u4").tobytes()) for d, t in pairs(third))
    out = bpe(spark, third, at)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in out.collect()) == want and {"score", "kid", "root", "block"} <= set(out.columns)

    docs.limit(0).write.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
