import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import boosting, fingerprint, ppm, toxicity

ROWS = [(i, t) for i, t in enumerate(["", None, "a", "the cat sat on the mat", "the cat sat on the mat", "Der Übermut\ttut\n selten gut", "x" * 3000, "zz\x00zz", "one two three " * 200])] + [(None, "no id"), (3, "id again")]


@pytest.mark.parametrize("most", [0, 3, ppm.HOT])
def test_ppm_equals_brute_force(spark, monkeypatch, most):
    tables = ppm.low_orders
    met = []
    monkeypatch.setattr(ppm, "low_orders", lambda *a: met.append(tables(*a, most)) or met[-1])
    rng = random.Random(2)
    rows = ROWS + [(100 + i, " ".join(rng.choice(["ab", "abc", "bca", "x"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    learn = lambda d: d is None or d % 4 != 1
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as block").repartition(3)
    got = ppm.score(df, F.col("doc_id") % 4 != 1, block_bytes=2000).collect()
    counts, tokens = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)], Counter()
    for d, t in rows:
        if learn(d):
            sym = ppm.symbols(t).tolist()
            for j in range(ppm.ORDER, len(sym)):
                for k in range(ppm.ORDER + 1):
                    counts[k][tuple(sym[j - k : j])][sym[j]] += 1
            tokens.update([*(t or "").encode().lower().split(), None])
    total, distinct = sum(tokens.values()), len(tokens)

    def logp(context, s):
        out, gone = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = counts[k].get(tuple(context[ppm.ORDER - k :]))
            if not seen:
                continue
            free = {x: n for x, n in seen.items() if x not in gone}
            n, d = sum(free.values()), len(free)
            if s in free:
                return out + math.log10(free[s] / (n + d))
            out += math.log10(d / (n + d)) if n else 0.0
            gone = set(seen)
        return out - math.log10(257 - len(gone))

    def expected(t):
        words, sym = [*(t or "").encode().lower().split(), None], ppm.symbols(t).tolist()
        base = sum(math.log10((tokens[w] + 1) / (total + distinct + 1)) for w in words)
        return len(words), sum(w in tokens for w in words), total, round(base, 6), round(sum(logp(sym[j - ppm.ORDER : j], sym[j]) for j in range(ppm.ORDER, len(sym))), 6)

    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=key) == sorted(((d, *expected(t)) for d, t in rows), key=key)
    assert sum(10 ** logp([0] * ppm.ORDER, s) for s in range(257)) == pytest.approx(1)
    assert np.count_nonzero(met[0].place >= 0) == min(most, 3) if most < 4 else np.count_nonzero(met[0].place >= 0) > 3
    assert ppm.score(df.limit(0), F.lit(True)).count() == 0


def test_entropy_steps_equal_counting():
    b = np.frombuffer(random.Random(1).randbytes(300) + b"a" * 80 + b"some words and more words " * 9, np.uint8)
    got = fingerprint.entropy_steps(b)
    for i in range(len(got)):
        counts = Counter(b[i : i + fingerprint.WINDOW].tolist()).values()
        assert got[i] == sum(int(fingerprint._GAIN[1 : c + 1].sum()) for c in counts) // fingerprint._STEP


def test_fingerprints_and_neighbours(spark):
    rng = random.Random(8)
    rows = ROWS[:-2] + [(50 + i, " ".join(f"word{rng.randrange(400)}" for _ in range(rng.randint(1, 300)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as t").repartition(4)
    rank = fingerprint.rarities(df)
    texts = [t or "" for _, t in sorted(rows)]
    for size in (1 << 24, 3000):
        old, fingerprint.with_next.__defaults__ = fingerprint.with_next.__defaults__, (size,)
        try:
            got = fingerprint.compare_edited(df, rank).orderBy("doc_id").collect()
        finally:
            fingerprint.with_next.__defaults__ = old
        assert [r["doc_id"] for r in got] == sorted(d for d, _ in rows)
        for r, own, after in zip(got, texts, texts[1:] + texts[:1], strict=True):
            edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(own)
            a, b, c = (fingerprint.digest(x, rank) for x in (own, edited, after))
            assert r["fingerprint"] == fingerprint.to_text(a) and r["edited_fingerprint"] == fingerprint.to_text(b)
            assert r["near_edited"] == fingerprint.likeness(a, b) == fingerprint.likeness(b, a) and r["near_next"] == fingerprint.likeness(a, c)
    long = [r for r in got if r["n_chars"] > 300 and r["doc_id"] >= 50]
    assert np.mean([r["near_edited"] for r in long]) > 0.35 > 0.2 > np.mean([r["near_next"] for r in long])
    one = spark.createDataFrame([(None, "alone and only")], "doc_id long, text string")
    assert fingerprint.compare_edited(one, rank).first()["near_next"] == 1.0
    assert fingerprint.compare_edited(one.limit(0), rank).count() == 0
    f = fingerprint.digest("x y z" * 300, rank)
    assert (fingerprint.from_text(fingerprint.to_text(f)) == f).all()


def test_trees_and_isotonic():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] > 0.5)).astype(float)
    m = boosting.fit_trees(x[:1500], y[:1500])
    assert ((m.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    steps = boosting.fit_isotonic(m.margin(x[:1500]), y[:1500])
    v = steps(np.linspace(-9, 9, 200))
    assert (np.diff(v) >= 0).all() and v[0] < 0.1 and v[-1] > 0.9
    assert boosting.fit_trees(x[:0], y[:0]).margin(x[:2]).shape == (2,)


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain, bad = [f"w{i}" for i in range(300)], ["vilo", "scurn", "drekko"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad).title() + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(None, None), (None, "you " + bad[0]), (5000, ""), (3, "again " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as toxic", "'s' as score")
    known = spark.createDataFrame(labels + [(0, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, known, fits=toxicity.remainder(3) != 1)
    assert model.lexicon.words >= set(bad)
    got = [r for r in toxicity.score(df, model).filter(toxicity.remainder(3) == 1).collect() if r["doc_id"] < 900]
    right = sum((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 5 == 0) for r in got)
    assert right / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    left = toxicity.reject_toxic(df, known)
    assert left.columns == df.columns and left.count() > 690
    none = toxicity.fit(df, known.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score(df.limit(20), none).collect()}.__len__() == 1
    assert toxicity.undone("1d1o0t") == "idioot"[:6] or toxicity.undone("l0ser") == "loser"


def test_long_dull_texts_have_a_feature():
    rank = fingerprint.ranks(np.arange(fingerprint.BINS))
    for pattern in ("a", "abcdefg"):
        short, long = (fingerprint.features((pattern * n)[:n].encode(), rank) for n in (fingerprint.STRETCH, 2 * fingerprint.STRETCH + 999))
        assert len(short) == len(long) == 1 and short[0] == long[0]
        assert len(fingerprint.digest(pattern * fingerprint.STRETCH * 2, rank))


def test_digests_equal_brute_force():
    whole = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & whole
        h = (h ^ h >> 27) * 0x94D049BB133111EB & whole
        return h ^ h >> 31

    rng = random.Random(6)
    rank = fingerprint.ranks(np.array([rng.randrange(1000) for _ in range(fingerprint.BINS)]))
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (96, 130, 700, 800, 3000)] + ["ab" * 700, "x" * 200, "some words, " * 40]
    for text in texts:
        raw = text.encode()
        windows = [raw[i : i + fingerprint.WINDOW] for i in range(len(raw) - fingerprint.WINDOW + 1)]
        rare = [int(rank[sum(int(fingerprint._GAIN[1 : c + 1].sum()) for c in Counter(w).values()) // fingerprint._STEP]) for w in windows]
        share = 1 if len(raw) >= fingerprint.SHORT else 4
        run = 1
        while 2 * run <= min(fingerprint.POPULAR // share, len(windows)):
            run *= 2
        wins = Counter(min(range(i, i + run), key=lambda j: (rare[j], j)) for i in range(len(windows) - run + 1))
        chosen = [i for i in range(len(windows)) if wins[i] >= fingerprint.THRESHOLD // share and rare[i] < fingerprint.BINS] or [min(range(len(windows)), key=lambda j: (rare[j], j))]
        filters = [set() for _ in range(-(-len(chosen) // fingerprint.FEATURES))]
        for n, i in enumerate(chosen):
            h = 0
            for j in range(fingerprint.WINDOW // 8):
                h = mixed(h ^ int.from_bytes(windows[i][8 * j : 8 * j + 8], "little") ^ j + 1)
            filters[n // fingerprint.FEATURES].update(h >> 11 * j & fingerprint.FILTER_BITS - 1 for j in range(fingerprint.HASHES))
        got = [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in fingerprint.digest(text, rank)]
        assert got == filters


def test_neighbours_of_null_and_repeated_ids(spark):
    rows = [*ROWS, (None, "another without an id"), (3, "id again"), (3, "z" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = df.select("*", F.xxhash64("text").alias("h")).collect()
    ordered.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or ""))
    want = []
    for i, r in enumerate(ordered):
        own, after = r["text"] or "", ordered[(i + 1) % len(ordered)]["text"] or ""
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        want.append((str(r["doc_id"]), len(own), hashlib.sha256(edited.encode()).hexdigest()))
    out = fingerprint.compare_edited(df, fingerprint.rarities(df)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == sorted(want)
