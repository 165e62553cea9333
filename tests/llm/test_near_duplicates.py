import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import components, decontaminate, jaccard_join
from siftwell.llm.shingles import shingle_set


def brute(rows, k, percent):
    """Component of every row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.randint(5, 150))] for _ in range(12)]
    for base in bases:
        for _ in range(rng.randint(1, 9)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 4, 8]))))
    hot = [rng.choice(vocabulary) for _ in range(90)]
    rows += [" ".join(edited(rng, hot, rng.choice([1, 2, 3, 5]))) for _ in range(50)]
    rows += [" ".join([rng.choice(vocabulary) for _ in range(20)] + passage + [rng.choice(vocabulary) for _ in range(20)]) for _ in range(20)]
    rows += ["one", "ONE ", "two words", "two words x", "", None, " \n\t", "a b c d", "a b c d", "A\tb\nC  d"]
    return [(i * 3, t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, "nobody else says this at all"), (9, rows[5])]


@pytest.mark.parametrize(("k", "percent", "hot", "small"), [(4, 85, 500_000, 64), (5, 80, 20, 5), (2, 50, 500_000, 3), (4, 85, 500_000, 2)])
def test_equals_all_pairs(spark, monkeypatch, k, percent, hot, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", 256 if small == 64 else 8)
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kid", "'x' as n").repartition(3)
    got = jaccard_join.near_duplicates(df, k, percent, hot=hot).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, k, percent), key=key)


def test_classes_of_one_name_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CLASS_BITS", 3)
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for got in (jaccard_join.near_duplicates(df, 4, 85), jaccard_join.linked_documents(df, 4, 85).drop("n_links")):
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 4, 85), key=key)


def test_prefixes_of_linking_sets_share_enough():
    rng = np.random.default_rng(1)
    hot = np.sort(rng.integers(0, 2**40, 50).astype(np.uint64))
    levels = rng.integers(2, 12, 50).astype(np.uint8)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    base[:40] = hot[:40] << np.uint64(24)
    met = 0
    for _ in range(400):
        s, t = (np.unique(np.where(rng.random(400) < p, rng.integers(0, 2**63, 400).astype(np.uint64), base)) for p in rng.uniform(0, 0.09, 2))
        both = len(np.intersect1d(s, t))
        if 100 * both >= 85 * (len(s) + len(t) - both):
            (a, m), (b, n) = (jaccard_join.prefix(x, 85, hot, levels, 40) for x in (s, t))
            assert len(np.intersect1d(a, b)) >= min(m, n)
            met += 1
    assert met > 50


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(3, "the same words here again"), (1, "the same words here again"), (2, ""), (None, "the same words here again")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in jaccard_join.keep_one(df).collect()) == ["1", "2", "None"]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    assert len(shingle_set("a b c", 5)) == 1 and not len(shingle_set(" \n", 5))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 99), (101, 99)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (99, 100, 101)} == {99}


def test_components_leave_one_table(spark, monkeypatch, tmp_path):
    """Rounds are deleted, and the result can be read again and again."""
    made = []
    monkeypatch.setattr(components, "work_dir", lambda _: made.append(f"file://{tmp_path}/{len(made)}") or made[-1])
    found = components.components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(7, 7)], "a long, b long"))
    assert len(made) > 3 and [p.name for p in tmp_path.iterdir()] == [made[-1].rsplit("/", 1)[1]]
    assert found.count() == 21 == found.filter("root = 0").count()
    assert components.components(found.limit(0).selectExpr("node as a", "root as b")).count() == 0


def windows(text, item, weights, rare, k, percent):
    """Best weighted similarity of the item with any window of its size, if it reaches the threshold."""
    words = lambda t: [w.strip(decontaminate._EDGE) or w for w in (t or "").encode().lower().split()]
    x, y = words(text), words(item)
    n = min(k, len(y))
    grams = lambda z: {tuple(z[i : i + n]) for i in range(len(z) - n + 1)}
    mass = lambda s: sum(weights.get(g, rare) for g in s)
    best = 0.0
    for i in range(len(x) - len(y) + 1) if y else ():
        a, b = grams(x[i : i + len(y)]), grams(y)
        if 100 * mass(a & b) >= percent * mass(a | b):
            best = max(best, mass(a & b) / mass(a | b))
    return best


@pytest.mark.parametrize("probe", [False, True])
def test_contaminations_equal_all_windows(spark, monkeypatch, probe):
    if probe:
        monkeypatch.setattr(decontaminate, "SCAN", 0)
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([12, 12, 20, 31, 45, 3, 1])] + [(7, ""), (8, None)]
    items.append((9, items[0][1].upper()))
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) + "x" for _ in range(rng.randint(0, 80))]
        item = rng.choice(items[:6])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        at = rng.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + item + words[at:]) + rng.choice(["", "."])))
    docs += [(100, None), (101, ""), (102, items[3][1] + " " + items[4][1]), (None, items[2][1])]
    k = 5
    count = Counter()
    for _, t in items:
        y = (t or "").encode().lower().split()
        n = min(k, len(y))
        count.update({tuple(y[i : i + n]) for i in range(len(y) - n + 1)} if y else set())
    rare = round(1024 * np.log(1 + len(items)))
    weights = {g: round(1024 * np.log(1 + len(items) / c)) for g, c in count.items()}
    want = {(d, i): round(s, 9) for d, t in docs for i, u in items if (s := windows(t, u, weights, rare, k, 80))}
    matcher = decontaminate.Matcher(items, k, 80)
    got = {(d, i): round(v[0], 9) for d, t in docs for i, v in matcher.find(t).items()}
    assert got == want and len(want) > 20
    if not probe:
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
        bench = spark.createDataFrame(items, "item_id long, text string")
        rows = decontaminate.contaminations(df, bench).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == set(want)
        left = decontaminate.drop_contaminated(df, bench)
        assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
        assert decontaminate.contaminations(df, bench.limit(0)).count() == 0 and decontaminate.contaminations(df.limit(0), bench).count() == 0


def test_document_with_fewer_words_than_the_item(spark):
    items = [(1, " ".join(f"a{i}" for i in range(50))), (2, " ".join(f"b{i}" for i in range(50, 110))), (3, "c d e f g h")]
    own = {i: t.split() for i, t in items}
    docs = [(1, " ".join(own[1][:49])), (2, " ".join(own[1][3:])), (3, " ".join(own[2][:20] + own[2][21:])), (4, " ".join(own[2][:30])), (5, "c d e f g"), (6, "c d e f"), (7, " ".join(own[1]))]

    def similarity(x, y):
        grams = lambda z: {tuple(z[i : i + 5]) for i in range(len(z) - 4)}
        return len(grams(x) & grams(y)) / len(grams(x) | grams(y))

    want = {(d, i): round(s, 9) for d, t in docs for i in own if (s := similarity(t.split(), own[i])) >= 0.8}
    assert set(want) == {(1, 1), (2, 1), (3, 2), (7, 1)}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminations(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows} == want
    assert {(r["doc_id"], r["start_word"], r["n_words"]) for r in rows} == {(1, 0, 49), (2, 0, 47), (3, 0, 59), (7, 0, 50)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()} == {4, 5, 6}


def test_weights_do_not_depend_on_blocks_of_items(spark):
    rng = random.Random(8)
    draw = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(500)) for _ in range(n)]
    phrase, other = draw(18), draw(16)
    items = [(i, " ".join((phrase if i % 3 else other) + draw(6 + i % 2))) for i in range(40)] + [(40, None), (41, "")]
    docs = [" ".join(draw(9) + t.split()[: 24 - i % 7] + draw(9)) for i, t in items[:40]] + [" ".join(draw(5) + phrase + draw(6) + other + draw(7)), " ".join(phrase + draw(2))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.Matcher(items, 5, 80)
    want = {(d, i): v for d, t in enumerate(docs) for i, v in whole.find(t).items()}
    for size in (10**6, 900, 300, 1):
        blocks = decontaminate.matchers(bench, 5, 80, "item_id", "text", item_bytes=size)
        assert (len(blocks) > 1) == (size < 10**6)
        assert {m.rare for m in blocks} == {whole.rare}
        got = {(d, m.names[i]): v for m in blocks for d, t in enumerate(docs) for i, v in m.find(t).items()}
        assert got == want and want


def test_keep_one_of_repeated_and_null_ids(spark):
    say = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(1, say("a"), "x"), (5, say("a"), "x"), (5, say("b"), "x"), (5, "", "x"), (5, "", "x")]
    rows += [(7, say("c"), "x")] * 3 + [(7, say("c") + " more", "x"), (8, say("c"), "y")]
    rows += [(None, say("d"), "x"), (None, say("d"), "x"), (None, say("d") + " more", "x"), (None, say("e"), "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], (r["text"] or "")[:1]) for r in out.collect())
    assert got == {(1, "a"): 1, (5, "b"): 1, (5, ""): 2, (7, "c"): 1, (None, "d"): 1, (None, "e"): 1, (None, ""): 1}


@pytest.mark.parametrize(("k", "percent", "small", "block"), [(4, 85, 64, 256), (2, 50, 3, 8)])
def test_all_links_and_their_numbers(spark, monkeypatch, k, percent, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(k)
    sets = [frozenset(shingle_set(t, k).tolist()) for _, t in rows]
    linked = [[i != j and bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y) for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = [(*r, sum(own)) for r, own in zip(brute(rows, k, percent), linked, strict=True)]
    assert sorted(map(tuple, jaccard_join.linked_documents(df, k, percent).collect()), key=key) == sorted(want, key=key)
    kid = [jaccard_join.class_id(np.array(sorted(s), np.uint64)) if s else None for s in sets]
    pairs = {(min(kid[i], kid[j]), max(kid[i], kid[j])) for i, own in enumerate(linked) for j, met in enumerate(own) if met and kid[i] != kid[j]}
    got = [tuple(r) for r in jaccard_join.class_links(df, k, percent)[1].collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 30
