import random
import re
import struct
import zlib

import pytest
import xxhash

from siftwell.llm import sharding, url_filter
from siftwell.llm.url_filter import UrlRule


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_every_row_once_with_exact_quotas_and_gapless_slots(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1003)] + [(None, None), (None, "null id"), (7, "again"), (7, "again")]
    out = sharding.shard(docs(spark, rows).selectExpr("*", "1 as arc", "2 as cell"), 8).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1 and len(sizes) == 8


def test_same_rows_same_places_and_limited_movement(spark):
    df = docs(spark, [(i, str(i)) for i in range(4000)])
    place = lambda n, slack: {r["doc_id"]: r["shard"] for r in sharding.shard(df, n, slack=slack).collect()}
    a, again, more = place(8, 0.25), place(8, 0.25), place(9, 0.25)
    assert a == again
    assert sum(a[i] != more[i] for i in a) < 0.25 * len(a)
    points = sharding.ring(8, 64)
    counts = [0] * 8
    for s in a.values():
        counts[s] += 1
    assert max(counts) <= 1.25 * len(a) / 8 + 1
    assert sum(s == counts.index(max(counts)) for s in a.values()) == max(counts) and len(points) == 512


def test_walk_moves_overflow_clockwise():
    assert sharding.walk([0, 1, 2], [5, 0, 1], [2, 2, 2]) == [(0, 0, 2, 0, 0), (2, 0, 1, 2, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1)]


def test_empty_tables(spark):
    assert sharding.shard(docs(spark, []), 8).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, url_filter.RULES, keep=["page_id"]).count() == 0


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.name), r.verdict, r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_urls_against_all_rules_tried(spark):
    rng = random.Random(3)
    hosts = ["example.com", "www.example.com", "A.Example.com", "b.net", "net", "example.org", "xexample.com", ""]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/es/y', '/fr', '/fr/z/en/'])}{rng.choice(['', '?a=/en/', '#t', '?x#y'])}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "://", "http://", "http://example.com/en/\nline", "HTTP://b.net/es/ü", "x" * 100_000, "http://c.com/" + "a/" * 20_000]
    rules = [*url_filter.RULES, UrlRule("c.com", "/a/a/", "block"), UrlRule("b.net", "/es", "allow"), UrlRule("example.org", "", "block"), UrlRule("b.net", "/fr/(z)/", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    for inline in (True, False):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, keep=["page_id"], inline=inline).collect()}
        assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_wildcards_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/ads/1/banner"), (2, "http://a.com/ads/1")], "page_id long, url string")
    got = url_filter.judge_urls(pages, [UrlRule("a.com", "/ads/*/banner", "block")], keep=["page_id"]).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "allow"}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, [], keep=["page_id"]).collect()} == {"allow"}


@pytest.mark.parametrize(("shards", "slack"), [(8, 0.0), (3, 0.25)])
def test_ring_equals_a_walk_row_by_row(spark, shards, slack):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(400)] + [(None, "x"), (None, "x"), (None, None), (7, "again"), (7, "again"), (500, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.shard(df, shards, slack=slack).collect())

    # every row by itself: its point, its place in ring order, and from there clockwise to a shard with room
    points = sharding.ring(shards, 64)
    capacity = sharding.bounds(len(rows), shards, slack)
    bits = max(10, (len(rows) // sharding.CELL_ROWS).bit_length() + 1)
    held = []
    for d, t in rows:
        raw = (t or "").encode()
        at = (42 if d is None else xxhash.xxh64_intdigest(struct.pack("<q", d), seed=42)) >> (64 - sharding.RING_BITS)
        before = [i for i, (p, _) in enumerate(points) if p <= at]
        arc = before[-1] if before else len(points) - 1
        crc = zlib.crc32(raw)
        held.append((arc, not before, at >> (sharding.RING_BITS - bits), crc % sharding.SUBCELLS, at, d is not None, d or 0, crc, len(raw) + 1, d))
    held.sort(key=lambda h: h[:9])
    filled, placed, left = [0] * shards, [], []

    def put(h, shard):
        placed.append((-1 if h[9] is None else h[9], h[7], h[8], shard, filled[shard]))
        filled[shard] += 1

    for h in held:
        owner = points[h[0]][1]
        if filled[owner] < capacity[owner]:
            put(h, owner)
        else:
            left.append(h)
    for h in left:
        arc = h[0]
        while filled[points[arc][1]] >= capacity[points[arc][1]]:
            arc = (arc + 1) % len(points)
        put(h, points[arc][1])
    assert got == sorted(placed)


def test_rows_of_the_null_key_are_spread_over_more_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 8)
    rows = [(None, f"text {i}") for i in range(300)] + [(None, "same")] * 5 + [(i, "t") for i in range(96)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect()
    assert sorted((str(r["doc_id"]), r["text_crc32"]) for r in got) == sorted((str(d), zlib.crc32(t.encode())) for d, t in rows)
    slots: dict = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len(slots) == 8 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
