"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is compiled to one regular expression over host + path. It is filed under the one of its
literal tokens (host labels, whole path segments) that the fewest URLs of the table hold. A URL's
tokens fetch the rules filed under them, and only those candidates run their regular expressions;
the longest rule that fits decides.

Up to MAX_INLINE rules the index is a constant inside the projection: an array of hash buckets that
is part of the plan, so that there is no shuffle, no join and no skew whatever host is frequent. Larger
rule sets go through a join on the token, salted because a token such as a common suffix may stand in a
third of all URLs.

Null, empty or unparsable URLs have an empty host and path, no rule and the default verdict. Repeated
rows are judged one by one; further columns are neither read nor returned unless asked for with `keep`.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import table

MAX_INLINE = 5_000
SALTS = 32
ANY = "*"
_RULE = "struct<rule:string,verdict:string,regex:string,size:int>"


@dataclass(frozen=True)
class UrlRule:
    """`host` with all its subdomains and every path that starts with `path`; `*` in a path stands for any text."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        path = ".*".join(_quote(x) for x in self.path.split("*"))
        host = rf"(?:[^/]*\.)?{_quote(self.host)}(?=/|\z)" if self.host else "[^/]*"
        return rf"(?s)\A{host}{path}"

    @property
    def tokens(self) -> list[str]:
        """Literals that every fitting URL holds as whole tokens; the last path segment may be a part of one."""
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        segments = [f"p:{x}" for x in self.path.split("/")[:-1] if x and "*" not in x]
        return labels + segments or [ANY]


def _quote(literal: str) -> str:
    """For Java and Python alike."""
    return re.sub(r"([^\w/])", r"\\\1", literal, flags=re.ASCII)


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(ANY))))


def rarest_tokens(tokens: DataFrame, rules: Sequence[UrlRule]) -> dict[UrlRule, str]:
    """For each rule its token in the fewest rows of `tokens` (column tokens). At most as many counts as the rules
    have tokens come to the driver, which holds the rules themselves."""
    known = sorted({t for r in rules for t in r.tokens})
    if len(rules) <= MAX_INLINE:
        wanted = F.from_json(F.lit(json.dumps(known)), "array<string>")
        one = tokens.select(F.explode(F.array_intersect("tokens", wanted)).alias("token"))
    else:
        spark = tokens.sparkSession
        one = tokens.select(F.explode("tokens").alias("token")).groupBy("token").count()
        one = one.join(spark.createDataFrame([(t,) for t in known], "token string"), "token")
        counts = {r["token"]: r["count"] for r in one.collect()}
        return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) for r in rules}
    counts = {r["token"]: r["count"] for r in one.groupBy("token").count().collect()}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) for r in rules}


def _entry(r: UrlRule) -> dict:
    return {"rule": r.name, "verdict": r.verdict, "regex": r.regex, "size": len(r.name)}


def judge_urls(df: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow", keep: Sequence[str] = (), inline: bool | None = None) -> DataFrame:
    """Columns `keep` with host, path, rule (null if none fits) and verdict, one row for each row of `df`.

    inline: whether the index stands in the plan; by default up to MAX_INLINE rules.
    """
    rules = sorted(set(rules), key=lambda r: (r.name, r.verdict))
    host, path = url_parts(url)
    parsed = df.select(*keep, host.alias("host"), path.alias("path"))
    if not rules:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    with_tokens = parsed.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    index = rarest_tokens(with_tokens.select("tokens"), rules)
    if inline is None:
        inline = len(rules) <= MAX_INLINE
    return (_inline if inline else _joined)(with_tokens, index, default, keep)


def _best(found: Column) -> Column:
    """The longest rule; among equals a block before an allow."""
    return F.array_max(F.transform(found, lambda c: F.struct(c["size"].alias("size"), c["verdict"].alias("verdict"), c["rule"].alias("rule"))))


def _inline(df: DataFrame, index: dict[UrlRule, str], default: str, keep: Sequence[str]) -> DataFrame:
    n = 1 << max(4, (2 * len(index)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for rule, token in index.items():
        buckets[zlib.crc32(token.encode()) % n].append({"token": token} | _entry(rule))
    held = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<token:string,{_RULE[7:]}>>")
    fetch = lambda t: F.filter(F.get(held, F.crc32(t.cast("binary")) % n), lambda c: c["token"] == t)
    out = df.withColumn("candidates", F.flatten(F.transform("tokens", fetch)))
    out = out.withColumn("best", _best(F.filter("candidates", lambda c: F.rlike(F.concat("host", "path"), c["regex"]))))
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _joined(df: DataFrame, index: dict[UrlRule, str], default: str, keep: Sequence[str]) -> DataFrame:
    """Each host and path is judged once; tokens and rules meet on (token, salt)."""
    spark: SparkSession = df.sparkSession
    filed = spark.createDataFrame([(t, _entry(r)) for r, t in index.items()], f"token string, c {_RULE}")
    filed = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    urls = df.select("host", "path", "tokens").dropDuplicates(["host", "path"])
    asked = urls.select("host", "path", F.explode("tokens").alias("token"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    found = asked.join(filed, ["token", "salt"]).filter(F.rlike(F.concat("host", "path"), F.col("c.regex")))
    found = found.groupBy("host", "path").agg(F.max(F.struct("c.size", "c.verdict", "c.rule")).alias("best"))
    out = df.join(found, ["host", "path"], "left")
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES, keep=["page_id"])


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), j AS (
  SELECT p.*, (SELECT max_by({'rule': rhost || rpath, 'verdict': rverdict}, length(rhost || rpath)) FROM r
               WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM j
"""
