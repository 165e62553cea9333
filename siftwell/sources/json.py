"""JSON array and NDJSON sources: documents become variants, their fields rows, and the rows one profile plan."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions import cells
from siftwell.operators.profile import top_values, tracked
from siftwell.options import ProfileOptions
from siftwell.sources.files import heads, remove, scratch

DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def detect_format(data: bytes) -> str:
    lead = data.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")[:1]
    if not lead:
        raise ValueError("empty input")
    return "json" if lead == b"[" else "ndjson"


def number_text(d: Column) -> Column:
    """A double as contracts show it: whole numbers in full, others by their shortest digits, with an exponent below
    0.0001 and from a million on (1e-07, 1.23456785e+07). Whole numbers from 2**63 on may differ in their last digits."""
    size = F.abs(d)
    whole = F.when(size < 9.2e18, d.cast("bigint").cast("string")).otherwise(F.format_string("%.0f", d))
    # what is left is below 0.001, with an exponent, or from a million on, with or without one
    shown = size.cast("string")
    mantissa = F.substring_index(shown, "E", 1)
    before, after = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    power = F.when(F.contains(shown, F.lit("E")), F.substring_index(shown, "E", -1).cast("int")).otherwise(F.length(before) - 1)
    digits = F.rtrim(F.concat(before, after), F.lit("0"))
    tail = F.substring(digits, 2, 400)
    powered = F.concat(F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    small = F.concat(F.lit("0.000"), digits)
    text = F.when((size >= 0.0001) & (size < 0.001), small).otherwise(powered)
    # from 0.001 to a million a double's own text is the one that is asked for
    return F.when(d == F.rint(d), whole).when((size >= 0.001) & (size < 1e6), d.cast("string")).otherwise(F.concat(F.when(d < 0, "-").otherwise(""), text))


def dense_index(df: DataFrame, name: str = "idx", sizes: dict[int, int] | None = None) -> DataFrame:
    """Numbers from 0 in the order of the partitions. Only the partitions' sizes come to the driver, unless they are given."""
    numbered = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    if sizes is None:
        sizes = {r["p"]: r["n"] for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    start = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), part.cast("int"))
    return numbered.withColumn(name, start + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def key_index(df: DataFrame, key: str, name: str = "idx", bits: int = 12) -> DataFrame:
    """Numbers from 0 in ascending order of an integer key that has no repeats: within ranges of 2**bits keys, then by
    what the ranges before hold. No task sorts more than a range's rows; one sums a row for each range."""
    at = F.shiftright(key, bits)
    ranges = df.groupBy(at.alias("__range")).agg(F.count("*").alias("__held"))
    ranges = ranges.select("__range", (F.sum("__held").over(W.orderBy("__range")) - F.col("__held")).alias("__before"))
    within = df.withColumn("__range", at).withColumn("__within", F.row_number().over(W.partitionBy("__range").orderBy(key)) - 1)
    return within.join(ranges, "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__before", "__within")


def parsed_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(line_idx, v, bad) for the lines that aren't blank; bad: neither an object nor null, and v is null."""
    rows = lines.select(cells.trimmed(F.regexp_replace(F.col(line), r"\A\x{FEFF}", "")).alias("text"))
    # beside the index, which no filter passes, each line is parsed once; its first character tells what it can be
    v = F.when(F.substring("text", 1, 1).isin("{", "n"), F.try_parse_json("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("line_idx"), v.alias("v"), (F.col("text") == "").alias("blank"))
    return rows.filter("not blank").select("line_idx", "v", F.col("v").isNull().alias("bad"))


def array_elements(text: str) -> Iterator[tuple[str | None, str | None]]:
    """(element, None) up to the first that is no object, then (None, what is wrong with that one). Nothing for a blank text."""
    if not text.strip("\ufeff \t\r\n"):
        return
    decoder, at, n = json.JSONDecoder(), text.index("[") + 1, 0
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] == "]":
            return
        try:
            value, stop = decoder.raw_decode(text, at)
        except ValueError as e:
            yield None, f"row {n + 1}: {e}"
            return
        if value is not None and not isinstance(value, dict):
            yield None, f"row {n + 1}: not an object"
            return
        n += 1
        yield text[at:stop], None
        at = stop


def parsed_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(idx, v) of the elements and the issues, of all files below a path; an array can't be split, so a file is a task."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column("file").to_pylist(), batch.column("value"), strict=True):
                found = enumerate(array_elements(value.as_py()))
                while part := list(islice(found, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([i for i, _ in part]), pa.array([x for _, (x, _) in part], pa.string()), pa.array([y for _, (_, y) in part], pa.string())], ["file", "i", "text", "issue"])

    each = files.mapInArrow(run, "file string, i bigint, text string, issue string")
    if len(files.inputFiles()) > 1:
        each = each.orderBy("file", "i")
    rows = dense_index(each.filter("issue is null").select("text"))
    return rows.select("idx", F.try_parse_json("text").alias("v")), each.filter("issue is not null").select("issue")


def field_cells(rows: DataFrame) -> DataFrame:
    """(idx, field, kind, value) for every key of the objects in (idx, v); value is null where the key's is, texts are as
    they are, numbers by number_text(), nested values as JSON."""
    each = rows.select("idx", "v").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).filter("key is not null")
    # the JSON of a value is made once, and its first character tells the type
    each = each.select("idx", F.col("key").alias("field"), F.col("value").alias("x"), F.to_json("value").alias("j"))
    lead = F.substring("j", 1, 1)
    kind = F.when(F.col("j").isNull() | (lead == "n"), "null").when(lead == '"', "text").when(lead.isin("t", "f"), "boolean").when(lead == "{", "object").when(lead == "[", "array").otherwise("numeric")
    each = each.select("idx", "field", "x", "j", kind.alias("kind"))
    each = each.select("idx", "field", "kind", "j", F.when(F.col("kind") == "text", F.try_variant_get("x", "$", "string")).alias("s"), F.when(F.col("kind") == "numeric", F.try_variant_get("x", "$", "double")).alias("d"))
    value = F.when(F.col("kind") == "numeric", number_text(F.col("d"))).when(F.col("kind") == "text", F.col("s")).when(F.col("kind") != "null", F.col("j"))
    return each.select("idx", "field", "kind", value.alias("value"))


def json_profile(rows: DataFrame, options: ProfileOptions = ProfileOptions(), n_rows: int | None = None, folder: str | None = None) -> DataFrame:
    """A row for each key: data_type, total_count from the row that first has it, null_count, range, top_values.

    rows: (idx, v) with a dense idx. Missing keys count as null from there on. n_rows: how many rows there are, where that
    is known. folder: where to write the grouped values, so that the rows are read once.
    """
    n_rows = rows.count() if n_rows is None else n_rows
    ranks = cells.rank_of(F.col("kind"), cells.JSON_TYPES)
    groups = field_cells(rows).withColumn("rank", ranks).groupBy("field", "value").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("rank").alias("rank"))
    if folder:
        groups.write.parquet(folder)
        groups = rows.sparkSession.read.schema(groups.schema).parquet(folder)
    # a list among the aggregates, an empty one, keeps minima of texts from being aggregated by sorting, as in profile
    none = F.size(F.collect_list(F.lit(None).cast("int")))
    stats = groups.groupBy("field").agg(
        F.min("first_idx").alias("first_idx"),
        (F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)) + none).alias("known"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("rank"))), F.lit(0)).alias("rank"),
    )
    total = F.lit(n_rows).cast("long") - F.col("first_idx")
    stats = stats.select("field", "first_idx", cells.type_of(F.col("rank"), cells.JSON_TYPES).alias("data_type"), total.alias("total_count"), (total - F.col("known")).alias("null_count"), (F.round((total - F.col("known")) / total * 10000) / 100).alias("null_percentage"), "min_value", "max_value")
    top = top_values(tracked(groups.select("field", "value", "n", "first_idx"), options.max_tracked), options.top_n).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("top_values"))
    return stats.join(top, "field", "left").withColumn("top_values", F.coalesce("top_values", F.expr("cast(array() as array<struct<value:string,count:bigint>>)")))


def analyze_json(spark: SparkSession, path: str, options: ProfileOptions = ProfileOptions()) -> dict:
    """The source contract of a JSON array or NDJSON file."""
    kind = detect_format(next((x for x in heads(spark, path) if x.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")), b""))
    was = spark.conf.get(DUPLICATE_KEYS, "false")
    spark.conf.set(DUPLICATE_KEYS, "true")
    folder = scratch(spark)
    try:
        if kind == "json":
            rows, wrong = parsed_arrays(spark, path)
            issues = [r["issue"] for r in wrong.collect()]
            rows = rows.filter(F.col("idx") < options.max_rows) if options.max_rows else rows
            total = rows.count()
        else:
            lines = parsed_lines(spark.read.option("lineSep", "\n").text(path))
            held = lines.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count("v").alias("good")).collect()
            total = sum(r["good"] for r in held)
            bad = dense_index(lines.select("bad"), "place", {r["p"]: r["n"] for r in held}).filter("bad").select("place")
            places = sorted(bad.toArrow().column(0).to_pylist()) if total < sum(r["n"] for r in held) else []
            # a line's number counts the rows before it; lines after the last row that is read aren't looked at
            numbers = (place - k + 1 for k, place in enumerate(places))
            issues = [f"line {n}: invalid JSON object" for n in numbers if not options.max_rows or n <= options.max_rows]
            rows = dense_index(lines.filter("not bad").select("v"), sizes={r["p"]: r["good"] for r in held})
            if options.max_rows:
                rows, total = rows.filter(F.col("idx") < options.max_rows), min(total, options.max_rows)
        found = sorted(json_profile(rows, options, total, folder).collect(), key=lambda r: (r["first_idx"], r["field"]))
        shown = rows.select("idx", F.to_json("v").alias("j"))
        # lines are numbered in the order of the partitions, in which a limit at the end of a plan takes them
        sample = (shown.orderBy("idx") if kind == "json" else shown).limit(options.max_sample_rows).collect()
    finally:
        spark.conf.set(DUPLICATE_KEYS, was)
        remove(spark, folder)
    show = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x)
    keys = [r["field"] for r in found]
    fields = [{"name": r["field"], "data_type": r["data_type"], "profile": {c: r[c] for c in ("total_count", "null_count", "null_percentage", "min_value", "max_value")} | {"top_values": [x.asDict() for x in r["top_values"]]}} for r in found]
    data = [[show((json.loads(s["j"]) or {}).get(k)) for k in keys] for s in sample]
    return {"contract_type": "source", "source_format": kind, "source_path": path, "encoding": "utf-8", "total_rows": total, "fields": fields, "sample_data": data, "issues": issues}

