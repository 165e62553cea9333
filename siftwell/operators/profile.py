"""Column profiles: one unpivot, one grouping by (field, value), then small aggregations over that grouping.

The grouping combines on the map side and is the only shuffle of data size. Ranks per field keep a limited number of
rows, so that Spark filters them before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions import cells
from siftwell.options import ProfileOptions


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Ascending in the order of the scan, not dense."""
    return df.withColumn(name, F.monotonically_increasing_id())


def unpivot(df: DataFrame, columns: Sequence[str], row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, pos, field, value) with a row for each cell."""
    each = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)]
    return df.select(row_idx, F.inline(F.array(*each)))


def group_values(long: DataFrame, blank_is_null: bool = True) -> DataFrame:
    """(pos, field, value, n, first_idx); null cells are one group of each field."""
    value = F.when(~cells.is_blank(F.col("value")), F.col("value")) if blank_is_null else F.col("value")
    return long.withColumn("value", value).groupBy("pos", "field", "value").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_idx"))


def tracked(groups: DataFrame, max_tracked: int) -> DataFrame:
    """Of each field the values that a bounded counter would hold: those seen first."""
    seen = W.partitionBy("field").orderBy("first_idx", "value")
    return groups.filter("value is not null").withColumn("__k", F.row_number().over(seen)).filter(F.col("__k") <= max_tracked).drop("__k")


def top_values(groups: DataFrame, top_n: int) -> DataFrame:
    """(field, rank, value, n) by count, then value."""
    best = W.partitionBy("field").orderBy(F.desc("n"), "value")
    return groups.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n).select("field", "rank", "value", "n")


def field_stats(groups: DataFrame, numeric_range: bool = True, round_to: int | None = 2) -> DataFrame:
    """Per field counts, range, distinct values and merged type.

    numeric_range: the range is by number where every value is one, and shows the first text of the extreme number.
    """
    known = F.col("value").isNotNull()
    kind = cells.rank_of(cells.classify(F.col("value")))
    # each value is read once, below the aggregation
    parsed = groups.select("pos", "field", "value", "n", "first_idx", kind.alias("kind"), *([cells.parse_numeric(F.col("value")).alias("number")] if numeric_range else []))
    numbers = []
    if numeric_range:
        number = F.col("number")
        first, last = F.struct(number, F.col("first_idx")), F.struct(number, -F.col("first_idx"))
        numbers = [
            F.min_by("value", F.when(number.isNotNull(), first)).alias("num_min"),
            F.max_by("value", F.when(number.isNotNull(), last)).alias("num_max"),
            F.bool_and(F.when(known, number.isNotNull())).alias("all_numbers"),
        ]
    # minima of texts alone would be aggregated by sorting all values; with a list among the aggregates, an empty one,
    # the few groups are kept in a hash table instead
    none = F.size(F.collect_list(F.lit(None).cast("int")))
    out = parsed.groupBy("pos", "field").agg(
        F.sum("n").alias("total_count"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("null_count"),
        (F.count("value") + none).alias("distinct_count"),
        F.min("value").alias("lex_min"),
        F.max("value").alias("lex_max"),
        F.max("kind").alias("rank"),
        *numbers,
    )
    if not numeric_range:
        out = out.withColumns({"num_min": F.lit(None).cast("string"), "num_max": F.lit(None).cast("string")})
    by_number = F.col("all_numbers") if numeric_range else F.lit(False)
    share = F.when(F.col("total_count") > 0, F.col("null_count") / F.col("total_count") * 100).otherwise(0.0)
    return out.select(
        "pos",
        "field",
        cells.type_of(F.col("rank")).alias("data_type"),
        "total_count",
        "null_count",
        (F.round(F.col("null_count") / F.col("total_count") * 10000) / 100 if round_to is not None else share).alias("null_percentage"),
        "distinct_count",
        F.when(by_number, F.col("num_min")).otherwise(F.col("lex_min")).alias("min_value"),
        F.when(by_number, F.col("num_max")).otherwise(F.col("lex_max")).alias("max_value"),
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None, options: ProfileOptions = ProfileOptions(), blank_is_null: bool = True, numeric_range: bool = True, round_to: int | None = 2, cap_distinct: bool = True, row_idx: str | None = None) -> DataFrame:
    """One row for each column of `df`, with top_values as an array of (value, count).

    Columns of an empty frame have no cells and so no row; callers fill them in.
    """
    columns = list(columns if columns is not None else [c for c in df.columns if c != row_idx])
    indexed = df if row_idx else with_row_index(df)
    groups = group_values(unpivot(indexed, columns, row_idx or "row_idx").withColumnRenamed(row_idx or "row_idx", "row_idx"), blank_is_null)
    stats = field_stats(groups, numeric_range, round_to)
    if cap_distinct:
        stats = stats.withColumn("distinct_count", F.least("distinct_count", F.lit(options.max_tracked).cast("long")))
    top = top_values(tracked(groups, options.max_tracked), options.top_n)
    top = top.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("top_values"))
    return stats.join(top, "field", "left").withColumn("top_values", F.coalesce("top_values", F.expr("cast(array() as array<struct<value:string,count:bigint>>)")))


def merge_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groupings of two sets of rows, the first before the second, as one: counts add up, the first place stays; places
    of the second set come after all of the first."""
    last = a.agg(F.max("first_idx").alias("last")).first()["last"]
    both = a.unionByName(b.withColumn("first_idx", F.col("first_idx") + F.lit(0 if last is None else last + 1)))
    return both.groupBy("pos", "field", "value").agg(F.sum("n").alias("n"), F.min("first_idx").alias("first_idx"))


def sample_rows(df: DataFrame, n: int, row_idx: str = "row_idx") -> DataFrame:
    return df.orderBy(row_idx).limit(n)
