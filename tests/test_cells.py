import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import cells, types


def ask(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_classification(spark):
    cases = {"": "empty", " \t": "empty", " 　": "empty", "2024-01-05": "date", "05/01/2024": "date", "99/99/9999": "date", "42": "numeric", "-1,234.56": "numeric", "1.234,56": "numeric", "1,234,567": "numeric", "1,5": "numeric", '"12"': "numeric", ".5": "numeric", ".": "text", "1e5": "text", "+5": "text", "NaN": "text", "abc": "text", "1.2.3": "text", " 7 ": "numeric"}
    got = ask(spark, list(cases), cells.classify(F.col("v")))
    assert [x for (x,) in got] == list(cases.values())


def test_parse_numeric(spark):
    cases = {"1,234.56": 1234.56, "1.234,56": 1234.56, "910,11": 91011.0, '"-5"': -5.0, "1e5": 1e5, "+5": 5.0, "1d": None, "1e400": None, "NaN": None, "": None, "x": None, "1.2.3": None, "-1,000": -1000.0, "1.5f": None}
    got = ask(spark, list(cases), cells.parse_numeric(F.col("v")))
    assert [x for (x,) in got] == list(cases.values())


def numeric(s: str) -> bool:
    """The rules one by one."""
    t = s.removeprefix("-").strip('"')
    digits = lambda x, more="": bool(x) and all(c in "0123456789" + more for c in x)
    us = t.count(".") == 1 and digits(t.split(".")[0], ",") and digits(t.split(".")[1])
    eu = t.count(",") == 1 and digits(t.split(",")[0], ".") and digits(t.split(",")[1])
    parts = t.split(",")
    thousands = len(parts) > 1 and digits(parts[0]) and all(digits(p) and len(p) == 3 for p in parts[1:])
    plain = t.count(".") <= 1 and digits(t.replace(".", "", 1))
    return us or eu or thousands or plain


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text('1,."-a', max_size=7), min_size=40, max_size=60))
def test_numeric_rule_against_its_parts(spark, texts):
    got = ask(spark, texts, cells.is_numeric(F.col("v")))
    assert [x for (x,) in got] == [numeric(t) for t in texts]


def test_header_names_and_merging(spark):
    df = spark.createDataFrame([(["Name", "1"],), (["1", "2.5"],), (["", " "],), (["2024-01-01", "1"],)], "c array<string>")
    assert [r[0] for r in df.select(cells.has_header(F.col("c"))).collect()] == [True, False, False, True]
    assert cells.generated_names(3) == ["column_1", "column_2", "column_3"]
    pairs = [("numeric", "date", "date"), ("text", "empty", "text"), ("empty", "numeric", "numeric")]
    m = spark.createDataFrame(pairs, "a string, b string, c string")
    assert all(r[0] for r in m.select(cells.merge_types(F.col("a"), F.col("b")) == F.col("c")).collect())


@pytest.mark.parametrize(("a", "b", "cast"), [("text", "VARCHAR", False), ("integer", "double", False), ("date", "timestamptz", False), ("numeric", "text", True), ("blob", "blob", False), ("uuid", "text", True)])
def test_needs_cast(spark, a, b, cast):
    assert spark.range(1).select(cells.needs_cast(F.lit(a), F.lit(b))).first()[0] is cast


def test_types(spark):
    names = {"character varying(20)": "varchar", "numeric(10,2)": "numeric", "int4": "integer", "mystery": "mystery"}
    assert [x for (x,) in ask(spark, list(names), types.normalize_database_type(F.col("v")))] == list(names.values())
    assert types.property_type({"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}) == "array[array[integer]]"
    assert types.property_type({"type": "array"}) == "array[text]"
    assert types.spark_type("array<decimal(10,2)>") == "array[numeric]"
    assert re.fullmatch("jsonb", types.spark_type("struct<a:int>"))
