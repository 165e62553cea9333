"""Queries over whole sources: files, workbooks, specifications and catalogs written from the tables, their contracts as
rows, and the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

import io
import json as J
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import cells
from siftwell.operators import verify
from siftwell.sources import csv, json, specs, tables, xlsx
from siftwell.sources.files import put, scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _customers(spark: SparkSession, sf_dir: str) -> dict:
    """The contract of customers written as a folder of CSV files, each with a header."""
    segment = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment"))
    joined = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")), "yyyy-MM-dd")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias(" name"), _money("c_acctbal").alias("balance"), segment.alias("segment"), joined.alias("joined"))
    folder = scratch(spark)
    rows.repartition(3, "key").write.options(header=True, ignoreLeadingWhiteSpace=False).csv(folder)
    return csv.analyze_csv(spark, folder)


def csv_contract_customer(spark, sf_dir):
    fields = _customers(spark, sf_dir)["fields"]
    shown = ("total_count", "null_count", "distinct_count", "min_value", "max_value")
    rows = [(f["name"], f["data_type"], *(f["profile"][c] for c in shown), f["profile"]["top_values"][0]["value"] if f["name"] == "segment" else None) for f in fields]
    return spark.createDataFrame(rows, "field string, data_type string, total_count long, null_count long, distinct_count long, min_value string, max_value string, top_value string")


_CUSTOMER_SQL = """
WITH c AS (SELECT c_custkey AS key, c_name AS name, cast(c_acctbal AS decimal(18,2)) AS balance, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment,
                  strftime(date '2020-01-01' + cast(c_custkey % 900 AS integer), '%Y-%m-%d') AS joined FROM customer)
SELECT 'key' AS field, 'numeric' AS data_type, count(*) AS total_count, cast(0 AS bigint) AS null_count, least(count(DISTINCT key), 10000) AS distinct_count, cast(min(key) AS varchar) AS min_value, cast(max(key) AS varchar) AS max_value, cast(NULL AS varchar) AS top_value FROM c
UNION ALL SELECT ' name', 'text', count(*), 0, least(count(DISTINCT name), 10000), min(name), max(name), NULL FROM c
UNION ALL SELECT 'balance', 'numeric', count(*), 0, least(count(DISTINCT balance), 10000), cast(min(balance) AS varchar), cast(max(balance) AS varchar), NULL FROM c
UNION ALL SELECT 'segment', 'text', count(*), count(*) - count(segment), count(DISTINCT segment), min(segment), max(segment), (SELECT segment FROM c WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1) FROM c
UNION ALL SELECT 'joined', 'date', count(*), 0, count(DISTINCT joined), min(joined), max(joined), NULL FROM c
"""


def csv_dialects(spark, sf_dir):
    """A file of numbers with decimal commas and no header, and one of tabs in Latin-1."""
    folder = scratch(spark)
    amount = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey").cast("string")).otherwise(F.translate(_money("s_acctbal"), ".", ","))
    numbers = read(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", amount.alias("amount"), "s_nationkey")
    numbers.coalesce(1).write.option("sep", ";").csv(f"{folder}/numbers")
    accents = read(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("é")).alias("naïve"))
    accents.coalesce(1).write.options(sep="\t", header=True, encoding="ISO-8859-1").csv(f"{folder}/accents")
    rows = []
    for name in ("numbers", "accents"):
        c = csv.analyze_csv(spark, f"{folder}/{name}")
        rows += [(name, c["encoding"], c["delimiter"], c["has_header"], f["name"], f["data_type"], f["profile"]["total_count"], f["profile"]["min_value"], f["profile"]["max_value"]) for f in c["fields"]]
    return spark.createDataFrame(rows, "file string, encoding string, delimiter string, has_header boolean, field string, data_type string, total_count long, min_value string, max_value string")


_DIALECTS_SQL = """
WITH s AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN cast(s_nationkey AS varchar) ELSE replace(cast(cast(s_acctbal AS decimal(18,2)) AS varchar), '.', ',') END AS amount FROM supplier),
v AS (SELECT amount, cast(replace(amount, ',', '') AS double) AS number, s_suppkey FROM s)
SELECT 'numbers' AS file, 'utf-8' AS encoding, ';' AS delimiter, FALSE AS has_header, 'column_1' AS field, 'numeric' AS data_type, count(*) AS total_count, cast(min(s_suppkey) AS varchar) AS min_value, cast(max(s_suppkey) AS varchar) AS max_value FROM s
UNION ALL SELECT 'numbers', 'utf-8', ';', FALSE, 'column_2', 'numeric', count(*), (SELECT amount FROM v ORDER BY number, s_suppkey LIMIT 1), (SELECT amount FROM v ORDER BY number DESC, s_suppkey LIMIT 1) FROM v
UNION ALL SELECT 'numbers', 'utf-8', ';', FALSE, 'column_3', 'numeric', count(*), cast(min(s_nationkey) AS varchar), cast(max(s_nationkey) AS varchar) FROM s
UNION ALL SELECT 'accents', 'latin-1', chr(9), TRUE, 'n_nationkey', 'numeric', count(*), cast(min(n_nationkey) AS varchar), cast(max(n_nationkey) AS varchar) FROM nation
UNION ALL SELECT 'accents', 'latin-1', chr(9), TRUE, 'naïve', 'text', count(*), min(n_name || 'é'), max(n_name || 'é') FROM nation
"""


def json_contract_nation(spark, sf_dir):
    """Five files of an array each, one for each region."""
    key = F.col("n_nationkey")
    one = F.struct(key.alias("k"), F.col("n_name").alias("name"), (key * 0.5 + 0.25).alias("half"), (key % 2 == 0).alias("even"), F.when(key % 3 > 0, F.col("n_name")).alias("note"), F.struct(F.col("n_regionkey").alias("r")).alias("at"))
    text = F.to_json(one, {"ignoreNullFields": "false"})
    arrays = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("["), F.concat_ws(",\n", F.collect_list(text)), F.lit("]")).alias("text")).collect()
    folder = scratch(spark)
    for r in arrays:
        put(spark, f"{folder}/{r['n_regionkey']}.json", r["text"].encode())
    return _json_rows(spark, json.analyze_json(spark, folder))


def _json_rows(spark: SparkSession, c: dict) -> DataFrame:
    rows = [(f["name"], f["data_type"], *(f["profile"][x] for x in ("total_count", "null_count", "min_value", "max_value")), c["source_format"], c["total_rows"], len(c["issues"])) for f in c["fields"]]
    return spark.createDataFrame(rows, "field string, data_type string, total_count long, null_count long, min_value string, max_value string, format string, total_rows long, n_issues long")


_NATION_JSON_SQL = """
WITH f AS (SELECT unnest([{'f': 'k', 't': 'numeric', 'v': cast(n_nationkey AS varchar)}, {'f': 'name', 't': 'text', 'v': n_name}, {'f': 'half', 't': 'numeric', 'v': cast(cast(n_nationkey AS double) / 2 + 0.25 AS varchar)},
    {'f': 'even', 't': 'boolean', 'v': CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END}, {'f': 'note', 't': 'text', 'v': CASE WHEN n_nationkey % 3 > 0 THEN n_name END},
    {'f': 'at', 't': 'object', 'v': '{"r":' || n_regionkey || '}'}]) AS c FROM nation)
SELECT c.f AS field, c.t AS data_type, count(*) AS total_count, count(*) - count(c.v) AS null_count, min(c.v) AS min_value, max(c.v) AS max_value, 'json' AS format, count(*) AS total_rows, cast(0 AS bigint) AS n_issues FROM f GROUP BY 1, 2
"""


def ndjson_contract_events(spark, sf_dir):
    """Lines of objects, of broken and of other values, and blank ones."""
    i = F.col("event_id")
    value = F.when(i % 4 > 0, F.to_json(F.struct(F.col("event_type").alias("v"))))
    good = F.concat(F.lit('{"id":'), i.cast("string"), F.lit(',"tiny":'), (i % 9 + 1).cast("string"), F.lit('e-7,"some":'), F.coalesce(value, F.lit("null")), F.lit(',"big":'), (i % 9 + 1).cast("string"), F.lit("234567.5}"))
    line = F.when(i % 10 == 3, "{bad").when(i % 10 == 5, "[1,2]").when(i % 10 == 6, "\t  ").otherwise(good)
    folder = scratch(spark)
    read(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    return _json_rows(spark, json.analyze_json(spark, folder))


_EVENTS_SQL = """
WITH e AS (SELECT * FROM events WHERE event_id % 10 NOT IN (3, 5, 6)),
f AS (SELECT unnest([{'f': 'id', 't': 'numeric', 'v': cast(event_id AS varchar)}, {'f': 'tiny', 't': 'numeric', 'v': cast(event_id % 9 + 1 AS varchar) || 'e-07'},
    {'f': 'some', 't': 'object', 'v': CASE WHEN event_id % 4 > 0 THEN '{"v":"' || event_type || '"}' END}, {'f': 'big', 't': 'numeric', 'v': cast(event_id % 9 + 1 AS varchar) || '.2345675e+06'}]) AS c FROM e)
SELECT c.f AS field, c.t AS data_type, count(*) AS total_count, count(*) - count(c.v) AS null_count, min(c.v) AS min_value, max(c.v) AS max_value, 'ndjson' AS format, count(*) AS total_rows,
       (SELECT count(*) FROM events WHERE event_id % 10 IN (3, 5)) AS n_issues FROM f GROUP BY 1, 2
"""


def workbook(sheets: dict[str, Sequence[Sequence]]) -> bytes:
    """A small workbook: numbers as numbers, other values as inline text, None as no cell."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(r: int, c: int, v) -> str:
        at = f'{chr(65 + c)}{r}"'
        return "" if v is None else f'<c r="{at}><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at} t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        names = "".join(f'<sheet name="{escape(s)}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{rels}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
    return out.getvalue()


def _book(spark: SparkSession, sf_dir: str) -> dict:
    """The contract of a workbook of nations (with a column that every other row leaves out) and regions."""
    nations = read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey"))).collect()
    regions = read(spark, sf_dir, "region").orderBy("r_regionkey").select("r_regionkey", "r_name").collect()
    data = workbook({"Nations": [("Key", "Name", "Region"), *nations], "Regions": [("Key", "Name"), *regions]})
    return xlsx.analyze_xlsx(spark, put(spark, f"{scratch(spark)}/book.xlsx", data))


def xlsx_contract(spark, sf_dir):
    rows = [
        (s["name"], s["row_count"], f["name"], f["data_type"], f["nullable"], f["name"] in s["validation_rules"]["required_fields"], *(f["profile"][c] for c in ("null_count", "distinct_count", "min_value", "max_value")))
        for s in _book(spark, sf_dir)["schemas"]
        for f in s["fields"]
    ]
    return spark.createDataFrame(rows, "sheet string, row_count long, field string, data_type string, nullable boolean, required boolean, null_count long, distinct_count long, min_value string, max_value string")


_XLSX_SQL = """
WITH n AS (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS r FROM nation)
SELECT 'Nations' AS sheet, count(*) AS row_count, 'Key' AS field, 'numeric' AS data_type, FALSE AS nullable, TRUE AS required, cast(0 AS bigint) AS null_count, count(DISTINCT n_nationkey) AS distinct_count, cast(min(n_nationkey) AS varchar) AS min_value, cast(max(n_nationkey) AS varchar) AS max_value FROM n
UNION ALL SELECT 'Nations', count(*), 'Name', 'text', FALSE, TRUE, 0, count(DISTINCT n_name), min(n_name), max(n_name) FROM n
UNION ALL SELECT 'Nations', count(*), 'Region', 'numeric', TRUE, FALSE, count(*) - count(r), count(DISTINCT r), cast(min(r) AS varchar), cast(max(r) AS varchar) FROM n
UNION ALL SELECT 'Regions', count(*), 'Key', 'numeric', FALSE, TRUE, 0, count(DISTINCT r_regionkey), cast(min(r_regionkey) AS varchar), cast(max(r_regionkey) AS varchar) FROM region
UNION ALL SELECT 'Regions', count(*), 'Name', 'text', FALSE, TRUE, 0, count(DISTINCT r_name), min(r_name), max(r_name) FROM region
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders")
_JSON_TYPES = {"int": ("integer", "int32"), "bigint": ("integer", "int64"), "double": ("number", "double"), "string": ("string", None), "timestamp_ntz": ("string", "date-time")}
_COLUMN_TYPES = {"int": ("integer", "integer"), "bigint": ("integer", "bigint"), "double": ("number", "double precision"), "string": ("string", "text"), "timestamp_ntz": ("string", "timestamp without time zone")}


def _definitions(spark: SparkSession, sf_dir: str, types: dict[str, tuple]) -> dict[str, dict]:
    """Schemas of the tables as a specification defines them; keys are required."""
    out = {}
    for name in _TABLES:
        kinds = {c: types[kind] for c, kind in read(spark, sf_dir, name).dtypes}
        out[name] = {"type": "object", "required": [c for c in kinds if c.endswith("key")], "properties": {c: {"type": t} | ({"format": f} if f else {}) for c, (t, f) in kinds.items()}}
    return out


def _spec(spark: SparkSession, sf_dir: str, version: int) -> dict:
    """Each table can be listed, and a row of it sent."""
    at = "#/components/schemas/" if version == 3 else "#/definitions/"
    wrap = (lambda s: {"content": {"application/json": {"schema": s}}}) if version == 3 else (lambda s: {"schema": s})
    paths: dict = {}
    held = _definitions(spark, sf_dir, _JSON_TYPES)
    for name in held:
        ref = {"$ref": at + name}
        send = {"requestBody": wrap(ref)} if version == 3 else {"parameters": [{"in": "body", "name": "row"} | wrap(ref)]}
        paths[f"/{name}"] = {"get": {"summary": f"all of {name}", "responses": {"200": wrap({"type": "array", "items": ref})}}, "post": {"responses": {"201": {}}} | send, "trace": {}}
    return {"openapi": "3.0.1", "paths": paths, "components": {"schemas": held}} if version == 3 else {"swagger": "2.0", "paths": paths, "definitions": held}


def _endpoint_rows(spark: SparkSession, contract: dict) -> DataFrame:
    rows = [(s["name"], f["name"], f["data_type"], f["nullable"], f["name"] in s["validation_rules"].get("required_fields", [])) for s in contract["schemas"] for f in s["fields"]]
    return spark.createDataFrame(rows, "endpoint string, field string, data_type string, nullable boolean, required boolean")


def openapi_contract(spark, sf_dir):
    return _endpoint_rows(spark, specs.analyze_spec(_spec(spark, sf_dir, 3)))


def swagger_contract(spark, sf_dir):
    return _endpoint_rows(spark, specs.analyze_spec(_spec(spark, sf_dir, 2)))


def postgrest_contract(spark, sf_dir):
    raw = {"definitions": _definitions(spark, sf_dir, _COLUMN_TYPES), "paths": {f"/{t}": {} for t in _TABLES} | {"/rpc/run": {}, "/": {}}}
    return _endpoint_rows(spark, specs.analyze_tables(raw, "shop"))


def _described_sql(endpoints: Sequence[str], kinds: dict[str, str]) -> str:
    case = " ".join(f"WHEN column_type = '{k}' THEN '{v}'" for k, v in kinds.items())
    one = "SELECT replace('{e}', '{{t}}', '{t}') AS endpoint, column_name AS field, CASE {case} ELSE '?' END AS data_type, NOT column_name LIKE '%key' AS nullable, column_name LIKE '%key' AS required FROM (DESCRIBE {t})"
    return " UNION ALL ".join(one.format(e=e, t=t, case=case) for e in endpoints for t in _TABLES)


_API_KINDS = {"INTEGER": "integer", "BIGINT": "integer", "DOUBLE": "numeric", "VARCHAR": "text", "TIMESTAMP": "timestamptz"}
_TABLE_KINDS = _API_KINDS | {"BIGINT": "bigint", "DOUBLE": "double", "TIMESTAMP": "timestamp"}


def _database(spark: SparkSession, sf_dir: str) -> dict:
    """The contract of a database of regions and nations, whose catalog is written down here."""
    frame = lambda names, rows: spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n.startswith(('ordinal', 'numeric', 'character')) else 'string'}" for n in names.split(", ")))
    own = [("region", "r_regionkey", "integer", "NO"), ("region", "r_name", "text", "YES"), ("nation", "n_nationkey", "integer", "NO"), ("nation", "n_name", "character varying", "YES"), ("nation", "n_regionkey", "integer", "NO")]
    place = {c: i for i, (_, c, _, _) in enumerate(own, 1)}
    keys = [("region_pk", "region", "r_regionkey", "PRIMARY KEY", None), ("nation_pk", "nation", "n_nationkey", "PRIMARY KEY", None), ("nation_name", "nation", "n_name", "UNIQUE", None), ("nation_fk", "nation", "n_regionkey", "FOREIGN KEY", ("region", "r_regionkey"))]
    catalog = {
        "tables": frame(tables.CATALOG["tables"], [("public", t, "BASE TABLE") for t in ("region", "nation")] + [("public", "shown", "VIEW")]),
        "columns": frame(tables.CATALOG["columns"], [("public", t, c, k, null, 25 if c == "n_name" else None, None, None, place[c]) for t, c, k, null in own]),
        "table_constraints": frame(tables.CATALOG["table_constraints"], [(n, "public", t, k) for n, t, _, k, _ in keys]),
        "key_column_usage": frame(tables.CATALOG["key_column_usage"], [(n, "public", t, c, 1) for n, t, c, _, _ in keys]),
        "constraint_column_usage": frame(tables.CATALOG["constraint_column_usage"], [(n, "public", *(other or (t, c))) for n, t, c, _, other in keys]),
    }
    return tables.analyze_database(spark, catalog, lambda t: read(spark, sf_dir, t), "shop")


def database_contract(spark, sf_dir):
    rows = []
    for s in _database(spark, sf_dir)["schemas"]:
        for f in s["fields"]:
            held = "; ".join(" ".join([c["type"], *(c[x] for x in ("referred_table", "referred_column") if x in c)]) for c in f["constraints"])
            rows.append((s["name"], s["row_count"], f["name"], f["data_type"], f["nullable"], held, *(f["profile"][c] for c in ("sample_size", "null_count", "distinct_count", "min_value", "max_value")), f["profile"]["top_values"][0]["count"]))
    return spark.createDataFrame(rows, "table_name string, row_count long, field string, data_type string, nullable boolean, constraints string, sample_size long, null_count long, distinct_count long, min_value string, max_value string, top_count long")


def _database_sql() -> str:
    own = [
        ("region", "r_regionkey", "integer", "FALSE", "primary_key; not_null"),
        ("region", "r_name", "text", "TRUE", ""),
        ("nation", "n_nationkey", "integer", "FALSE", "primary_key; not_null"),
        ("nation", "n_name", "varchar", "TRUE", "unique"),
        ("nation", "n_regionkey", "integer", "FALSE", "foreign_key region r_regionkey; not_null"),
    ]
    one = "SELECT '{t}' AS table_name, count(*) AS row_count, '{c}' AS field, '{k}' AS data_type, {n} AS nullable, '{h}' AS constraints, count(*) AS sample_size, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, min(cast({c} AS varchar)) AS min_value, max(cast({c} AS varchar)) AS max_value, (SELECT max(m) FROM (SELECT count(*) AS m FROM {t} GROUP BY {c})) AS top_count FROM {t}"
    return " UNION ALL ".join(one.format(t=t, c=c, k=k, n=n, h=h) for t, c, k, n, h in own)


def analysed_contracts_are_valid(spark, sf_dir):
    """Contracts of every kind of source, checked by the rules."""
    made = {"csv": _customers(spark, sf_dir), "openapi": specs.analyze_spec(_spec(spark, sf_dir, 3), "shop"), "database": _database(spark, sf_dir)}
    texts = spark.createDataFrame([(name, J.dumps(c)) for name, c in made.items()], "id string, json string")
    return verify.verify(texts).select("id", "contract_type", "valid", F.size("issues").cast("long").alias("n_issues"))


_VALID_SQL = "SELECT * FROM (VALUES ('csv', 'source', TRUE, cast(0 AS bigint)), ('openapi', 'destination', TRUE, 0), ('database', 'destination', TRUE, 0)) AS t(id, contract_type, valid, n_issues)"


def number_shapes(spark, sf_dir):
    """Prices written in several ways, by the tests of how a number is written."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    us = F.format_number(price, 2)
    forms = {"us": us, "european": F.translate(us, ",.", ".,"), "plain": price.cast("string"), "whole": F.col("o_orderkey").cast("string"), "thousands": F.format_number(price, 0)}
    long = read(spark, sf_dir, "orders").select(F.inline(F.array(*(F.struct(F.lit(n).alias("form"), v.alias("v")) for n, v in forms.items()))))
    v = F.col("v")
    tests = {"us_decimal": cells.is_us_decimal(v), "european_decimal": cells.is_european_decimal(v), "us_thousands": cells.is_us_thousands(v), "european_comma": cells.is_european_comma(v), "plain_number": cells.is_plain_number(v), "all_digits": cells.all_digits(v), "digits_and_comma": cells.all_digits_and(v, ",")}
    return long.groupBy("form").agg(*(F.count_if(t).alias(n) for n, t in tests.items()))


_SHAPES_SQL = """
WITH p AS (SELECT o_orderkey, cast(o_totalprice AS decimal(18,2)) AS p FROM orders),
f AS (SELECT unnest([{'f': 'us', 'v': format('{:,}', cast(trunc(p) AS bigint)) || substr(cast(p AS varchar), -3)}, {'f': 'european', 'v': translate(format('{:,}', cast(trunc(p) AS bigint)) || substr(cast(p AS varchar), -3), ',.', '.,')},
    {'f': 'plain', 'v': cast(p AS varchar)}, {'f': 'whole', 'v': cast(o_orderkey AS varchar)}, {'f': 'thousands', 'v': format('{:,}', cast(round_even(p, 0) AS bigint))}]) AS c FROM p)
SELECT c.f AS form, count(*) FILTER (WHERE regexp_full_match(c.v, '[0-9,]+\\.[0-9]+')) AS us_decimal, count(*) FILTER (WHERE regexp_full_match(c.v, '[0-9.]+,[0-9]+')) AS european_decimal,
  count(*) FILTER (WHERE contains(c.v, ',') AND list_aggregate(list_transform(string_split(c.v, ',')[2:], lambda x: length(x) = 3 AND regexp_full_match(x, '[0-9]+')), 'bool_and') AND regexp_full_match(string_split(c.v, ',')[1], '[0-9]+')) AS us_thousands,
  count(*) FILTER (WHERE length(c.v) - length(replace(c.v, ',', '')) = 1 AND NOT contains(c.v, '.')) AS european_comma, count(*) FILTER (WHERE NOT contains(c.v, ',') AND try_cast(c.v AS double) IS NOT NULL) AS plain_number,
  count(*) FILTER (WHERE NOT contains(c.v, ',') AND NOT contains(c.v, '.')) AS all_digits, count(*) FILTER (WHERE NOT contains(c.v, '.')) AS digits_and_comma FROM f GROUP BY 1
"""

ALL = {
    "csv_contract_customer": (csv_contract_customer, _CUSTOMER_SQL),
    "csv_dialects": (csv_dialects, _DIALECTS_SQL),
    "json_contract_nation": (json_contract_nation, _NATION_JSON_SQL),
    "ndjson_contract_events": (ndjson_contract_events, _EVENTS_SQL),
    "xlsx_contract": (xlsx_contract, _XLSX_SQL),
    "openapi_contract": (openapi_contract, _described_sql(["GET /{t}", "POST /{t}"], _API_KINDS)),
    "swagger_contract": (swagger_contract, _described_sql(["GET /{t}", "POST /{t}"], _API_KINDS)),
    "postgrest_contract": (postgrest_contract, _described_sql(["{t}"], _TABLE_KINDS)),
    "database_contract": (database_contract, _database_sql()),
    "analysed_contracts_are_valid": (analysed_contracts_are_valid, _VALID_SQL),
    "number_shapes": (number_shapes, _SHAPES_SQL),
}
