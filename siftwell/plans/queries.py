"""Registry: a query for each family of operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import cells, types
from siftwell.operators import mapping, verify
from siftwell.operators import profile as P
from siftwell.options import ProfileOptions
from siftwell.plans import contracts
from siftwell.sources import csv, json, specs, tables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as texts that both engines write alike."""
    kinds = dict(df.dtypes)
    show = lambda c: F.col(c).cast("decimal(18,2)").cast("string") if kinds[c] == "double" else F.col(c).cast("string")
    return df.select(*(show(c).alias(c) for c in columns))


_SHOWN = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")}
_STATS = ("field", "total_count", "null_count", "null_percentage", "distinct_count", "min_value", "max_value")
_TWO = "cast(cast({0} as decimal(18,2)) as varchar)"
_NUMBERS = {"o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "s_acctbal", "c_acctbal", "p_retailprice", "value"}


def _show(c: str) -> str:
    return _TWO.format(c) if c in _NUMBERS else f"cast({c} as varchar)"


def _lexical(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return P.profile(_texts(df, *columns), columns, numeric_range=False, cap_distinct=False).select(*_STATS)


def _lexical_sql(table: str) -> str:
    one = "SELECT '{c}' AS field, count(*) AS total_count, count(*) FILTER (WHERE {v} IS NULL OR regexp_full_match({v}, '\\s*')) AS null_count, round(100.0 * count(*) FILTER (WHERE {v} IS NULL) / count(*), 2) AS null_percentage, count(DISTINCT {v}) AS distinct_count, min({v}) AS min_value, max({v}) AS max_value FROM {t}"
    return " UNION ALL ".join(one.format(c=c, v=_show(c), t=table) for c in _SHOWN[table])


def profile_orders_columns(spark, sf_dir):
    return _lexical(read(spark, sf_dir, "orders"), _SHOWN["orders"])


def profile_lineitem_columns(spark, sf_dir):
    return _lexical(read(spark, sf_dir, "lineitem"), _SHOWN["lineitem"])


def profile_lineitem_numeric_range(spark, sf_dir):
    """The range by number, of texts."""
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_partkey", "l_returnflag")
    out = P.profile(_texts(read(spark, sf_dir, "lineitem"), *columns), columns, cap_distinct=False)
    return out.select("field", "data_type", "min_value", "max_value")


def _range_sql() -> str:
    number = "SELECT '{c}' AS field, 'numeric' AS data_type, cast(min(cast({v} as decimal(18,2))) as varchar) AS min_value, cast(max(cast({v} as decimal(18,2))) as varchar) AS max_value FROM lineitem"
    whole = "SELECT 'l_partkey' AS field, 'numeric' AS data_type, cast(min(l_partkey) as varchar) AS min_value, cast(max(l_partkey) as varchar) AS max_value FROM lineitem"
    text = "SELECT 'l_returnflag' AS field, 'text' AS data_type, min(l_returnflag) AS min_value, max(l_returnflag) AS max_value FROM lineitem"
    return " UNION ALL ".join([*(number.format(c=c, v=c) for c in ("l_quantity", "l_extendedprice", "l_discount")), whole, text])


def _top(df: DataFrame, columns: tuple[str, ...], n: int = 5) -> DataFrame:
    long = P.unpivot(P.with_row_index(_texts(df, *columns)), columns)
    return P.top_values(P.group_values(long).filter("value is not null"), n)


def _top_sql(table: str, columns: tuple[str, ...], n: int = 5) -> str:
    one = "SELECT '{c}' AS field, rank, value, n FROM (SELECT {v} AS value, count(*) AS n, cast(row_number() OVER (ORDER BY count(*) DESC, {v}) AS integer) AS rank FROM {t} GROUP BY {v}) WHERE rank <= {n}"
    return " UNION ALL ".join(one.format(c=c, v=_show(c), t=table, n=n) for c in columns)


def topk_part(spark, sf_dir):
    return _top(read(spark, sf_dir, "part"), ("p_type", "p_brand", "p_size"))


def topk_events(spark, sf_dir):
    return _top(read(spark, sf_dir, "events"), ("event_type", "user_id"))


def capped_distinct_customer(spark, sf_dir):
    """Distinct values as a counter of at most 100 sees them in key order, and how often it has met its three first."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.lit(0).alias("pos"), F.lit("c_nationkey").alias("field"), F.col("c_nationkey").cast("string").alias("value"))
    more = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.lit(1).alias("pos"), F.lit("c_name").alias("field"), F.col("c_name").alias("value"))
    held = P.tracked(P.group_values(rows.union(more)), 10)
    return held.groupBy("field").agg(F.count("*").alias("distinct_count"), F.sum("n").alias("counted"), F.min("value").alias("least"))


_CAPPED_SQL = """
WITH c AS (SELECT c_custkey AS i, 'c_nationkey' AS field, cast(c_nationkey AS varchar) AS value FROM customer
           UNION ALL SELECT c_custkey, 'c_name', c_name FROM customer),
g AS (SELECT field, value, count(*) AS n, min(i) AS first_idx FROM c GROUP BY field, value),
k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY first_idx, value) AS k FROM g)
SELECT field, count(*) AS distinct_count, cast(sum(n) AS bigint) AS counted, min(value) AS least FROM k WHERE k <= 10 GROUP BY field
"""


def classify_cells_mixed(spark, sf_dir):
    """Cells of several kinds, by type, and the merged type of each column."""
    o = read(spark, sf_dir, "orders")
    cells_ = [("key", F.col("o_orderkey").cast("string")), ("date", F.date_format("o_orderdate", "yyyy-MM-dd")), ("slash", F.date_format("o_orderdate", "dd/MM/yyyy")), ("priority", F.col("o_orderpriority")), ("european", F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ",")), ("blank", F.when(F.col("o_orderkey") % 2 == 0, F.lit("  ")).otherwise(F.col("o_custkey").cast("string")))]
    long = o.select(F.inline(F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in cells_))))
    kind = cells.classify(F.col("value"))
    merged = long.groupBy("field", kind.alias("data_type")).agg(F.count("*").alias("n"))
    strongest = merged.groupBy("field").agg(cells.type_of(F.max(cells.rank_of(F.col("data_type")))).alias("merged"))
    return merged.join(strongest, "field")


_CLASSIFY_SQL = r"""
WITH c AS (
  SELECT unnest([{'field': 'key', 'value': cast(o_orderkey AS varchar)}, {'field': 'date', 'value': strftime(o_orderdate, '%Y-%m-%d')},
    {'field': 'slash', 'value': strftime(o_orderdate, '%d/%m/%Y')}, {'field': 'priority', 'value': o_orderpriority},
    {'field': 'european', 'value': replace(cast(cast(o_totalprice AS decimal(18,2)) AS varchar), '.', ',')},
    {'field': 'blank', 'value': CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE cast(o_custkey AS varchar) END}]) AS s FROM orders),
k AS (SELECT s.field AS field, CASE WHEN trim(s.value) = '' THEN 'empty'
        WHEN regexp_full_match(s.value, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN 'date'
        WHEN regexp_full_match(s.value, '-?[0-9.]*[0-9](,[0-9]+)?') THEN 'numeric' ELSE 'text' END AS data_type FROM c),
g AS (SELECT field, data_type, count(*) AS n FROM k GROUP BY field, data_type)
SELECT field, data_type, n, max_by(data_type, list_position(['empty', 'numeric', 'date', 'text'], data_type)) OVER (PARTITION BY field) AS merged FROM g
"""


def parse_numeric_locale(spark, sf_dir):
    """Prices written in US, European and quoted form, read back."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    us = F.format_number(price, 2)
    european = F.translate(us, ",.", ".,")
    o = read(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), us.alias("us"), european.alias("eu"))
    back = lambda c: cells.parse_numeric(c).cast("decimal(18,2)")
    return o.select("o_orderkey", back(F.col("us")).alias("from_us"), back(F.col("eu")).alias("from_eu"), back(F.concat(F.lit('"'), "us", F.lit('"'))).alias("from_quoted"), back(F.concat(F.lit("x"), "us")).alias("from_text"))


_PARSE_SQL = "SELECT o_orderkey, p AS from_us, p AS from_eu, p AS from_quoted, cast(NULL AS decimal(18,2)) AS from_text FROM (SELECT o_orderkey, cast(o_totalprice AS decimal(18,2)) AS p FROM orders)"


def header_detect(spark, sf_dir):
    """Whether rows of cells would be taken as a header."""
    n = read(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.lit(" ")).alias("numbers"), F.array(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("names"), F.array(F.lit("2024-01-05"), F.lit("")).alias("dates"))
    return rows.select("n_nationkey", *(cells.has_header(F.col(c)).alias(c) for c in ("numbers", "names", "dates")), cells.is_empty_row(F.col("dates")).alias("empty_row"))


_HEADER_SQL = r"""
WITH r AS (SELECT n_nationkey, [cast(n_nationkey AS varchar), ' '] AS numbers, [n_name, cast(n_regionkey AS varchar)] AS names, ['2024-01-05', ''] AS dates FROM nation),
c AS (SELECT n_nationkey, 'numbers' AS k, unnest(numbers) AS v FROM r UNION ALL SELECT n_nationkey, 'names', unnest(names) FROM r UNION ALL SELECT n_nationkey, 'dates', unnest(dates) FROM r),
w AS (SELECT n_nationkey, k, trim(v) = '' AS blank, trim(v) <> '' AND try_cast(v AS double) IS NULL AS word FROM c)
SELECT n_nationkey, bool_or(word) FILTER (WHERE k = 'numbers') AS numbers, bool_or(word) FILTER (WHERE k = 'names') AS names,
       bool_or(word) FILTER (WHERE k = 'dates') AS dates, bool_and(blank) FILTER (WHERE k = 'dates') AS empty_row FROM w GROUP BY n_nationkey
"""


def json_field_profile_events_props(spark, sf_dir):
    rows = json.dense_index(read(spark, sf_dir, "events").select(F.try_parse_json("props").alias("v")))
    return json.json_profile(rows).select("field", "data_type", "total_count", "null_count", "null_percentage", "min_value", "max_value")


_PROPS_SQL = """
SELECT 'k' AS field, 'numeric' AS data_type, count(*) AS total_count, count(*) - count(v) AS null_count, round(100.0 * (count(*) - count(v)) / count(*), 2) AS null_percentage,
       min(v) AS min_value, max(v) AS max_value FROM (SELECT props->>'$.k' AS v FROM events)
"""


def json_first_seen_totals(spark, sf_dir):
    """Objects whose keys come and go: totals count from the first row that has the key."""
    d = json.key_index(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey")
    late = F.when(F.col("o_orderkey") > 500, F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))))
    mixed = F.when(F.col("o_orderkey") % 7 == 0, F.lit('{"c":"text","n":null}')).otherwise(F.to_json(F.struct(F.col("o_custkey").alias("c"))))
    rows = d.select("idx", F.try_parse_json(F.coalesce(late, mixed)).alias("v"))
    return json.json_profile(rows).select("field", "data_type", "total_count", "null_count")


_FIRST_SQL = """
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
k AS (SELECT i, 'c' AS field, CASE WHEN o_orderkey <= 500 AND o_orderkey % 7 = 0 THEN 'text' ELSE 'numeric' END AS t, TRUE AS known FROM r
      UNION ALL SELECT i, 's', 'text', TRUE FROM r WHERE o_orderkey > 500
      UNION ALL SELECT i, 'n', 'null', FALSE FROM r WHERE o_orderkey <= 500 AND o_orderkey % 7 = 0)
SELECT field, CASE WHEN bool_or(t = 'text') THEN 'text' WHEN bool_or(t = 'numeric') THEN 'numeric' ELSE 'empty' END AS data_type,
       (SELECT count(*) FROM orders) - min(i) AS total_count, (SELECT count(*) FROM orders) - min(i) - count(*) FILTER (WHERE known) AS null_count FROM k GROUP BY field
"""


def ndjson_bad_lines(spark, sf_dir):
    """How many lines are objects, broken, other values or blank."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    line = F.when(i % 10 == 3, "{bad").when(i % 10 == 5, "[1,2]").when(i % 10 == 6, "  ").when(i % 10 == 7, " null ").otherwise(F.col("props"))
    lines = json.parsed_lines(e.select(line.alias("value")))
    return lines.groupBy("bad").agg(F.count("*").alias("n"))


_BAD_SQL = "SELECT event_id % 10 IN (3, 5) AS bad, count(*) AS n FROM events WHERE event_id % 10 <> 6 GROUP BY 1"


def null_ratio_documents_labels(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("lang", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return P.profile(d, ("lang", "quality", "toxic")).select("field", "total_count", "null_count", "null_percentage", "distinct_count")


_RATIO_SQL = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS total_count, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percentage, count(DISTINCT {c}) AS distinct_count FROM documents LEFT JOIN labels USING (doc_id)" for c in ("lang", "quality", "toxic"))


def sample_first_n(spark, sf_dir):
    return P.sample_rows(read(spark, sf_dir, "nation"), ProfileOptions().max_sample_rows, "n_nationkey")


_COLUMNS = [("orders", "o_orderkey", "bigint", "NO", 1), ("orders", "o_custkey", "int8", "NO", 2), ("orders", "o_orderstatus", "character varying", "YES", 3), ("lineitem", "l_orderkey", "bigint", "NO", 1), ("lineitem", "l_linenumber", "integer", "NO", 2), ("lineitem", "l_tax", "numeric", "YES", 3)]
_KEYS = [("orders_pkey", "orders", "PRIMARY KEY", "o_orderkey", 1, "orders", "o_orderkey"), ("orders_fk", "orders", "FOREIGN KEY", "o_custkey", 1, "customer", "c_custkey"), ("line_pkey", "lineitem", "PRIMARY KEY", "l_orderkey", 1, "lineitem", "l_orderkey"), ("line_pkey", "lineitem", "PRIMARY KEY", "l_linenumber", 2, "lineitem", "l_linenumber"), ("line_fk", "lineitem", "FOREIGN KEY", "l_orderkey", 1, "orders", "o_orderkey"), ("status_key", "orders", "UNIQUE", "o_orderstatus", 1, "orders", "o_orderstatus")]


def _catalog(spark: SparkSession) -> dict[str, DataFrame]:
    c = spark.createDataFrame([("public", t, n, k, y, 20 if k == "character varying" else None, 10 if k == "numeric" else None, 2 if k == "numeric" else None, p) for t, n, k, y, p in _COLUMNS], "table_schema string, table_name string, column_name string, data_type string, is_nullable string, character_maximum_length int, numeric_precision int, numeric_scale int, ordinal_position int")
    t = spark.createDataFrame(sorted({(k[0], "public", k[1], k[2]) for k in _KEYS}), "constraint_name string, table_schema string, table_name string, constraint_type string")
    u = spark.createDataFrame([(k[0], "public", k[1], k[3], k[4]) for k in _KEYS], "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int")
    r = spark.createDataFrame(sorted({(k[0], "public", k[5], k[6]) for k in _KEYS if k[2] == "FOREIGN KEY"}), "constraint_name string, table_schema string, table_name string, column_name string")
    return {"columns": c, "table_constraints": t, "key_column_usage": u, "constraint_column_usage": r}


def pg_catalog_constraints(spark, sf_dir):
    c = _catalog(spark)
    fields = tables.annotated_fields(tables.columns_of(c["columns"]), tables.constraints_of(c["table_constraints"], c["key_column_usage"], c["constraint_column_usage"]))
    kinds = F.array_join(F.transform("constraints", lambda k: F.concat(k["type"], F.coalesce(F.concat(F.lit(":"), k["referred_table"], F.lit("."), k["referred_column"]), F.lit("")))), ";")
    return fields.select("table_name", "name", "data_type", "nullable", kinds.alias("constraints"))


def pg_validation_rules(spark, sf_dir):
    c = _catalog(spark)
    fields = tables.annotated_fields(tables.columns_of(c["columns"]), tables.constraints_of(c["table_constraints"], c["key_column_usage"], c["constraint_column_usage"]))
    rules = tables.validation_rules(fields)
    return rules.select("table_name", F.array_join("required_fields", ",").alias("required_fields"), F.array_join("unique_constraints", ",").alias("unique_constraints"))


def _rows_sql(names: str, rows: list[tuple]) -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


_CATALOG_SQL = f"""
WITH c AS ({_rows_sql("t, n, k, y, p", _COLUMNS)}), u AS ({_rows_sql("name, t, kind, n, place, rt, rc", _KEYS)}),
k AS (SELECT t, n, string_agg(CASE kind WHEN 'PRIMARY KEY' THEN 'primary_key' WHEN 'UNIQUE' THEN 'unique' ELSE 'foreign_key:' || rt || '.' || rc END, ';'
        ORDER BY place, CASE kind WHEN 'PRIMARY KEY' THEN 'primary_key' WHEN 'UNIQUE' THEN 'unique' ELSE 'foreign_key' END) AS s FROM u GROUP BY t, n)
SELECT c.t AS table_name, c.n AS name, CASE c.k WHEN 'int8' THEN 'bigint' WHEN 'character varying' THEN 'varchar' ELSE c.k END AS data_type, c.y = 'YES' AS nullable,
       concat_ws(';', k.s, CASE WHEN c.y = 'NO' THEN 'not_null' END) AS constraints FROM c LEFT JOIN k ON c.t = k.t AND c.n = k.n
"""
_RULES_SQL = f"""
WITH c AS ({_rows_sql("t, n, k, y, p", _COLUMNS)}), u AS ({_rows_sql("name, t, kind, n, place, rt, rc", _KEYS)})
SELECT t AS table_name, string_agg(n, ',' ORDER BY p) FILTER (WHERE y = 'NO') AS required_fields,
       (SELECT string_agg(DISTINCT u.n, ',' ORDER BY u.n) FROM u WHERE u.t = c.t AND kind <> 'FOREIGN KEY') AS unique_constraints FROM c GROUP BY t
"""


def pk_candidate_check(spark, sf_dir):
    """Extension: which columns of orders are unique in the data."""
    o = _texts(read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderstatus")
    return P.profile(o, None, cap_distinct=False).select("field", ((F.col("distinct_count") == F.col("total_count")) & (F.col("null_count") == 0)).alias("unique"))


_UNIQUE_SQL = " UNION ALL ".join(f'SELECT \'{c}\' AS field, count(DISTINCT {c}) = count(*) AS "unique" FROM orders' for c in ("o_orderkey", "o_custkey", "o_orderstatus"))


def fk_orphans(spark, sf_dir):
    """Extension: orders without line items, by status."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(line, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_SOURCE_FIELDS = [("orders", 0, 0, "O_OrderKey", "bigint"), ("orders", 0, 1, "o_totalprice", "numeric"), ("orders", 0, 2, "o order date", "text"), ("customer", 1, 0, "c_custkey", "bigint"), ("customer", 1, 1, "C-Name", "text"), ("customer", 1, 2, "o_totalprice", "text"), ("extra", 2, 0, "flag", "boolean"), ("extra", 2, 1, "c_custkey", "text")]
_DEST_FIELDS = [(0, "o_orderkey", "bigint", False), (1, "o_totalprice", "double", False), (2, "o_orderdate", "date", True), (3, "c_custkey", "integer", False), (4, "c_name", "varchar", True), (5, "missing", "text", True), (6, "absent", "text", False), (7, "FLAG", "text", True)]


def _mapping_frames(spark):
    return spark.createDataFrame(_SOURCE_FIELDS, "ref string, src_idx int, fld_idx int, name string, data_type string"), spark.createDataFrame(_DEST_FIELDS, "idx int, name string, data_type string, nullable boolean")


def mapping_suggestions(spark, sf_dir):
    return mapping.suggest(*_mapping_frames(spark), "customer")


def mapping_overlap_score(spark, sf_dir):
    return mapping.source_scores(*_mapping_frames(spark), "extra").select("ref", "score")


_MAPPING_SQL = f"""
WITH s AS ({_rows_sql("ref, src_idx, fld_idx, name, data_type", _SOURCE_FIELDS)}), d AS ({_rows_sql("idx, name, data_type, nullable", _DEST_FIELDS)}),
sc AS (SELECT ref, CASE WHEN ref = 'customer' THEN (SELECT count(*) + 1 FROM d) ELSE count(*) FILTER (WHERE lower(name) IN (SELECT lower(name) FROM d)) END AS score FROM s GROUP BY ref),
g(t, k) AS (VALUES ('text', 1), ('varchar', 1), ('char', 1), ('integer', 2), ('bigint', 2), ('smallint', 2), ('numeric', 2), ('real', 2), ('double', 2), ('date', 3), ('timestamp', 3), ('timestamptz', 3)),
p AS (SELECT d.idx, s.ref, s.name AS sn, s.data_type AS st, lower(d.name) = lower(s.name) AS exact,
        row_number() OVER (PARTITION BY d.idx ORDER BY lower(d.name) = lower(s.name) DESC, score DESC, src_idx, fld_idx) AS k
      FROM d JOIN s ON translate(lower(d.name), '_- ', '') = translate(lower(s.name), '_- ', '') JOIN sc ON sc.ref = s.ref),
m AS (SELECT d.*, p.ref, p.sn, p.exact, p.st <> d.data_type AND (SELECT k FROM g WHERE t = p.st) IS DISTINCT FROM (SELECT k FROM g WHERE t = d.data_type) AS cast_
      FROM d LEFT JOIN p ON d.idx = p.idx AND p.k = 1)
SELECT idx, name AS destination_field, CASE WHEN sn IS NOT NULL THEN 'field' WHEN nullable THEN 'null' ELSE 'unmapped' END AS source_type, ref AS source_ref, sn AS source_field,
       CASE WHEN NOT exact THEN 'rename' WHEN cast_ THEN 'cast' END AS transformation, CASE WHEN NOT exact THEN sn END AS rename_from, CASE WHEN NOT exact THEN name END AS rename_to,
       CASE WHEN cast_ THEN data_type END AS target_type, cast(CASE WHEN sn IS NULL THEN 0.0 WHEN exact THEN CASE WHEN cast_ THEN 0.9 ELSE 1.0 END WHEN cast_ THEN 0.7 ELSE 0.8 END AS double) AS confidence FROM m
"""
_OVERLAP_SQL = f"""
WITH s AS ({_rows_sql("ref, src_idx, fld_idx, name, data_type", _SOURCE_FIELDS)}), d AS ({_rows_sql("idx, name, data_type, nullable", _DEST_FIELDS)})
SELECT ref, CASE WHEN ref = 'extra' THEN (SELECT count(*) + 1 FROM d) ELSE count(*) FILTER (WHERE lower(name) IN (SELECT lower(name) FROM d)) END AS score FROM s GROUP BY ref
"""

_BAD_CONTRACTS = [
    (1, '{"contract_type":"source","source_format":"csv","has_header":true,"total_rows":-1,"fields":[{"name":"a","data_type":"text","profile":{"total_count":2,"null_count":3,"null_percentage":150}},{"name":"a","data_type":"blob"}]}', ["CSV contract missing delimiter", "total_rows is negative: -1", "fields[0].profile: null_count (3) > total_count (2)", "fields[0].profile: null_percentage 150.00 out of range [0, 100]", 'fields[1]: duplicate field name "a"', 'fields[1]: unknown data_type "blob"']),
    (2, '{"contract_type":"destination","id":"d","schemas":[{"name":"t","row_count":-2,"fields":[{"name":"x","data_type":"integer","nullable":false,"constraints":[{"type":"foreign_key"}]}],"validation_rules":{"required_fields":["y"]}}]}', ["schemas[0]: row_count is negative", "schemas[0].fields[0].constraints[0]: foreign_key constraint missing referred_table", "schemas[0].fields[0].constraints[0]: foreign_key constraint missing referred_column", 'schemas[0].validation_rules: required_fields references unknown field "y"', 'schemas[0]: field "x" is not nullable but has no not_null constraint']),
    (3, '{"contract_type":"transformation","source_refs":["s"],"destination_refs":["d"],"mapping_groups":[{"destination_ref":"d","field_mappings":[{"destination_field":"x","source_type":"field","confidence":1.5}]}],"execution_plan":{"batch_size":-1,"error_threshold":0.1}}', ['mapping_groups[0].field_mappings[0] (x): source_type is "field" but source_field is empty', "mapping_groups[0].field_mappings[0] (x): confidence 1.50 out of range [0, 1]", "execution_plan: batch_size is negative: -1"]),
    (4, '{"contract_type":"other"}', ['unknown contract_type: "other"']),
    (5, "{bad", ["invalid JSON"]),
    (6, '{"contract_type":""}', ["missing or empty contract_type field"]),
    (7, '{"contract_type":"source","source_format":"ndjson","total_rows":1,"fields":[{"name":"a","data_type":"text","profile":{"total_count":1}}]}', []),
]


def verify_contracts(spark, sf_dir):
    frame = spark.createDataFrame([(i, t) for i, t, _ in _BAD_CONTRACTS], "id int, json string")
    return verify.verify(frame).select("id", "valid", F.array_join("issues", " | ").alias("issues"))


_VERIFY_SQL = _rows_sql("id, valid, issues", [(i, not x, " | ".join(x).replace("'", "''")) for i, _, x in _BAD_CONTRACTS]).replace("'True'", "TRUE")


def verify_profile_bounds(spark, sf_dir):
    """Profiles of a table, spoilt by rule, and the number of issues of each."""
    stats = P.profile(_texts(read(spark, sf_dir, "orders"), *_SHOWN["orders"]), _SHOWN["orders"])
    p = F.struct((F.col("total_count") * F.when(F.col("pos") == 1, -1).otherwise(1)).alias("total_count"), F.when(F.col("pos") == 2, F.col("total_count") + 5).otherwise(F.col("null_count")).alias("null_count"), F.when(F.col("pos") == 3, 130.0).otherwise(F.col("null_percentage")).alias("null_percentage"), F.transform("top_values", lambda t: F.struct(t["value"].alias("value"), F.when(F.col("pos") == 4, F.lit(0).cast("bigint")).otherwise(t["count"]).alias("count"))).alias("top_values"))
    return stats.select("field", p.alias("p")).select("field", F.size(verify.profile_issues(F.col("p"), F.col("field"))).alias("issues"))


_BOUNDS_SQL = "SELECT * FROM (VALUES ('o_orderkey', 0), ('o_custkey', 2), ('o_orderstatus', 2), ('o_totalprice', 2), ('o_orderdate', 5), ('o_orderpriority', 0)) AS t(field, issues)"


def verify_mapping_references(spark, sf_dir):
    rows = [(0, 0, "d", "id", "field", "s", "key"), (0, 1, "d", "email", "field", "s", "mail"), (0, 2, "d", "ghost", "field", "s", "key"), (0, 3, "d", "name", "null", "", ""), (0, 4, "d", "code", "unmapped", "", ""), (1, 0, "other", "x", "field", "unknown", "y")]
    m = spark.createDataFrame(rows, "group int, position int, destination_ref string, destination_field string, source_type string, source_ref string, source_field string")
    s = spark.createDataFrame([("s", "key")], "ref string, name string")
    d = spark.createDataFrame([("d", "id", False, ["primary_key"]), ("d", "email", True, None), ("d", "name", False, ["not_null"]), ("d", "code", False, ["not_null", "unique"])], "ref string, name string, nullable boolean, constraints array<string>")
    return verify.cross_check(m, s, d).withColumnRenamed("group", "grp")


_REFERENCES_SQL = """SELECT * FROM (VALUES (0, 1, 0, '''email'': source field ''mail'' not found in source ''s'''), (0, 2, 1, '''ghost'': destination field not found in destination ''d'''),
 (0, 3, 1, '''name'' is NOT NULL but mapped to NULL'), (0, 4, 1, '''code'' is NOT NULL (UNIQUE) and has no source mapping')) AS t(grp, position, rule, message)"""


def normalize_pg_types(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in [*types.DATABASE_TYPES, "character varying(255)", "numeric(10,2)", "ARRAY", "time without time zone"]], "name string")
    return names.select("name", types.normalize_database_type(F.col("name")).alias("data_type"))


# Contract types of database type names.
_TYPES_SQL = """
SELECT * FROM (VALUES ('integer', 'integer'), ('int', 'integer'), ('int4', 'integer'), ('bigint', 'bigint'), ('int8', 'bigint'), ('smallint', 'smallint'), ('int2', 'smallint'),
  ('text', 'text'), ('character varying', 'varchar'), ('varchar', 'varchar'), ('character', 'char'), ('char', 'char'), ('boolean', 'boolean'), ('bool', 'boolean'),
  ('date', 'date'), ('timestamp', 'timestamp'), ('timestamp without time zone', 'timestamp'), ('timestamp with time zone', 'timestamptz'), ('timestamptz', 'timestamptz'),
  ('numeric', 'numeric'), ('decimal', 'numeric'), ('real', 'real'), ('double precision', 'double'), ('json', 'json'), ('jsonb', 'jsonb'), ('uuid', 'uuid'), ('bytea', 'bytea'),
  ('character varying(255)', 'varchar'), ('numeric(10,2)', 'numeric'), ('ARRAY', 'ARRAY'), ('time without time zone', 'time without time zone')) AS t(name, data_type)
"""
_API_PAIRS = [("integer", "int64", "integer", "integer"), ("string", "date-time", "timestamptz", "date-time"), ("number", "", "numeric", "numeric"), ("string", "uuid", "uuid", "uuid"), ("object", "", "jsonb", "jsonb"), ("", "custom", "custom", "custom"), ("", "", "text", "text"), ("string", "byte", "bytea", "byte"), ("boolean", "", "boolean", "boolean"), ("integer", "int8", "integer", "bigint")]


def map_spec_types(spark, sf_dir):
    pairs = spark.createDataFrame([(k, f) for k, f, _, _ in _API_PAIRS], "kind string, format string")
    return pairs.select("kind", "format", types.map_api_type(F.col("kind"), F.col("format")).alias("api_type"), types.map_table_type(F.col("kind"), F.col("format")).alias("table_type"))


_PETS = '{"openapi":"3.0.0","info":{"title":"Pets"},"paths":{"/pets":{"get":{"responses":{"200":{"content":{"application/json":{"schema":{"type":"array","items":{"$ref":"#/components/schemas/Pet"}}}}}}}},"/owners":{"get":{"responses":{"201":{"content":{"application/json":{"schema":{"type":"object","required":["since"],"properties":{"since":{"type":"string","format":"date"}}}}}}}}}},"components":{"schemas":{"Pet":{"type":"object","required":["id","name"],"properties":{"id":{"type":"integer","format":"int64"},"name":{"type":"string"},"tag":{"type":"string"}}}}}}'


def openapi_flatten(spark, sf_dir):
    return specs.endpoint_fields(spark.createDataFrame([(_PETS,)], "json string"))


_PETS_SQL = "SELECT * FROM (VALUES ('/pets', 'get', 'id', 'integer', TRUE), ('/pets', 'get', 'name', 'text', TRUE), ('/pets', 'get', 'tag', 'text', FALSE), ('/owners', 'get', 'since', 'date', TRUE)) AS t(path, method, field, data_type, required)"


def delimiter_score(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit(';x"')), F.when(F.col("n_regionkey") > 0, F.concat(F.col("n_regionkey").cast("string"), F.lit(",5"))))
    return csv.delimiter_scores(n.select(line.alias("line")))


_SCORE_SQL = r"""SELECT d AS delimiter, CASE WHEN d = ';' THEN (SELECT count(*) FROM nation WHERE n_regionkey > 0) WHEN d = ',' THEN (SELECT greatest(count(*) FILTER (WHERE n_regionkey > 0), count(*) FILTER (WHERE n_regionkey = 0)) FROM nation) ELSE 0 END AS score
FROM (VALUES (','), (';'), (chr(9)), ('|')) AS t(d)"""


def table_profile_supplier(spark, sf_dir):
    """A table's own profile: texts as they are, shares not rounded."""
    out = tables.table_profile(_texts(read(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "s_nationkey", "s_acctbal"), whole=True)
    return out.select("field", "sample_size", "null_count", "null_percentage", "distinct_count", "min_value", "max_value")


_SUPPLIER_SQL = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS sample_size, count(*) - count({c}) AS null_count, 0.0::double AS null_percentage, count(DISTINCT {_show(c)}) AS distinct_count, min({_show(c)}) AS min_value, max({_show(c)}) AS max_value FROM supplier" for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))


def merged_profile_lineitem(spark, sf_dir):
    """Profiles of two halves merged equal the profile of the whole."""
    columns = ("l_returnflag", "l_linestatus", "l_quantity")
    line = read(spark, sf_dir, "lineitem")
    half = lambda keep: P.group_values(P.unpivot(P.with_row_index(_texts(line.filter(keep), *columns)), columns))
    both = P.merge_profiles(half(F.col("l_linenumber") <= 3), half(F.col("l_linenumber") > 3))
    return P.field_stats(both, numeric_range=False).select("field", "total_count", "null_count", "distinct_count", "min_value", "max_value")


_MERGED_SQL = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS total_count, cast(0 AS bigint) AS null_count, count(DISTINCT {_show(c)}) AS distinct_count, min({_show(c)}) AS min_value, max({_show(c)}) AS max_value FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_quantity"))

_ALL = {
    "profile_orders_columns": (profile_orders_columns, _lexical_sql("orders")),
    "profile_lineitem_columns": (profile_lineitem_columns, _lexical_sql("lineitem")),
    "profile_lineitem_numeric_range": (profile_lineitem_numeric_range, _range_sql()),
    "topk_part": (topk_part, _top_sql("part", ("p_type", "p_brand", "p_size"))),
    "topk_events": (topk_events, _top_sql("events", ("event_type", "user_id"))),
    "capped_distinct_customer": (capped_distinct_customer, _CAPPED_SQL),
    "classify_cells_mixed": (classify_cells_mixed, _CLASSIFY_SQL),
    "parse_numeric_locale": (parse_numeric_locale, _PARSE_SQL),
    "header_detect": (header_detect, _HEADER_SQL),
    "json_field_profile_events_props": (json_field_profile_events_props, _PROPS_SQL),
    "json_first_seen_totals": (json_first_seen_totals, _FIRST_SQL),
    "ndjson_bad_lines": (ndjson_bad_lines, _BAD_SQL),
    "null_ratio_documents_labels": (null_ratio_documents_labels, _RATIO_SQL),
    "sample_first_n": (sample_first_n, "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5"),
    "pg_catalog_constraints": (pg_catalog_constraints, _CATALOG_SQL),
    "pg_validation_rules": (pg_validation_rules, _RULES_SQL),
    "pk_candidate_check": (pk_candidate_check, _UNIQUE_SQL),
    "fk_orphans": (fk_orphans, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderstatus"),
    "mapping_suggestions": (mapping_suggestions, _MAPPING_SQL),
    "mapping_overlap_score": (mapping_overlap_score, _OVERLAP_SQL),
    "verify_contracts": (verify_contracts, _VERIFY_SQL),
    "verify_profile_bounds": (verify_profile_bounds, _BOUNDS_SQL),
    "verify_mapping_references": (verify_mapping_references, _REFERENCES_SQL),
    "normalize_pg_types": (normalize_pg_types, _TYPES_SQL),
    "map_spec_types": (map_spec_types, _rows_sql("kind, format, api_type, table_type", _API_PAIRS)),
    "openapi_flatten": (openapi_flatten, _PETS_SQL),
    "delimiter_score": (delimiter_score, _SCORE_SQL),
    "table_profile_supplier": (table_profile_supplier, _SUPPLIER_SQL),
    "merged_profile_lineitem": (merged_profile_lineitem, _MERGED_SQL),
} | contracts.ALL


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
