"""Destination contracts of tables: declared columns and constraints from catalog frames, profiles from a sample."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.types import normalize_database_type, spark_type
from siftwell.operators.profile import profile, sample_rows, with_row_index
from siftwell.options import ProfileOptions

# Kinds of constraints in a catalog and in contracts.
KINDS = {"PRIMARY KEY": "primary_key", "UNIQUE": "unique", "FOREIGN KEY": "foreign_key"}


def quote_identifier(*parts: str) -> str:
    return ".".join('"' + p.replace('"', '""') + '"' for p in parts)


def sanitize_connection(text: str) -> str:
    """user@host:port/database of a connection string, without the password."""
    try:
        u = urlsplit(text)
        if not u.hostname:
            raise ValueError
        return f"{u.username or ''}@{u.hostname}:{u.port or 5432}{u.path}"
    except ValueError:
        return "[connection string]"


def list_tables(tables: DataFrame, schema: str = "public") -> DataFrame:
    return tables.filter((F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE")).select("table_name").orderBy("table_name")


def table_exists(tables: DataFrame, schema: str, table: str) -> bool:
    return tables.filter((F.col("table_schema") == schema) & (F.col("table_name") == table)).limit(1).count() > 0


def full_type() -> Column:
    """varchar(n), numeric(p,s) and so on; without a length the bare name."""
    kind, n = F.col("data_type"), F.col("character_maximum_length").cast("string")
    sized = F.when(kind.isin("character varying", "character"), F.concat(kind, F.lit("("), n, F.lit(")")))
    scaled = F.when((kind == "numeric") & F.col("numeric_precision").isNotNull(), F.concat(kind, F.lit("("), F.col("numeric_precision").cast("string"), F.lit(","), F.coalesce(F.col("numeric_scale"), F.lit(0)).cast("string"), F.lit(")")))
    return F.coalesce(sized, scaled, kind)


def columns_of(columns: DataFrame, schema: str = "public") -> DataFrame:
    """(table_name, pos, name, data_type, nullable) in the tables' order."""
    own = columns.filter(F.col("table_schema") == schema)
    return own.select("table_name", F.col("ordinal_position").alias("pos"), F.col("column_name").alias("name"), normalize_database_type(full_type()).alias("data_type"), (F.col("is_nullable") == "YES").alias("nullable"))


def comments_of(descriptions: DataFrame, classes: DataFrame, attributes: DataFrame, namespaces: DataFrame, schema: str = "public") -> DataFrame:
    """(table_name, name, description) from the four catalog frames that hold it."""
    d = descriptions.join(classes, F.col("objoid") == F.col("class_oid")).join(attributes, (F.col("attrelid") == F.col("class_oid")) & (F.col("attnum") == F.col("objsubid"))).join(namespaces, F.col("relnamespace") == F.col("namespace_oid"))
    return d.filter(F.col("nspname") == schema).select(F.col("relname").alias("table_name"), F.col("attname").alias("name"), "description")


def constraints_of(constraints: DataFrame, keys: DataFrame, referred: DataFrame, schema: str = "public") -> DataFrame:
    """(table_name, name, type, referred_table, referred_column, place), one for each column and constraint."""
    t = constraints.filter((F.col("table_schema") == schema) & F.col("constraint_type").isin(*KINDS)).select("constraint_name", "table_schema", "table_name", "constraint_type")
    k = keys.select("constraint_name", "table_schema", F.col("table_name").alias("key_table"), F.col("column_name").alias("name"), F.col("ordinal_position").alias("place"))
    r = referred.select("constraint_name", "table_schema", F.col("table_name").alias("referred_table"), F.col("column_name").alias("referred_column"))
    out = t.join(k, ["constraint_name", "table_schema"]).filter(F.col("key_table") == F.col("table_name")).join(r, ["constraint_name", "table_schema"], "left")
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("constraint_type")]
    foreign = F.col("constraint_type") == "FOREIGN KEY"
    return out.select("table_name", "name", kind.alias("type"), F.when(foreign, F.col("referred_table")).alias("referred_table"), F.when(foreign, F.col("referred_column")).alias("referred_column"), "place").distinct()


def annotated_fields(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """columns_of() with their constraints as an array, not_null last."""
    c = constraints.groupBy("table_name", "name").agg(F.array_sort(F.collect_list(F.struct("place", "type", "referred_table", "referred_column"))).alias("held"))
    own = F.coalesce(F.transform("held", lambda x: F.struct(x["type"].alias("type"), x["referred_table"].alias("referred_table"), x["referred_column"].alias("referred_column"))), F.expr("cast(array() as array<struct<type:string,referred_table:string,referred_column:string>>)"))
    strict = F.when(~F.col("nullable"), F.expr("array(named_struct('type', 'not_null', 'referred_table', cast(null as string), 'referred_column', cast(null as string)))")).otherwise(F.expr("cast(array() as array<struct<type:string,referred_table:string,referred_column:string>>)"))
    return columns.join(c, ["table_name", "name"], "left").select("table_name", "pos", "name", "data_type", "nullable", F.concat(own, strict).alias("constraints"))


def validation_rules(fields: DataFrame) -> DataFrame:
    """(table_name, required_fields, unique_constraints)."""
    required = F.transform(F.array_sort(F.collect_list(F.when(~F.col("nullable"), F.struct("pos", "name")))), lambda x: x["name"])
    unique = F.exists("constraints", lambda c: c["type"].isin("primary_key", "unique"))
    return fields.groupBy("table_name").agg(required.alias("required_fields"), F.sort_array(F.collect_set(F.when(unique, F.col("name")))).alias("unique_constraints"))


def table_profile(df: DataFrame, options: ProfileOptions = ProfileOptions(), order_by: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Profiles of the first sample_size rows in an order (of all columns that have one, by default), or of the whole
    table: texts as they are, nulls alone are null, all distinct values counted, shares not rounded."""
    order_by = order_by or [f"`{f.name}`" for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    rows = df if whole else (df.orderBy(*order_by) if order_by else df).limit(options.sample_size)
    return profile(rows, None, options, blank_is_null=False, numeric_range=False, round_to=None, cap_distinct=False).withColumnRenamed("total_count", "sample_size")


def declared_fields(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "data_type": spark_type(f.dataType.simpleString()), "nullable": f.nullable, "constraints": [] if f.nullable else [{"type": "not_null"}]} | ({"description": f.metadata["comment"]} if "comment" in f.metadata else {}) for f in df.schema]


def analyze_table(df: DataFrame, name: str, fields: list[dict] | None = None, options: ProfileOptions = ProfileOptions(), namespace: str = "public", order_by: list[str] | None = None) -> dict:
    """A schema of a destination contract. What fails while profiling is an issue, not an error."""
    fields = [dict(f) for f in fields or declared_fields(df)]
    out = {"name": name, "namespace": namespace, "row_count": df.count(), "fields": fields, "issues": []}
    try:
        found = {r["field"]: r for r in table_profile(df, options, order_by).collect()}
        for f in fields:
            r = found.get(f["name"])
            if r is not None:
                f["profile"] = {c: r[c] for c in ("null_count", "null_percentage", "distinct_count", "min_value", "max_value", "sample_size")} | {"top_values": [x.asDict() for x in r["top_values"]]}
        texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
        rows = texts.orderBy(*order_by).limit(options.max_sample_rows) if order_by else sample_rows(with_row_index(texts), options.max_sample_rows).drop("row_idx")
        out["sample_data"] = [["" if x is None else x for x in r] for r in rows.collect()]
    except Exception as e:  # a table that can't be read still has its declared part
        out["issues"].append(f"profiling failed: {e}")
    unique = sorted({f["name"] for f in fields for c in f["constraints"] if c["type"] in ("primary_key", "unique")})
    out["validation_rules"] = {"required_fields": [f["name"] for f in fields if not f["nullable"]], "unique_constraints": unique}
    return out


def analyze_database(spark: SparkSession, catalog: dict[str, DataFrame], read: Callable[[str], DataFrame], database: str = "database", options: ProfileOptions = ProfileOptions()) -> dict:
    """A destination contract of all tables of a schema.

    catalog: frames tables, columns, table_constraints, key_column_usage, constraint_column_usage and, for comments,
    column_comments (table_name, name, description). read: the frame of a table, such as spark.read.jdbc gives.
    """
    fields = annotated_fields(columns_of(catalog["columns"], options.schema), constraints_of(catalog["table_constraints"], catalog["key_column_usage"], catalog["constraint_column_usage"], options.schema))
    if options.include_comments and "column_comments" in catalog:
        fields = fields.join(catalog["column_comments"].select("table_name", "name", "description"), ["table_name", "name"], "left")
    else:
        fields = fields.withColumn("description", F.lit(None).cast("string"))
    held: dict[str, list[dict]] = {}
    for r in fields.orderBy("table_name", "pos").collect():
        constraints = [{k: v for k, v in c.asDict().items() if v is not None} for c in r["constraints"]]
        held.setdefault(r["table_name"], []).append({"name": r["name"], "data_type": r["data_type"], "nullable": r["nullable"], "constraints": constraints} | ({"description": r["description"]} if r["description"] else {}))
    names = [r["table_name"] for r in list_tables(catalog["tables"], options.schema).collect()]
    schemas = [analyze_table(read(t), t, held.get(t), options, options.schema) for t in names]
    return {"contract_type": "destination", "id": database, "schemas": schemas, "metadata": {"schema_count": len(schemas)}}


# The views of a database that describe its tables, and the columns read of each.
CATALOG = {
    "tables": "table_schema, table_name, table_type",
    "columns": "table_schema, table_name, column_name, data_type, is_nullable, character_maximum_length, numeric_precision, numeric_scale, ordinal_position",
    "table_constraints": "constraint_name, table_schema, table_name, constraint_type",
    "key_column_usage": "constraint_name, table_schema, table_name, column_name, ordinal_position",
    "constraint_column_usage": "constraint_name, table_schema, table_name, column_name",
}


def jdbc_reader(spark: SparkSession, url: str, properties: dict[str, str] | None = None, options: ProfileOptions = ProfileOptions()) -> Callable[[str], DataFrame]:
    """Reads a table or a query in brackets from a database, batch_size rows at a time."""
    return lambda what: spark.read.jdbc(url, what, properties={"fetchsize": str(options.batch_size)} | (properties or {}))


def read_catalog(read: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The catalog frames of analyze_database() from a database's information schema."""
    return {view: read(f"(select {columns} from information_schema.{view}) v") for view, columns in CATALOG.items()}


def analyze_jdbc(spark: SparkSession, url: str, properties: dict[str, str] | None = None, options: ProfileOptions = ProfileOptions(), table: str | None = None) -> dict:
    """The destination contract of a database's schema, or of one of its tables."""
    read = jdbc_reader(spark, url, properties, options)
    catalog = read_catalog(read)
    if table is not None:
        catalog["tables"] = one_table(catalog["tables"], options.schema, table)
    return analyze_database(spark, catalog, lambda t: read(quote_identifier(options.schema, t)), sanitize_connection(url), options)


def one_table(tables: DataFrame, schema: str, table: str) -> DataFrame:
    if not table_exists(tables, schema, table):
        raise ValueError(f"there is no table {table} in schema {schema}")
    return tables.filter(F.col("table_name") == table)
