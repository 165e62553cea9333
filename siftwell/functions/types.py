"""Names of types in database catalogs and API specifications, brought to the contracts' own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Database type names.
DATABASE_TYPES = {
    "integer": "integer",
    "int": "integer",
    "int4": "integer",
    "bigint": "bigint",
    "int8": "bigint",
    "smallint": "smallint",
    "int2": "smallint",
    "text": "text",
    "character varying": "varchar",
    "varchar": "varchar",
    "character": "char",
    "char": "char",
    "boolean": "boolean",
    "bool": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz",
    "timestamptz": "timestamptz",
    "numeric": "numeric",
    "decimal": "numeric",
    "real": "real",
    "double precision": "double",
    "json": "json",
    "jsonb": "jsonb",
    "uuid": "uuid",
    "bytea": "bytea",
}
# Formats and types of API specifications.
API_FORMATS = {"int32": "integer", "int64": "integer", "float": "numeric", "double": "numeric", "date": "date", "date-time": "timestamptz", "byte": "bytea", "binary": "bytea", "uuid": "uuid"}
API_TYPES = {"integer": "integer", "number": "numeric", "boolean": "boolean", "string": "text", "object": "jsonb"}
# Formats of table specifications.
TABLE_FORMATS = {
    "integer": "integer",
    "int4": "integer",
    "bigint": "bigint",
    "int8": "bigint",
    "smallint": "smallint",
    "int2": "smallint",
    "numeric": "numeric",
    "decimal": "numeric",
    "real": "real",
    "float4": "real",
    "double precision": "double",
    "float8": "double",
    "boolean": "boolean",
    "date": "date",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz",
    "timestamptz": "timestamptz",
    "time without time zone": "time",
    "time": "time",
    "time with time zone": "timetz",
    "timetz": "timetz",
    "uuid": "uuid",
    "json": "json",
    "jsonb": "jsonb",
    "bytea": "bytea",
    "text": "text",
    "character varying": "varchar",
    "character": "char",
}
TABLE_TYPES = {"integer": "integer", "number": "numeric", "boolean": "boolean", "object": "jsonb"}
#: Contract types of Spark's own.
SPARK_TYPES = {"tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double", "boolean": "boolean", "string": "text", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea", "variant": "jsonb"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def normalize_database_type(name: Column) -> Column:
    """An exact name first, then the name before a bracket; unknown names stay."""
    return F.coalesce(_lookup(DATABASE_TYPES, name), _lookup(DATABASE_TYPES, F.regexp_replace(name, r"(?s)\(.*\z", "")), name)


def map_api_type(kind: Column, form: Column) -> Column:
    """For other than arrays."""
    return F.coalesce(_lookup(API_FORMATS, form), _lookup(API_TYPES, kind), F.nullif(form, F.lit("")), F.nullif(kind, F.lit("")), F.lit("text"))


def map_table_type(kind: Column, form: Column) -> Column:
    return F.coalesce(_lookup(TABLE_FORMATS, form), _lookup(TABLE_TYPES, kind), F.nullif(form, F.lit("")), F.nullif(kind, F.lit("")), F.lit("text"))


def property_type(prop: dict, formats: dict[str, str] = API_FORMATS, types: dict[str, str] = API_TYPES) -> str:
    """Type of a specification's property, items of arrays included."""
    text = lambda key: v if isinstance(v := prop.get(key), str) else ""
    form, kind = text("format"), text("type")
    if form in formats:
        return formats[form]
    if kind == "array":
        items = prop.get("items")
        return f"array[{property_type(items, formats, types)}]" if isinstance(items, dict) else "array[text]"
    return types.get(kind) or form or kind or "text"


def spark_type(name: str) -> str:
    """Contract type of a Spark type's simple name."""
    if name.startswith("decimal"):
        return "numeric"
    if name.startswith("array<"):
        return f"array[{spark_type(name[6:-1])}]"
    return SPARK_TYPES.get(name, "jsonb" if name.startswith(("struct", "map")) else "text")
