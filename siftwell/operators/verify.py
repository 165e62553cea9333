"""Contract validation: each rule is an expression over parsed contracts, the issues of all rules are one array.

A frame of contracts (id, json) is checked in one projection without any shuffle, however many there are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import cells

# The vocabularies that contracts may use.
SOURCE_FORMATS = ("csv", "json", "ndjson")
SOURCE_TYPES = ("text", "numeric", "date", "boolean", "object", "array", "null", "empty")
DESTINATION_TYPES = ("integer", "bigint", "smallint", "text", "varchar", "char", "boolean", "date", "timestamp", "timestamptz", "time", "timetz", "numeric", "real", "double", "json", "jsonb", "uuid", "bytea")
CONSTRAINTS = ("not_null", "unique", "primary_key", "foreign_key")
MAPPING_SOURCES = ("field", "null", "constant", "unmapped", "transform")
TRANSFORMATIONS = ("rename", "cast", "format", "default")

_PROFILE = "struct<total_count:bigint,null_count:bigint,null_percentage:double,top_values:array<struct<value:string,count:bigint>>>"
SOURCE = f"struct<source_format:string,delimiter:string,has_header:boolean,total_rows:bigint,fields:array<struct<name:string,data_type:string,profile:{_PROFILE}>>>"
_CONSTRAINT = "struct<type:string,referred_table:string,referred_column:string>"
_FIELD = f"struct<name:string,data_type:string,nullable:boolean,constraints:array<{_CONSTRAINT}>>"
DESTINATION = f"struct<id:string,schemas:array<struct<name:string,row_count:bigint,fields:array<{_FIELD}>,validation_rules:struct<required_fields:array<string>,unique_constraints:array<string>>>>>"
_MAPPING = "struct<destination_field:string,source_type:string,source_ref:string,source_field:string,confidence:double,transformation:struct<type:string>>"
TRANSFORMATION = f"struct<source_refs:array<string>,destination_refs:array<string>,mapping_groups:array<struct<destination_ref:string,field_mappings:array<{_MAPPING}>>>,execution_plan:struct<batch_size:bigint,error_threshold:double>>"
NO_ISSUES = "array<string>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _quoted(c: Column) -> Column:
    """As in a program text, with its quotes and backslashes escaped."""
    return F.to_json(F.struct(_text(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(_text(c).alias("x")))) - 6)


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _issues(*rules: tuple[Column, Column]) -> Column:
    """Messages of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), message) for broken, message in rules)))


def _none() -> Column:
    return F.array().cast(NO_ISSUES)


def _each(items: Column, of) -> Column:
    """Issues of all items; of(item, number)."""
    return F.coalesce(F.flatten(F.transform(items, of)), _none())


def _fixed(number: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(number, F.lit(0.0)))


def _seen_before(items: Column, number: Column, name: Column) -> Column:
    return F.exists(F.slice(items, 1, F.greatest(number, F.lit(0))), lambda x: x["name"] == name)


def _name_rules(items: Column, x: Column, i: Column, prefix: Column, what: str) -> list[tuple[Column, Column]]:
    missing = _text(x["name"]) == ""
    return [(missing, _say(prefix, ": missing name")), (~missing & _seen_before(items, i, x["name"]), _say(prefix, f": duplicate {what} ", _quoted(x["name"])))]


def _type_rules(x: Column, prefix: Column, known: tuple[str, ...]) -> list[tuple[Column, Column]]:
    kind = _text(x["data_type"])
    return [(kind == "", _say(prefix, ": missing data_type")), ((kind != "") & ~kind.isin(*known), _say(prefix, ": unknown data_type ", _quoted(kind)))]


def profile_issues(p: Column, prefix: Column) -> Column:
    total, nulls, share = (F.coalesce(p[c], F.lit(0)) for c in ("total_count", "null_count", "null_percentage"))
    expected = F.when(total > 0, nulls / total * 100)
    at = _say(prefix, ".profile")
    own = _issues(
        (total < 0, _say(at, ": total_count is negative")),
        (nulls < 0, _say(at, ": null_count is negative")),
        (nulls > total, _say(at, ": null_count (", nulls.cast("string"), ") > total_count (", total.cast("string"), ")")),
        ((share < 0) | (share > 100), _say(at, ": null_percentage ", _fixed(share.cast("double")), " out of range [0, 100]")),
        (F.abs(share - expected) > 1.0, _say(at, ": null_percentage ", _fixed(share.cast("double")), " inconsistent with null_count/total_count (expected ~", _fixed(expected), ")")),
    )
    top = _each(p["top_values"], lambda t, j: _issues((F.coalesce(t["count"], F.lit(0)) <= 0, _say(at, ".top_values[", j.cast("string"), "]: count must be positive"))))
    return F.concat(own, top)


def source_issues(c: Column, types: tuple[str, ...] = SOURCE_TYPES, formats: tuple[str, ...] = SOURCE_FORMATS) -> Column:
    kind, rows, fields = _text(c["source_format"]), F.coalesce(c["total_rows"], F.lit(0)), c["fields"]
    own = _issues(
        (kind == "", F.lit("missing source_format")),
        ((kind != "") & ~kind.isin(*formats), _say("unknown source_format: ", _quoted(kind))),
        ((kind == "csv") & (_text(c["delimiter"]) == ""), F.lit("CSV contract missing delimiter")),
        ((kind == "csv") & c["has_header"].isNull(), F.lit("CSV contract missing has_header")),
        (rows < 0, _say("total_rows is negative: ", rows.cast("string"))),
        ((rows > 0) & (F.coalesce(F.size(fields), F.lit(0)) <= 0), F.lit("total_rows > 0 but no fields defined")),
    )

    def field(f: Column, i: Column) -> Column:
        at = _say("fields[", i.cast("string"), "]")
        return F.concat(_issues(*_name_rules(fields, f, i, at, "field name"), *_type_rules(f, at, types)), profile_issues(f["profile"], at))

    return F.concat(own, _each(fields, field))


def constraint_issues(k: Column, prefix: Column) -> Column:
    kind = _text(k["type"])
    foreign = kind == "foreign_key"
    return _issues(
        (kind == "", _say(prefix, ": missing type")),
        ((kind != "") & ~kind.isin(*CONSTRAINTS), _say(prefix, ": unknown constraint type ", _quoted(kind))),
        (foreign & (_text(k["referred_table"]) == ""), _say(prefix, ": foreign_key constraint missing referred_table")),
        (foreign & (_text(k["referred_column"]) == ""), _say(prefix, ": foreign_key constraint missing referred_column")),
    )


def schema_issues(schema: Column, prefix: Column, types: tuple[str, ...] = DESTINATION_TYPES) -> Column:
    fields, rules = schema["fields"], schema["validation_rules"]
    names = F.coalesce(F.transform(fields, lambda f: f["name"]), _none())

    def field(f: Column, i: Column) -> Column:
        at = _say(prefix, ".fields[", i.cast("string"), "]")
        own = _issues(*_name_rules(fields, f, i, at, "field name"), *_type_rules(f, at, types))
        return F.concat(own, _each(f["constraints"], lambda k, j: constraint_issues(k, _say(at, ".constraints[", j.cast("string"), "]"))))

    def refers(rule: str) -> Column:
        unknown = F.filter(rules[rule], lambda n: (n == "") | ~F.array_contains(names, n))
        return _each(unknown, lambda n, _: F.array(_say(prefix, f".validation_rules: {rule} references unknown field ", _quoted(n))))

    def coherent(f: Column, _: Column) -> Column:
        some = F.coalesce(F.size(f["constraints"]), F.lit(0)) > 0
        stated = F.coalesce(F.exists(f["constraints"], lambda k: k["type"] == "not_null"), F.lit(False))
        return _issues((~F.coalesce(f["nullable"], F.lit(False)) & some & ~stated, _say(prefix, ": field ", _quoted(f["name"]), " is not nullable but has no not_null constraint")))

    return F.concat(_each(fields, field), refers("required_fields"), refers("unique_constraints"), _each(fields, coherent))


def destination_issues(c: Column, types: tuple[str, ...] = DESTINATION_TYPES) -> Column:
    schemas = c["schemas"]
    own = _issues((_text(c["id"]) == "", F.lit("missing id")), (F.coalesce(F.size(schemas), F.lit(0)) <= 0, F.lit("no schemas defined")))

    def schema(s: Column, i: Column) -> Column:
        at = _say("schemas[", i.cast("string"), "]")
        return F.concat(_issues(*_name_rules(schemas, s, i, at, "name"), (s["row_count"] < 0, _say(at, ": row_count is negative"))), schema_issues(s, at, types))

    return F.concat(own, _each(schemas, schema))


def transformation_issues(c: Column) -> Column:
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    own = _issues((empty(c["source_refs"]), F.lit("missing source_refs")), (empty(c["destination_refs"]), F.lit("missing destination_refs")), (empty(c["mapping_groups"]), F.lit("no mapping_groups defined")))

    def mapping(m: Column, i: Column, group: Column) -> Column:
        at = _say(group, ".field_mappings[", i.cast("string"), "]")
        name, kind, share = _text(m["destination_field"]), _text(m["source_type"]), F.coalesce(m["confidence"], F.lit(0.0))
        label = _say(at, " (", F.when(name == "", _say("#", i.cast("string"))).otherwise(name), ")")
        change = m["transformation"]
        how = _text(change["type"])
        return _issues(
            (name == "", _say(at, ": missing destination_field")),
            ((kind != "") & ~kind.isin(*MAPPING_SOURCES), _say(label, ": unknown source_type ", _quoted(kind))),
            ((kind == "field") & (_text(m["source_field"]) == ""), _say(label, ': source_type is "field" but source_field is empty')),
            ((share < 0) | (share > 1), _say(label, ": confidence ", _fixed(share), " out of range [0, 1]")),
            (change.isNotNull() & (how == ""), _say(label, ".transformation: missing type")),
            ((how != "") & ~how.isin(*TRANSFORMATIONS), _say(label, ".transformation: unknown type ", _quoted(how))),
        )

    def group(g: Column, i: Column) -> Column:
        at = _say("mapping_groups[", i.cast("string"), "]")
        own = _issues((_text(g["destination_ref"]) == "", _say(at, ": missing destination_ref")), (empty(g["field_mappings"]), _say(at, ": no field_mappings defined")))
        return F.concat(own, _each(g["field_mappings"], lambda m, j: mapping(m, j, at)))

    plan = c["execution_plan"]
    last = _issues(
        (plan["batch_size"] < 0, _say("execution_plan: batch_size is negative: ", plan["batch_size"].cast("string"))),
        ((plan["error_threshold"] < 0) | (plan["error_threshold"] > 1), _say("execution_plan: error_threshold ", _fixed(plan["error_threshold"]), " out of range [0, 1]")),
    )
    return F.concat(own, _each(c["mapping_groups"], group), last)


def verify(contracts: DataFrame, id: str = "id", text: str = "json", source_types: tuple[str, ...] = SOURCE_TYPES, destination_types: tuple[str, ...] = DESTINATION_TYPES) -> DataFrame:
    """(id, valid, contract_type, issues) for every contract."""
    v = F.try_parse_json(F.col(text))
    kind = F.get_json_object(F.col(text), "$.contract_type")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    parse = lambda schema: F.from_json(F.col(text), schema)
    issues = (
        F.when(v.isNull() | ~is_object, F.array(F.lit("invalid JSON")))
        .when(_text(kind) == "", F.array(F.lit("missing or empty contract_type field")))
        .when(kind == "source", source_issues(parse(SOURCE), source_types))
        .when(kind == "destination", destination_issues(parse(DESTINATION), destination_types))
        .when(kind == "transformation", transformation_issues(parse(TRANSFORMATION)))
        .otherwise(F.array(_say("unknown contract_type: ", _quoted(kind))))
    )
    out = contracts.select(id, F.when(is_object, F.nullif(kind, F.lit(""))).alias("contract_type"), issues.alias("issues"))
    return out.select(id, (F.size("issues") == 0).alias("valid"), "contract_type", "issues")


def verify_text(spark: SparkSession, text: str) -> dict:
    r = verify(spark.createDataFrame([(0, text)], "id int, json string")).first()
    return {"valid": r["valid"], "contract_type": r["contract_type"], "issues": r["issues"]}


def verify_file(spark: SparkSession, path: str) -> DataFrame:
    """All contracts below a path, a file each."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("id"), F.col("value").alias("json"))
    return verify(files)


def _objects(contracts: DataFrame, text: str) -> DataFrame:
    return contracts.filter(F.schema_of_variant(F.try_parse_json(F.col(text))).startswith("OBJECT"))


def source_fields(contracts: DataFrame, ref: str = "ref", text: str = "json") -> DataFrame:
    """(ref, name) of the fields of source contracts, at the top or in their schemas; a contract without fields has a row
    without a name, one that is no JSON object none."""
    contracts = _objects(contracts, text)
    c = F.from_json(F.col(text), "struct<fields:array<struct<name:string>>,schemas:array<struct<fields:array<struct<name:string>>>>>")
    inner = F.coalesce(F.flatten(F.transform(c["schemas"], lambda s: F.coalesce(s["fields"], F.array().cast("array<struct<name:string>>")))), F.array().cast("array<struct<name:string>>"))
    every = F.concat(F.coalesce(c["fields"], F.array().cast("array<struct<name:string>>")), inner)
    return contracts.select(F.col(ref).alias("ref"), F.explode_outer(every).alias("f")).select("ref", "f.name").distinct()


def destination_fields(contracts: DataFrame, ref: str = "ref", text: str = "json") -> DataFrame:
    """(ref, name, nullable, constraints): of fields with the same name that of the last schema counts. Contracts without
    fields and those that are no JSON object are as in source_fields()."""
    contracts = _objects(contracts, text)
    c = F.from_json(F.col(text), DESTINATION)
    rows = contracts.select(F.col(ref).alias("ref"), F.posexplode_outer(c["schemas"]).alias("s", "schema")).select("ref", "s", F.posexplode_outer("schema.fields").alias("i", "f"))
    return rows.groupBy("ref", F.col("f.name").alias("name")).agg(F.max_by("f", F.struct("s", "i")).alias("f")).select("ref", "name", F.coalesce("f.nullable", F.lit(False)).alias("nullable"), F.transform("f.constraints", lambda k: k["type"]).alias("constraints"))


def cross_check(mappings: DataFrame, sources: DataFrame, destinations: DataFrame) -> DataFrame:
    """(group, position, rule, message) for mappings (group, position, destination_ref, destination_field, source_type,
    source_ref, source_field) against the fields of the contracts that are at hand; other references aren't checked."""
    m = mappings
    known_sources = sources.select(F.col("ref").alias("source_ref")).distinct()
    asked = m.filter("source_type = 'field' and source_field <> '' and source_ref <> ''").join(known_sources, "source_ref", "left_semi")
    lost = asked.join(sources.select(F.col("ref").alias("source_ref"), F.col("name").alias("source_field")), ["source_ref", "source_field"], "left_anti")
    first = lost.select("group", "position", F.lit(0).alias("rule"), _say("'", F.col("destination_field"), "': source field '", F.col("source_field"), "' not found in source '", F.col("source_ref"), "'").alias("message"))
    known = destinations.select(F.col("ref").alias("destination_ref")).distinct()
    held = destinations.select(F.col("ref").alias("destination_ref"), F.col("name").alias("destination_field"), "nullable", "constraints")
    placed = m.filter("destination_field <> ''").join(known, "destination_ref", "left_semi").join(held, ["destination_ref", "destination_field"], "left")
    suffix = cells.constraint_suffix(F.coalesce("constraints", _none()))
    strict = F.coalesce(~F.col("nullable"), F.lit(False))
    kind = _text(F.col("source_type"))
    message = (
        F.when(F.col("nullable").isNull(), _say("'", F.col("destination_field"), "': destination field not found in destination '", F.col("destination_ref"), "'"))
        .when(strict & (kind == "null"), _say("'", F.col("destination_field"), "' is NOT NULL", suffix, " but mapped to NULL"))
        .when(strict & kind.isin("unmapped", ""), _say("'", F.col("destination_field"), "' is NOT NULL", suffix, " and has no source mapping"))
    )
    second = placed.select("group", "position", F.lit(1).alias("rule"), message.alias("message")).filter("message is not null")
    return first.unionByName(second)


def verify_with_context(spark: SparkSession, text: str, sources: dict[str, str], destinations: dict[str, str]) -> dict:
    """A transformation contract against its source and destination contracts, all as JSON texts."""
    own = verify_text(spark, text)
    if not own["valid"]:
        return own
    frame = lambda d: spark.createDataFrame(list(d.items()), "ref string, json string")
    groups = json.loads(text).get("mapping_groups") or []
    rows = [(g, i, group.get("destination_ref") or "", *(m.get(c) or "" for c in ("destination_field", "source_type", "source_ref", "source_field"))) for g, group in enumerate(groups) for i, m in enumerate(group.get("field_mappings") or [])]
    mappings = spark.createDataFrame(rows, "group int, position int, destination_ref string, destination_field string, source_type string, source_ref string, source_field string")
    issues = [r["message"] for r in cross_check(mappings, source_fields(frame(sources)), destination_fields(frame(destinations))).orderBy("group", "position", "rule").collect()]
    return {"valid": not issues, "contract_type": "transformation", "issues": issues}
