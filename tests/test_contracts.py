import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from siftwell.operators import mapping, verify
from siftwell.sources import specs


def issues(spark, contract):
    return verify.verify_text(spark, contract if isinstance(contract, str) else json.dumps(contract))


def test_positive_contracts(spark):
    ok = {"contract_type": "destination", "id": "d", "schemas": [{"name": "t", "fields": [{"name": "id", "data_type": "integer", "nullable": False, "constraints": [{"type": "not_null"}, {"type": "primary_key"}]}], "validation_rules": {"required_fields": ["id"], "unique_constraints": ["id"]}}]}
    assert issues(spark, ok) == {"valid": True, "contract_type": "destination", "issues": []}
    ok = {"contract_type": "source", "source_format": "csv", "delimiter": ",", "has_header": False, "total_rows": 2, "fields": [{"name": "a", "data_type": "text", "profile": {"total_count": 2, "null_count": 1, "null_percentage": 50.4, "top_values": [{"value": "x", "count": 1}]}}]}
    assert issues(spark, ok)["issues"] == []


@pytest.mark.parametrize(
    ("contract", "message"),
    [
        ({"contract_type": "source"}, "missing source_format"),
        ({"contract_type": "source", "source_format": "xml"}, 'unknown source_format: "xml"'),
        ({"contract_type": "source", "source_format": "csv", "delimiter": ","}, "CSV contract missing has_header"),
        ({"contract_type": "source", "source_format": "json", "total_rows": 1}, "total_rows > 0 but no fields defined"),
        ({"contract_type": "source", "source_format": "json", "fields": [{"data_type": "text"}]}, "fields[0]: missing name"),
        ({"contract_type": "source", "source_format": "json", "fields": [{"name": "a", "data_type": "text", "profile": {"total_count": 4, "null_count": 1, "null_percentage": 50}}]}, "fields[0].profile: null_percentage 50.00 inconsistent with null_count/total_count (expected ~25.00)"),
        ({"contract_type": "source", "source_format": "json", "fields": [{"name": "a", "data_type": "text", "profile": {"top_values": [{"value": "x"}]}}]}, "fields[0].profile.top_values[0]: count must be positive"),
        ({"contract_type": "destination", "schemas": []}, "missing id"),
        ({"contract_type": "destination", "id": "d"}, "no schemas defined"),
        ({"contract_type": "destination", "id": "d", "schemas": [{"name": "a"}, {"name": "a"}]}, 'schemas[1]: duplicate name "a"'),
        ({"contract_type": "destination", "id": "d", "schemas": [{"name": "a", "fields": [{"name": "x", "data_type": "array[text]", "nullable": True}]}]}, 'schemas[0].fields[0]: unknown data_type "array[text]"'),
        ({"contract_type": "destination", "id": "d", "schemas": [{"name": "a", "fields": [{"name": "x", "data_type": "text", "nullable": True, "constraints": [{"type": "odd"}, {}]}]}]}, 'schemas[0].fields[0].constraints[0]: unknown constraint type "odd"'),
        ({"contract_type": "destination", "id": "d", "schemas": [{"name": "a", "validation_rules": {"unique_constraints": ["q"]}}]}, 'schemas[0].validation_rules: unique_constraints references unknown field "q"'),
        ({"contract_type": "transformation"}, "missing source_refs"),
        ({"contract_type": "transformation", "source_refs": ["s"], "destination_refs": ["d"], "mapping_groups": [{"field_mappings": [{"source_type": "guess"}]}]}, 'mapping_groups[0].field_mappings[0] (#0): unknown source_type "guess"'),
        ({"contract_type": "transformation", "source_refs": ["s"], "destination_refs": ["d"], "mapping_groups": [{"destination_ref": "d", "field_mappings": [{"destination_field": "x", "transformation": {"type": "magic"}}]}]}, 'mapping_groups[0].field_mappings[0] (x).transformation: unknown type "magic"'),
        ({"contract_type": "transformation", "execution_plan": {"error_threshold": 2}}, "execution_plan: error_threshold 2.00 out of range [0, 1]"),
        ({"x": 1}, "missing or empty contract_type field"),
        ("[1]", "invalid JSON"),
    ],
)
def test_each_rule(spark, contract, message):
    got = issues(spark, contract)
    assert message in got["issues"] and not got["valid"]


def test_context(spark):
    t = {"contract_type": "transformation", "source_refs": ["s"], "destination_refs": ["d"], "mapping_groups": [{"destination_ref": "d", "field_mappings": [{"destination_field": "id", "source_type": "field", "source_ref": "s", "source_field": "nope"}, {"destination_field": "name", "source_type": "null"}, {"destination_field": "zip", "source_type": "constant"}]}]}
    s = json.dumps({"fields": [{"name": "key"}]})
    d = json.dumps({"schemas": [{"fields": [{"name": "id", "nullable": False}, {"name": "name", "nullable": False, "constraints": [{"type": "primary_key"}]}]}]})
    got = verify.verify_with_context(spark, json.dumps(t), {"s": s}, {"d": d})
    assert got["issues"] == ["'id': source field 'nope' not found in source 's'", "'name' is NOT NULL (PRIMARY KEY) but mapped to NULL", "'zip': destination field not found in destination 'd'"]
    assert verify.verify_with_context(spark, json.dumps(t), {}, {})["valid"]


def test_mapping_group_is_valid_and_applies(spark):
    sources = spark.createDataFrame([("s", 0, 0, "Order-ID", "text"), ("s", 0, 1, "total", "text")], "ref string, src_idx int, fld_idx int, name string, data_type string")
    dest = spark.createDataFrame([(0, "order_id", "integer", False), (1, "Total", "numeric", True), (2, "note", "text", True)], "idx int, name string, data_type string, nullable boolean")
    group = mapping.mapping_group(mapping.suggest(sources, dest, "d").collect(), "d")
    assert [m["confidence"] for m in group["field_mappings"]] == [0.7, 0.9, 0.0]
    contract = mapping.new_transformation("t", "s", "d") | {"mapping_groups": [group]}
    assert verify.verify_text(spark, json.dumps(contract))["valid"]
    df = spark.createDataFrame([("7", "1.5"), ("x", "2")], "`Order-ID` string, total string")
    out = mapping.apply_mappings(df, group).collect()
    assert [r["order_id"] for r in out] == [7, None] and out[0]["note"] is None


PETS = {
    "openapi": "3.0.1",
    "info": {"title": "Pets"},
    "paths": {
        "/pets": {
            "get": {"summary": "List", "responses": {"200": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Pet"}}}}}}},
            "post": {"requestBody": {"required": True, "content": {"text/xml": {"schema": {"$ref": "#/components/schemas/New"}}}}, "responses": {"201": {"description": "made"}}},
            "delete": {"responses": {"204": {"description": "gone"}}},
            "x-other": {},
        }
    },
    "components": {"schemas": {"Pet": {"required": ["id"], "properties": {"id": {"type": "integer", "format": "int64"}, "parent": {"$ref": "#/components/schemas/Pet"}, "tags": {"type": "array", "items": {"type": "string"}}}}, "New": {"properties": {"name": {"type": "string", "description": "its name"}}}}},
}


def test_openapi():
    c = specs.analyze_spec(PETS, "u")
    assert [s["name"] for s in c["schemas"]] == ["GET /pets", "POST /pets"] and c["id"] == "Pets"
    get, post = c["schemas"]
    assert [(f["name"], f["data_type"], f["nullable"]) for f in get["fields"]] == [("id", "integer", False), ("parent", "text", True), ("tags", "array[text]", True)]
    assert get["validation_rules"] == {"required_fields": ["id"]} and get["description"] == "List"
    assert post["fields"][0]["description"] == "its name" and post["metadata"]["request_body"]["required"] is True
    v2 = {"swagger": "2.0", "paths": {"/a": {"put": {"parameters": [{"in": "body", "schema": {"$ref": "#/definitions/A"}}]}, "get": {"responses": {"200": {"schema": {"type": "array", "items": {"$ref": "#/definitions/A"}}, "examples": {"application/json": [1]}}}}}}, "definitions": {"A": {"properties": {"b": {"type": "boolean"}}}}}
    c = specs.analyze_spec(v2, "http://x")
    assert [s["name"] for s in c["schemas"]] == ["GET /a", "PUT /a"] and c["id"] == "http://x" and c["schemas"][0]["metadata"]["responses"]["200"]["example"] == [1]
    for bad in ({}, {"openapi": "4.0"}):
        with pytest.raises(ValueError):
            specs.analyze_spec(bad)


def test_tables_of_a_project_and_fetching():
    raw = {"paths": {"/": {}, "/users": {}, "/rpc/f": {}, "/none": {}}, "definitions": {"users": {"required": ["id"], "properties": {"id": {"type": "string", "format": "uuid"}, "at": {"type": "string", "format": "timestamp with time zone"}}}}}
    seen = {}

    def get(url, headers):
        seen.update(headers, url=url)
        return raw

    c = specs.analyze_project("https://abc.supabase.co/", "k", get)
    assert c["id"] == "abc" and [f["data_type"] for f in c["schemas"][0]["fields"]] == ["timestamptz", "uuid"]
    assert seen["url"] == "https://abc.supabase.co/rest/v1/" and seen["Authorization"] == "Bearer k"
    for url, key in (("http://abc.supabase.co", "k"), ("https://abc.supabase.co", "")):
        with pytest.raises(ValueError):
            specs.analyze_project(url, key, get)

    class Reply(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/spec" else 401)
            self.end_headers()
            self.wfile.write(json.dumps(PETS).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert specs.analyze_url(f"{at}/spec")["id"] == "Pets"
    with pytest.raises(ConnectionError):
        specs.analyze_url(f"{at}/none")
    server.shutdown()


def test_references_to_contracts_without_fields(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "ref string, json string")
    sources = verify.source_fields(frame({"s": '{"fields": []}', "t": "no json", "u": "{}"}))
    destinations = verify.destination_fields(frame({"d": '{"schemas": [{"fields": []}]}', "e": "{}", "x": "[1]"}))
    assert {r["ref"] for r in sources.collect()} == {"s", "u"} and {r["ref"] for r in destinations.collect()} == {"d", "e"}
    rows = [(0, i, d, "id", "field", s, "a") for i, (d, s) in enumerate([("d", "s"), ("e", "u"), ("x", "t"), ("nowhere", "nowhere")])]
    m = spark.createDataFrame(rows, "group int, position int, destination_ref string, destination_field string, source_type string, source_ref string, source_field string")
    got = sorted((r["position"], r["rule"]) for r in verify.cross_check(m, sources, destinations).collect())
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_readable_schemas():
    tree = {"type": "object", "properties": {"next": {"$ref": "#/definitions/Node"}}, "required": [], "default": 1, "description": "", "enum": None}
    spec = specs.Swagger2({"swagger": "2.0", "definitions": {"Node": tree}})
    shown = spec.readable(spec.resolve(tree))
    depth = 0
    while "properties" in shown:
        assert shown["description"] == "" and shown["required"] == [] and "default" not in shown and "enum" not in shown
        shown, depth = shown["properties"]["next"], depth + 1
    assert depth == 10 and shown == {"_truncated": "max depth reached"}
    assert spec.readable({"properties": {}}) == {"properties": {}}
    found = specs.analyze_tables({"paths": {}, "definitions": {}}, "ref", "https://ref.supabase.co")
    assert found["metadata"] == {"source": "supabase", "project_url": "https://ref.supabase.co", "table_count": 0}
