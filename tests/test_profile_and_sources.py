import io
import json
import zipfile

import pytest

from siftwell.operators import profile as P
from siftwell.options import ProfileOptions
from siftwell.sources import csv, tables, xlsx
from siftwell.sources import json as J


def test_options_fall_back_to_defaults():
    o = ProfileOptions(top_n=0, max_tracked=-1, max_sample_rows=None, schema="")
    assert (o.top_n, o.max_tracked, o.max_sample_rows, o.schema) == (5, 10_000, 5, "public")


def test_profile_range_cap_and_ties(spark):
    df = spark.createDataFrame([("5",), ("5.0",), ("10",), (" ",), (None,), ("9",)], "v string")
    r = P.profile(df.coalesce(1)).first()
    assert (r["total_count"], r["null_count"], r["null_percentage"], r["distinct_count"], r["min_value"], r["max_value"], r["data_type"]) == (6, 2, 33.33, 4, "5", "10", "numeric")
    capped = P.profile(spark.createDataFrame([(x,) for x in "abcda"], "v string").coalesce(1), options=ProfileOptions(max_tracked=3)).first()
    assert capped["distinct_count"] == 3 and [tuple(t) for t in capped["top_values"]] == [("a", 2), ("b", 1), ("c", 1)]
    assert P.profile(spark.createDataFrame([], "v string")).count() == 0


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv_contracts(spark, tmp_path):
    c = csv.analyze_csv(spark, write(tmp_path, "a.csv", 'Name,Age,Note\r\nAnn,30,"x, ""y""\nz"\r\nBob,,\r\n\r\nCid,4\r\n'))
    assert [f["name"] for f in c["fields"]] == ["Name", "Age", "Note"] and c["total_rows"] == 3
    assert [f["data_type"] for f in c["fields"]] == ["text", "numeric", "text"]
    assert c["fields"][1]["profile"]["null_count"] == 1 and c["fields"][2]["profile"]["null_count"] == 2
    assert c["sample_data"][0] == ["Ann", "30", 'x, "y"\nz']
    e = csv.analyze_csv(spark, write(tmp_path, "e.csv", b"\xef\xbb\xbfDate;Amount\n2024-01-01;910,11\n2024-01-02;\n"))
    assert e["delimiter"] == ";" and e["issues"] == [csv.BOM_ISSUE] and e["fields"][1]["profile"]["min_value"] == "910,11"
    n = csv.analyze_csv(spark, write(tmp_path, "n.csv", "1,2\n3,4\n"))
    assert not n["has_header"] and [f["name"] for f in n["fields"]] == ["column_1", "column_2"] and n["total_rows"] == 2
    h = csv.analyze_csv(spark, write(tmp_path, "h.csv", "Name,Age\n"))
    assert h["total_rows"] == 0 and {f["data_type"] for f in h["fields"]} == {"empty"}
    latin = csv.analyze_csv(spark, write(tmp_path, "l.csv", "Navn,By\nJosé,Málaga\n".encode("latin-1")))
    assert latin["encoding"] == "latin-1" and latin["sample_data"] == [["José", "Málaga"]]
    with pytest.raises(FileNotFoundError):
        csv.analyze_csv(spark, str(tmp_path / "none.csv"))


def test_csv_sniffing():
    assert csv.detect_encoding("é".encode()[:1] + b"") == ("utf-8", False) and csv.detect_encoding(b"caf\xe9 au lait") == ("latin-1", False)
    assert csv.split_lines('a,"b\nc"\r\n\nd') == ['a,"b\nc"', "d"] and csv.count_fields('a,"b,c",d', ",") == 3
    assert csv.score_delimiter(["a;b", "c;d", "e"], ";") == 2 and csv.score_delimiter(["a"], ",") == 0
    assert csv.detect_delimiter(b"a|b|c\n1|2|3\n") == "|" and csv.detect_delimiter(b"Email\nx@y\n") == ","


def test_json_contracts(spark, tmp_path):
    a = J.analyze_json(spark, write(tmp_path, "a.json", '[{"name":"Ann","age":30,"ok":true},{"name":null,"tags":[1],"o":{"x":1}},{"name":"Bob"}]'))
    assert {f["name"]: f["data_type"] for f in a["fields"]} == {"name": "text", "age": "numeric", "ok": "boolean", "tags": "array", "o": "object"}
    p = {f["name"]: f["profile"] for f in a["fields"]}
    assert p["name"]["null_count"] == 1 and p["age"]["null_count"] == 2 and p["tags"]["total_count"] == 2
    b = J.analyze_json(spark, write(tmp_path, "b.json", '[{"a":1},"str",{"a":2}]'))
    assert b["total_rows"] == 1 and len(b["issues"]) == 1
    n = J.analyze_json(spark, write(tmp_path, "n.ndjson", '{"a":1}\n\n{bad\n{"a":"x","a":"y"}\nnull\n'))
    assert n["source_format"] == "ndjson" and n["total_rows"] == 3 and len(n["issues"]) == 1 and n["fields"][0]["data_type"] == "text"
    m = J.analyze_json(spark, write(tmp_path, "m.ndjson", "".join(f'{{"n":{i}}}\n' for i in range(50))), ProfileOptions(max_rows=10))
    assert m["total_rows"] == 10 and len(m["sample_data"]) == 5
    with pytest.raises(ValueError):
        J.analyze_json(spark, write(tmp_path, "e.json", "  \n"))


def workbook(sheets):
    """Rows of values for each sheet; numbers become numbers, text is inline."""
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(r, c, v):
        at = f"{chr(65 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_xlsx_contract(spark, tmp_path):
    path = write(tmp_path, "a.xlsx", workbook({"People": [[None], ["Name", "Age", "Ok"], ["Ann", 30, True], ["", 4.5, None], []], "Empty": [], "Plain": [[1, 2], [3, 4]]}))
    c = xlsx.analyze_xlsx(spark, path)
    assert [s["name"] for s in c["schemas"]] == ["People", "Plain"] and c["metadata"]["sheet_count"] == 3
    people, plain = c["schemas"]
    assert [(f["name"], f["data_type"], f["nullable"]) for f in people["fields"]] == [("Name", "text", True), ("Age", "numeric", False), ("Ok", "text", True)]
    assert people["sample_data"][0] == ["Ann", "30", "TRUE"] and plain["row_count"] == 2
    assert [f["name"] for f in plain["fields"]] == ["column_1", "column_2"]
    assert xlsx.parse_range("B2:AA10") == ((2, 2), (27, 10))
    with pytest.raises(ValueError):
        xlsx.parse_range("nothing")
    with pytest.raises(ValueError):
        xlsx.analyze_xlsx(spark, write(tmp_path, "e.xlsx", workbook({"Sheet1": []})))


def test_table_contract_and_helpers(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "id bigint, name string, x double")
    t = tables.analyze_table(df, "things")
    assert t["row_count"] == 2 and [f["data_type"] for f in t["fields"]] == ["bigint", "text", "double"]
    assert t["fields"][2]["profile"]["null_percentage"] == 50.0 and t["sample_data"][0] == ["1", "a", ""]
    assert tables.sanitize_connection("postgres://me:secret@db:6432/shop") == "me@db:6432/shop"
    assert tables.sanitize_connection("nonsense") == "[connection string]" and tables.quote_identifier("a", 'b"c') == '"a"."b""c"'
    assert json.dumps(t)


def test_database_contract(spark):
    from siftwell.plans.queries import _catalog

    catalog = _catalog(spark) | {"tables": spark.createDataFrame([("public", "orders", "BASE TABLE"), ("public", "v", "VIEW"), ("other", "x", "BASE TABLE")], "table_schema string, table_name string, table_type string"), "column_comments": spark.createDataFrame([("orders", "o_custkey", "who")], "table_name string, name string, description string")}
    data = spark.createDataFrame([(1, 7, "O"), (2, 7, "F")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    c = tables.analyze_database(spark, catalog, lambda t: data, options=ProfileOptions(include_comments=True))
    (s,) = c["schemas"]
    assert s["name"] == "orders" and s["validation_rules"] == {"required_fields": ["o_orderkey", "o_custkey"], "unique_constraints": ["o_orderkey", "o_orderstatus"]}
    assert [k["type"] for k in s["fields"][1]["constraints"]] == ["foreign_key", "not_null"] and s["fields"][1]["description"] == "who"
    assert tables.table_exists(catalog["tables"], "public", "v") and not tables.table_exists(catalog["tables"], "public", "x")


def test_supplier_profile_covers_the_whole_table(spark, tmp_path):
    from siftwell.plans import queries as plans

    rows = spark.range(10_001).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "id % 25 AS s_nationkey", "cast(id AS double) AS s_acctbal")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["field"]: r for r in plans.queries()["table_profile_supplier"](spark, str(tmp_path)).collect()}
    assert {r["sample_size"] for r in got.values()} == {10_001} and got["s_suppkey"]["distinct_count"] == 10_001


def test_merged_profiles_keep_the_first_set_before_the_second(spark):
    groups = lambda values: P.group_values(P.unpivot(P.with_row_index(spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)), ["v"]))
    merged = P.merge_profiles(groups(["x", "y"]), groups(["z"]))
    assert {r["value"] for r in P.tracked(merged, 2).collect()} == {"x", "y"}
    assert {r["value"] for r in P.tracked(P.merge_profiles(groups([]), groups(["z"])), 2).collect()} == {"z"}


def test_ndjson_issues(spark, tmp_path):
    n = J.analyze_json(spark, write(tmp_path, "n.ndjson", '{"a":1}\n \t\n{bad\n[1]\n{"a":2}\n{"a":3}\n"x"\n'))
    assert n["total_rows"] == 3 and n["issues"] == [f"line {i}: invalid JSON object" for i in (2, 2, 4)]
    cut = J.analyze_json(spark, write(tmp_path, "m.ndjson", '{"a":1}\n{bad\n{"a":2}\n{bad\n'), ProfileOptions(max_rows=2))
    assert cut["total_rows"] == 2 and cut["issues"] == ["line 2: invalid JSON object"]
    many = J.analyze_json(spark, write(tmp_path, "o.ndjson", '{"a":1}\n' + "{bad\n" * 1500))
    assert len(many["issues"]) == 1500


def test_folders(spark, tmp_path):
    for name, rows in (("a", "1,x\n2,y\n"), ("b", "3,z\n")):
        write(tmp_path / "csv" if (tmp_path / "csv").exists() or not (tmp_path / "csv").mkdir() else tmp_path, f"{name}.csv", " K ,V\n" + rows)
    c = csv.analyze_csv(spark, str(tmp_path / "csv"))
    assert c["total_rows"] == 3 and [f["name"] for f in c["fields"]] == [" K ", "V"]
    (tmp_path / "json").mkdir()
    write(tmp_path / "json", "a.json", '[{"n":1},{"n":2}]')
    write(tmp_path / "json", "b.json", '[{"n":3,"late":true},7,{"n":4}]')
    j = J.analyze_json(spark, str(tmp_path / "json"))
    assert j["total_rows"] == 3 and j["issues"] == ["row 2: not an object"]
    assert {f["name"]: f["profile"]["total_count"] for f in j["fields"]} == {"n": 3, "late": 1}


def test_number_texts(spark, tmp_path):
    shown = {"1e-7": "1e-07", "12345678.5": "1.23456785e+07", "1.50": "1.5", "-0.25": "-0.25", "100": "100", "1e3": "1000", "0.0001": "0.0001", "0.00012": "0.00012", "123456.75": "123456.75", "1234567.5": "1.2345675e+06", "-2.5e-9": "-2.5e-09", "0": "0", "0.001": "0.001"}
    n = J.analyze_json(spark, write(tmp_path, "n.ndjson", "".join(f'{{"k{i}":{x}}}\n' for i, x in enumerate(shown))))
    assert [f["profile"]["max_value"] for f in n["fields"]] == list(shown.values())


def test_catalog_and_missing_table(spark):
    asked = []
    got = tables.read_catalog(lambda q: asked.append(q) or spark.range(0))
    assert set(got) == set(tables.CATALOG) and "information_schema.columns" in asked[1] and ProfileOptions(batch_size=0).batch_size == 1000
    held = spark.createDataFrame([("public", "a", "BASE TABLE")], "table_schema string, table_name string, table_type string")
    assert tables.one_table(held, "public", "a").count() == 1
    with pytest.raises(ValueError, match="no table b"):
        tables.one_table(held, "public", "b")
    first = tables.table_profile(spark.range(100).orderBy("id", ascending=False), ProfileOptions(sample_size=10)).first()
    assert (first["min_value"], first["max_value"]) == ("0", "9")


def test_key_index_is_dense_in_key_order(spark):
    keys = [-5, 0, 3, 4095, 4096, 5000, 1 << 40, 7]
    df = spark.createDataFrame([(k, f"r{k}") for k in keys], "k long, t string").repartition(3)
    got = {r["k"]: r["idx"] for r in J.key_index(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert J.key_index(df.filter("false"), "k").count() == 0


def test_folders_whose_first_files_hold_nothing(spark, tmp_path):
    for name, rest in (("n", ['{"a":1}\n', '{bad\n{"a":2}\n']), ("j", ['[{"a":1}]', '[{"a":2},7]']), ("c", ["a,b\n1,2\n", "a,b\n3,4\n"])):
        (tmp_path / name).mkdir()
        for i, text in enumerate(["", "" if name == "c" else " \t\r\n" * 5000, *rest]):
            write(tmp_path / name, f"part-{i}", text)
    for name, kind in (("n", "ndjson"), ("j", "json")):
        c = J.analyze_json(spark, str(tmp_path / name))
        assert (c["source_format"], c["total_rows"], len(c["issues"])) == (kind, 2, 1)
    c = csv.analyze_csv(spark, str(tmp_path / "c"))
    assert (c["total_rows"], [f["name"] for f in c["fields"]], c["delimiter"]) == (2, ["a", "b"], ",")
    (tmp_path / "none").mkdir()
    write(tmp_path / "none", "part-0", "")
    with pytest.raises(ValueError, match="empty input"):
        J.analyze_json(spark, str(tmp_path / "none"))


def test_ndjson_query_whose_first_partition_is_empty(spark, tmp_path):
    from pyspark.sql import functions as F

    from siftwell.plans import contracts

    rows = spark.range(40).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # the one row group lies in a later split than the first
    try:
        got = {r["field"]: (r["total_rows"], r["n_issues"]) for r in contracts.ndjson_contract_events(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == dict.fromkeys(("id", "tiny", "some", "big"), (28, 8))


def test_ndjson_values_and_sample(spark, tmp_path):
    numbers = {"0.00099": "0.00099", "-0.00012": "-0.00012", "0.00009": "9e-05", "999999.5": "999999.5", "-1000000.5": "-1.0000005e+06", "9999999.25": "9.99999925e+06", "-0.001": "-0.001", "2.5e-300": "2.5e-300"}
    n = J.analyze_json(spark, write(tmp_path, "n.ndjson", "".join(f'{{"k{i}":{x}}}\n' for i, x in enumerate(numbers))))
    assert [f["profile"]["max_value"] for f in n["fields"]] == list(numbers.values())
    lines = ['{"a":"null","b":true}', "nullx", "\u00a0null\u00a0", '{"a":null,"b":[1, {"c":"x"}]}', '{"a":"{","b":1}', "NaN", "true", '{"a":"1","b":{"q":"\\""}}', '{"a":1}', "-1"]
    n = J.analyze_json(spark, write(tmp_path, "m.ndjson", "\n".join(lines)), ProfileOptions(max_sample_rows=4))
    assert n["total_rows"] == 6 and n["issues"] == [f"line {i}: invalid JSON object" for i in (2, 5, 5, 7)]
    a, b = n["fields"]
    assert (a["name"], a["data_type"], a["profile"]["null_count"]) == ("a", "text", 2)
    assert [(x["value"], x["count"]) for x in a["profile"]["top_values"]] == [("1", 2), ("null", 1), ("{", 1)]
    assert (b["name"], b["data_type"], b["profile"]["null_count"]) == ("b", "object", 2)
    assert [x["value"] for x in b["profile"]["top_values"]] == ["1", '[1,{"c":"x"}]', "true", '{"q":"\\""}']
    assert n["sample_data"] == [["null", "true"], ["", ""], ["", '[1, {"c": "x"}]'], ["{", "1"]]
