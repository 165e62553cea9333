"""Excel source: workbooks read as their XML parts, one profile plan for all sheets.

A workbook is a zip of XML that can't be split; each file is parsed by one task into (sheet, row, cells) rows, and all
that follows is a plan. Values appear as Excel shows them without number formats, but for dates.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from posixpath import join, normpath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwell.functions import cells as C
from siftwell.operators.profile import profile
from siftwell.options import ProfileOptions

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Numbers of built-in date formats.
DATE_FORMATS = {14, 15, 16, 17, 22}


def parse_range(ref: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """((column, row), (column, row)) of a range such as A1:C4, from 1."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?", ref.upper())
    if not m:
        raise ValueError(f"invalid range: {ref}")
    first = (_column(m[1]), int(m[2]))
    return first, (_column(m[3]), int(m[4])) if m[3] else first


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def _links(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, name = part.rsplit("/", 1)
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    return {r.get("Id"): (r.get("Type").rsplit("/", 1)[-1], normpath(join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:]) for r in ElementTree.fromstring(z.read(path)).iter(f"{_PACKAGE}Relationship")}


def _dates(z: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or "").lower())}
    styles = root.find(f"{_MAIN}cellXfs")
    return [int(x.get("numFmtId") or 0) in DATE_FORMATS | own for x in (styles if styles is not None else [])]


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _shown(c, shared: list[str], dates: list[bool]) -> str:
    kind, v = c.get("t"), c.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return _texts(c)
    if v is None:
        return ""
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return "TRUE" if v == "1" else "FALSE"
    style = int(c.get("s") or 0)
    if kind in (None, "n") and style < len(dates) and dates[style]:
        day = datetime(1899, 12, 30) + timedelta(days=float(v))
        return day.strftime("%Y-%m-%d" if float(v).is_integer() else "%Y-%m-%d %H:%M:%S")
    if kind in (None, "n") and re.fullmatch(r"-?\d+\.\d+(?:[eE]-?\d+)?", v):
        return f"{float(v):.15g}"
    return v


def read_workbook(data: bytes) -> Iterator[tuple[str, int, int | None, int, list[str]]]:
    """(sheet, its number, first row of its first table, row from 1, cells) without cells after the last filled one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        links = _links(z, "xl/workbook.xml")
        strings = "xl/sharedStrings.xml"
        shared = [_texts(si) for si in ElementTree.fromstring(z.read(strings)).iter(f"{_MAIN}si")] if strings in z.namelist() else []
        dates = _dates(z)
        for number, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            kind, part = links[sheet.get(f"{_REL}id")]
            if kind != "worksheet":
                continue
            tables = [ElementTree.fromstring(z.read(p)) for k, p in _links(z, part).values() if k == "table"]
            top = parse_range(tables[0].get("ref"))[0][1] if tables else None
            row = None
            for row in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}row"):
                out: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = parse_range(c.get("r"))[0][0] if c.get("r") else len(out) + 1
                    out += [""] * (at - 1 - len(out)) + [_shown(c, shared, dates)]
                while out and not out[-1]:
                    out.pop()
                yield sheet.get("name"), number, top, int(row.get("r")), out
            if row is None:
                yield sheet.get("name"), number, top, 0, []


def read_xlsx(spark: SparkSession, path: str):
    """(file, sheet, sheet_idx, table_row, row_idx, cells) of all workbooks below a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [(name, *r) for r in read_workbook(content.as_py())]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.list_(pa.string()))], ["file", "sheet", "sheet_idx", "table_row", "row_idx", "cells"])

    return files.mapInArrow(run, "file string, sheet string, sheet_idx int, table_row int, row_idx bigint, cells array<string>")


def analyze_xlsx(spark: SparkSession, path: str, options: ProfileOptions = ProfileOptions()) -> dict:
    """The source contract of one workbook, a schema for each sheet with rows."""
    rows = read_xlsx(spark, path).cache()
    try:
        filled = rows.filter(~C.is_empty_row(F.col("cells")))
        tops = filled.groupBy("sheet", "sheet_idx", "table_row").agg(F.min("row_idx").alias("first")).orderBy("sheet_idx").collect()
        schemas = []
        for t in tops:
            start = t["table_row"] or t["first"]
            own = filled.filter((F.col("sheet_idx") == t["sheet_idx"]) & (F.col("row_idx") >= start))
            top = own.filter(F.col("row_idx") == start).select("cells", C.has_header(F.col("cells")).alias("header")).first()
            if top is None:
                raise ValueError(f"sheet {t['sheet']}: its table begins below the last row")
            width = len(top["cells"])
            names = [x or "" for x in top["cells"]] if top["header"] else C.generated_names(width)
            body = own.filter(F.col("row_idx") > start) if top["header"] else own
            keys = [f"c{i}" for i in range(width)]
            table = body.select("row_idx", *(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(k) for i, k in enumerate(keys)))
            found = {r["field"]: r for r in profile(table, keys, options, row_idx="row_idx").collect()}
            if not found:
                continue
            fields = []
            for name, k in zip(names, keys, strict=True):
                r = found[k]
                nullable = r["null_count"] > 0
                own_profile = {c: r[c] for c in ("null_count", "null_percentage", "distinct_count", "min_value", "max_value")}
                fields.append({"name": name, "data_type": r["data_type"], "nullable": nullable, "profile": own_profile | {"top_values": [x.asDict() for x in r["top_values"]], "sample_size": r["total_count"]}})
            sample = [[r[k] for k in keys] for r in table.orderBy("row_idx").limit(options.max_sample_rows).collect()]
            schemas.append({"name": t["sheet"], "row_count": found[keys[0]]["total_count"], "fields": fields, "sample_data": sample, "validation_rules": {"required_fields": [f["name"] for f in fields if not f["nullable"]]}})
        count = rows.select("sheet_idx").distinct().count()
    finally:
        rows.unpersist()
    if not schemas:
        raise ValueError("no sheets with data")
    return {"contract_type": "source", "id": "excel", "schemas": schemas, "metadata": {"source_format": "xlsx", "sheet_count": count}}
