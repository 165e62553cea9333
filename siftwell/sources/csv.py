"""CSV source: encoding, delimiter and header from the head, then one profiling plan over all cells."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import cells
from siftwell.operators.profile import profile, sample_rows, with_row_index
from siftwell.options import ProfileOptions
from siftwell.sources.files import head

# Candidates in the order in which ties are settled.
DELIMITERS = (",", ";", "\t", "|")
BOM = b"\xef\xbb\xbf"
BOM_ISSUE = "file contains UTF-8 BOM"


def detect_encoding(data: bytes) -> tuple[str, bool]:
    """(utf-8 or latin-1, whether a byte order mark leads). A character cut off at the end is no fault."""
    if data.startswith(BOM):
        return "utf-8", True
    for cut in range(4):
        try:
            data[: len(data) - cut].decode()
            return "utf-8", False
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data" and e.start < len(data) - 4:
                break
    return "latin-1", False


def decode_latin1(data: bytes) -> str:
    return data.decode("latin-1")


def split_lines(text: str) -> list[str]:
    """Lines outside quotes, without carriage returns; empty ones are left out."""
    lines, quoted = [""], False
    for i, part in enumerate(text.split('"')):
        if i:
            quoted = not quoted
            lines[-1] += '"'
        if quoted:
            lines[-1] += part
        else:
            first, *rest = part.split("\n")
            lines[-1] += first
            lines += rest
    return [x for line in lines if (x := line.rstrip("\r"))]


def count_fields(line: str, delimiter: str) -> int:
    return 1 + sum(part.count(delimiter) for part in line.split('"')[::2])


def score_delimiter(lines: list[str], delimiter: str) -> int:
    """Lines that agree on the most usual number of fields; 0 if none has more than one."""
    counts = Counter(count_fields(line, delimiter) for line in lines)
    return max(counts.values()) if max(counts, default=0) > 1 else 0


def detect_delimiter(data: bytes) -> str:
    lines = split_lines(data.decode("utf-8", "replace"))
    return max(DELIMITERS, key=lambda d: (score_delimiter(lines, d), -DELIMITERS.index(d)))


def delimiter_scores(lines: DataFrame, line: str = "line") -> DataFrame:
    """(delimiter, score) over a column of lines, as a plan."""
    bare = F.regexp_replace(F.col(line), '"[^"]*"', "")
    each = lines.select(F.explode(F.array(*map(F.lit, DELIMITERS))).alias("delimiter"), bare.alias("bare"))
    n = F.length("bare") - F.length(F.replace(F.col("bare"), F.col("delimiter"), F.lit(""))) + 1
    sizes = each.select("delimiter", n.alias("n")).groupBy("delimiter", "n").count()
    return sizes.groupBy("delimiter").agg(F.when(F.max("n") > 1, F.max("count")).otherwise(0).alias("score"))


@dataclass
class CsvSource:
    rows: DataFrame  # row_idx and a text column for each field, in the order of the file
    fields: list[str]
    encoding: str
    delimiter: str
    has_header: bool
    bom: bool


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> CsvSource:
    """multi_line: quoted cells may hold line ends, at the price that a file isn't split among tasks.

    Of a folder every file begins with the header that its first file begins with.
    """
    data = head(spark, path)
    encoding, bom = detect_encoding(data)
    delimiter = detect_delimiter(data[3:] if bom else data)
    options = {"header": False, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": multi_line, "encoding": "ISO-8859-1" if encoding == "latin-1" else "UTF-8", "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxCharsPerColumn": -1}
    raw = spark.read.options(**options).csv(path)
    if not raw.columns:
        raise ValueError("CSV file is empty")
    names, several = raw.columns, len(raw.inputFiles()) > 1
    raw = with_row_index(raw.select(*names, F.col("_metadata.file_path").alias("file")) if several else raw)
    # the first partition begins with the first row, so no more than its beginning is read
    top = raw.select(F.array(*names).alias("cells"), "row_idx").select("cells", "row_idx", cells.has_header(F.col("cells")).alias("header")).first()
    if top is None:
        raise ValueError("CSV file is empty")
    fields = [c or "" for c in top["cells"]] if top["header"] else cells.generated_names(len(names))
    rows = raw
    if top["header"] and several:
        rows = raw.join(raw.groupBy("file").agg(F.min("row_idx").alias("row_idx")), ["row_idx"], "left_anti")
    elif top["header"]:
        rows = raw.filter(F.col("row_idx") > top["row_idx"])
    rows = rows.select("row_idx", *names)
    return CsvSource(rows, fields, encoding, delimiter, bool(top["header"]), bom)


def file_profile(r, fallback_total: int = 0) -> dict:
    if r is None:
        return {"total_count": fallback_total, "null_count": 0, "null_percentage": 0.0, "distinct_count": 0, "min_value": None, "max_value": None, "top_values": []}
    return {c: r[c] for c in ("total_count", "null_count", "null_percentage", "distinct_count", "min_value", "max_value")} | {"top_values": [x.asDict() for x in r["top_values"]]}


def analyze_csv(spark: SparkSession, path: str, options: ProfileOptions = ProfileOptions(), multi_line: bool = True) -> dict:
    """The source contract of a CSV file."""
    source = read_csv(spark, path, multi_line)
    names = [c for c in source.rows.columns if c != "row_idx"]
    found = {r["field"]: r for r in profile(source.rows, names, options, row_idx="row_idx").collect()}
    sample = sample_rows(source.rows, options.max_sample_rows).collect()
    fields = [{"name": f, "data_type": found[c]["data_type"] if c in found else "empty", "profile": file_profile(found.get(c))} for f, c in zip(source.fields, names, strict=True)]
    total = fields[0]["profile"]["total_count"] if fields else 0
    return {
        "contract_type": "source",
        "source_format": "csv",
        "source_path": path,
        "encoding": source.encoding,
        "delimiter": source.delimiter,
        "has_header": source.has_header,
        "total_rows": total,
        "fields": fields,
        "sample_data": [["" if r[c] is None else r[c] for c in names] for r in sample],
        "issues": [BOM_ISSUE] if source.bom else [],
    }
