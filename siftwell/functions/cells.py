"""Column expressions over text cells: blank, date and number tests, locale-aware parsing, types and names.

All are built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell types from weakest to strongest.
CELL_TYPES = ("empty", "numeric", "date", "text")
# JSON types from weakest to strongest.
JSON_TYPES = ("empty", "null", "numeric", "boolean", "date", "array", "object", "text")
# Groups of types within which a value needs no cast.
CAST_GROUPS = (("text", "varchar", "char"), ("integer", "bigint", "smallint", "numeric", "real", "double"), ("date", "timestamp", "timestamptz"))

_SPACE = r"(?U)^\s+|\s+$"
_DATE = r"\A(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})\z"
# US decimal, European decimal, thousands, plain
_NUMBER = r'\A-?"*(?:[0-9,]+\.[0-9]+|[0-9.]+,[0-9]+|[0-9]+(?:,[0-9]{3})+|[0-9]+\.?[0-9]*|\.[0-9]+)"*\z'
_FLOAT = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def trimmed(cell: Column) -> Column:
    return F.regexp_replace(cell, _SPACE, "")


def is_blank(cell: Column) -> Column:
    """Null, empty or Unicode white space alone."""
    return cell.isNull() | cell.rlike(r"(?U)\A\s*\z")


def is_date(cell: Column) -> Column:
    """Looks like dddd-dd-dd or dd/dd/dddd; ranges aren't checked."""
    return cell.rlike(_DATE)


def is_numeric(cell: Column) -> Column:
    """A plain, US or European number."""
    return cell.rlike(_NUMBER)


def is_us_decimal(cell: Column) -> Column:
    return cell.rlike(r"\A[0-9,]+\.[0-9]+\z")


def is_european_decimal(cell: Column) -> Column:
    return cell.rlike(r"\A[0-9.]+,[0-9]+\z")


def is_us_thousands(cell: Column) -> Column:
    return cell.rlike(r"\A[0-9]+(?:,[0-9]{3})+\z")


def is_european_comma(cell: Column) -> Column:
    return cell.rlike(r"\A[0-9]+,[0-9]+\z")


def is_plain_number(cell: Column) -> Column:
    return cell.rlike(r"\A(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z")


def all_digits(cell: Column) -> Column:
    return cell.rlike(r"\A[0-9]+\z")


def all_digits_and(cell: Column, separator: str) -> Column:
    return cell.rlike(rf"\A[0-9\{separator}]+\z")


def classify(cell: Column) -> Column:
    t = trimmed(cell)
    return F.when(is_blank(cell), "empty").when(is_date(t), "date").when(is_numeric(t), "numeric").otherwise("text")


def parse_numeric(cell: Column) -> Column:
    """The number that a cell stands for, else null.

    With both separators the last one is the decimal point. Commas alone separate thousands, as do several points.
    Exponents and a plus sign are read; NaN, infinities and what overflows are not numbers.
    """
    t = F.regexp_replace(trimmed(cell), r'\A"+|"+\z', "")
    comma, point = F.locate(",", F.reverse(t)), F.locate(".", F.reverse(t))
    european = (comma > 0) & (point > 0) & (comma < point)
    plain = F.when(european, F.translate(t, ",.", ".")).otherwise(F.translate(t, ",", ""))
    value = F.when(plain.rlike(_FLOAT), plain).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def rank_of(kind: Column, order: tuple[str, ...] = CELL_TYPES) -> Column:
    """Place of a type in the order of strength: of merged types the strongest stays."""
    return F.coalesce(*(F.when(kind == t, F.lit(i)) for i, t in enumerate(order)), F.lit(len(order) - 1))


def type_of(rank: Column, order: tuple[str, ...] = CELL_TYPES) -> Column:
    return F.element_at(F.array(*map(F.lit, order)), rank + 1)


def merge_types(a: Column, b: Column, order: tuple[str, ...] = CELL_TYPES) -> Column:
    return type_of(F.greatest(rank_of(a, order), rank_of(b, order)), order)


def has_header(cells: Column) -> Column:
    """Any cell of the first row that is neither blank nor a number."""
    return F.exists(cells, lambda c: ~is_blank(c) & ~is_numeric(trimmed(c)))


def generated_names(n: int) -> list[str]:
    return [f"column_{i + 1}" for i in range(n)]


def is_empty_row(cells: Column) -> Column:
    return F.forall(cells, is_blank)


def normalize_name(name: Column) -> Column:
    return F.translate(F.lower(name), "_- ", "")


def needs_cast(source: Column, target: Column) -> Column:
    """Unless the types are equal or of one group."""
    a, b = F.lower(source), F.lower(target)
    together = reduce(Column.__or__, (a.isin(*g) & b.isin(*g) for g in CAST_GROUPS))
    return ~((a == b) | together)


def constraint_suffix(kinds: Column) -> Column:
    """The first notable constraint of a list, in brackets."""
    # The suffixes of messages.
    first = F.get(F.filter(kinds, lambda k: k.isin("primary_key", "unique", "foreign_key")), F.lit(0))
    return F.when(first == "primary_key", " (PRIMARY KEY)").when(first == "unique", " (UNIQUE)").when(first == "foreign_key", " (FOREIGN KEY)").otherwise("")
