"""Comparison, ordering and conversion rules of the dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MOST_PRECISION = 38


def char_equal(a: Column, b: Column) -> Column:
    """CHAR and VARCHAR comparison: trailing blanks don't count."""
    return F.rtrim(a) == F.rtrim(b)


def ci_equal(a: Column, b: Column | str) -> Column:
    """Equality under a case-insensitive index; a comparison of collation keys, which no Parquet filter takes."""
    return F.collate(a, "UTF8_LCASE") == F.collate(b if isinstance(b, Column) else F.lit(b), "UTF8_LCASE")


def int_div(a: str, b: str) -> Column:
    """Integer division of two expressions truncates towards zero."""
    return F.expr(f"({a}) div ({b})")


def decimal(precision: int, scale: int) -> DecimalType:
    """Refuses what Spark cannot hold instead of losing digits."""
    if precision > MOST_PRECISION:
        raise ValueError(f"DECIMAL({precision},{scale}): at most {MOST_PRECISION} digits are supported")
    return DecimalType(precision, scale)


def ascending(c: Column) -> Column:
    """Nulls sort high: last when ascending."""
    return c.asc_nulls_last()


def descending(c: Column) -> Column:
    return c.desc_nulls_first()


def undefined_order(value: Column, defined: Column) -> list[Column]:
    """UNDEFINED before null before everything else."""
    return [defined.asc(), value.isNotNull().asc(), value.asc()]


def set_of(*elements: Column) -> Column:
    """SET(...): distinct elements; undefined if any element is."""
    whole = F.array_sort(F.array_distinct(F.array(*elements)))
    none = elements[0].isNull()
    for e in elements[1:]:
        none = none | e.isNull()
    return F.when(~none, whole)


def upper(c: Column, language: str = "") -> Column:
    """UPPER under a language's rules: of Turkish and Azeri, i becomes a dotted capital."""
    return F.upper(F.translate(c, "i", "\u0130") if language in ("tr", "az") else c)


def lower(c: Column, language: str = "") -> Column:
    return F.lower(F.translate(c, "I\u0130", "\u0131i") if language in ("tr", "az") else c)


def width(c: Column, most: int, error: bool = False) -> Column:
    """A string brought to CHAR or VARCHAR width: blanks at the end may go, other characters are cut off or refused."""
    fits = F.length(F.rtrim(c)) <= most
    cut = F.substring(c, 1, most)
    return F.when(fits | c.isNull(), cut).otherwise(F.raise_error(F.lit(f"a value is longer than {most} characters")).cast("string")) if error else cut


def qualifier(c: Column, op: str, value: Column, negate: bool = False, ordered_nulls: bool = False, unknown: bool = False) -> Column:
    """A storage qualifier: a comparison that may be negated. With ``ordered_nulls`` null equals null and is above all
    values; otherwise a comparison with null gives ``unknown`` (before negation)."""
    plain = {"<": c < value, "<=": c <= value, "=": c == value, ">": c > value, ">=": c >= value}[op]
    if ordered_nulls:
        both, left, right = c.isNull() & value.isNull(), c.isNull(), value.isNull()
        out = F.when(both, F.lit("=" in op)).when(left, F.lit(op[0] == ">")).when(right, F.lit(op[0] == "<")).otherwise(plain)
    else:
        out = F.coalesce(plain, F.lit(unknown))
    return ~out if negate else out
