"""Coercion of raw text fields to typed columns. Nothing is trimmed but where a number is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An integer as it may be written (fixed value): white space around it, a sign, digits with single underscores between.
INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
#: A finite decimal number, likewise (fixed value).
NUMBER = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*$"
LARGEST_INT = 2**31 - 1


def clean(v: Column) -> Column:
    r"""The field, or null if it is empty or the marker \N."""
    return F.when((v != "") & (v != r"\N"), v)


def to_text(v: Column) -> Column:
    return v


def _digits(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r"\s", ""), "_", "")


def to_int(v: Column) -> Column:
    """A whole number of up to 38 digits; its range is checked when the row is validated."""
    return F.when(v.rlike(INTEGER), _digits(v).try_cast("decimal(38,0)"))


def to_smallint(v: Column) -> Column:
    n = to_int(v)
    return F.when(n.between(-32768, 32767), n.cast("smallint"))


def to_bool01(v: Column) -> Column:
    return F.when(v == "1", True).when(v == "0", False)


def to_rating(v: Column) -> Column:
    """A finite decimal number; not-a-number and infinity are not ratings."""
    return F.when(v.rlike(NUMBER), _digits(v).try_cast("double"))


def to_list(v: Column) -> Column:
    """Items between \\x02, if there is one, else between commas; empty items go, and no items make null."""
    separator = F.when(v.contains("\x02"), F.lit("\x02")).otherwise(F.lit(","))
    items = F.filter(F.split(v, separator), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def to_json(v: Column) -> Column:
    """The text where it is valid JSON other than null. false and [] are valid."""
    parsed = F.try_parse_json(v)
    return F.when(parsed.isNotNull() & ~F.is_variant_null(parsed), v)


COERCERS = {"text": to_text, "int": to_int, "smallint": to_smallint, "bool01": to_bool01, "rating": to_rating, "list": to_list, "json": to_json}
