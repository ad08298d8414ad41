"""Coercion of dirty text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_null(c: Column) -> Column:
    """Without surrounding white space; blank is null."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def long_or_null(c: Column) -> Column:
    """An integer, or a fraction cut off; anything else is null."""
    text = text_or_null(c)
    as_double = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when(F.abs(as_double) < 9.2e18, as_double).try_cast("bigint"))


def int_or_null(c: Column) -> Column:
    return long_or_null(c).try_cast("int")


def double_or_null(c: Column) -> Column:
    return text_or_null(c).try_cast("double")


def texts(c: Column) -> Column:
    """The non-blank entries of an array, in order; null is empty."""
    return F.coalesce(F.filter(F.transform(c, text_or_null), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def first_list(*lists: Column) -> Column:
    """The first array that has entries."""
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array().cast("array<string>"))


def split_seeds(c: Column) -> Column:
    """Comma-separated names, trimmed, without blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def needle(c: Column) -> Column:
    """A search text: lower case, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
