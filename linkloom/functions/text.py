"""Small text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_LENGTH = 60


def brief_summary(text: Column) -> Column:
    """Texts longer than 60 characters as their first 59 and three dots."""
    return F.when(F.length(text) > SUMMARY_LENGTH, F.concat(F.substring(text, 1, SUMMARY_LENGTH - 1), F.lit("..."))).otherwise(text)


def one_line(text: Column) -> Column:
    """Lines trimmed, blank ones dropped, the others joined by one space."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def terms(text: Column) -> Column:
    """The distinct lower-case words (letters, digits, underscores) of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def matches(text: Column, query: str) -> Column:
    """Whether a text holds any word of the query, whatever the case."""
    return F.coalesce(F.arrays_overlap(terms(text), terms(F.lit(query))), F.lit(False))


def match_score(text: Column, query: str) -> Column:
    """How many distinct words of the query a text holds."""
    return F.coalesce(F.size(F.array_intersect(terms(text), terms(F.lit(query)))), F.lit(0))


def contains_any(text: Column, items: Column) -> Column:
    """Whether a text contains one of an array of strings, whatever the case; null when the array is null."""
    return F.exists(items, lambda item: F.contains(F.lower(text), F.lower(item)))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def schedule_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH:mm:ss.SSS")


def index_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy.MM.dd:HH:mm:ss")
