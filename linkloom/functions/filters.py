"""Filter lists as data: clauses with And / Or, compiled to one Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import matches


class FilterError(ValueError):
    """A clause that names no known operation."""


def _as_list(value) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list | tuple | set) else [str(value)]


OPERATIONS = {
    "Eq": lambda c, v: c == F.lit(str(v)),
    "Gt": lambda c, v: c > F.lit(str(v)),
    "Gte": lambda c, v: c >= F.lit(str(v)),
    "Lt": lambda c, v: c < F.lit(str(v)),
    "Lte": lambda c, v: c <= F.lit(str(v)),
    "In": lambda c, v: c.isin(_as_list(v)),
    "Regex": lambda c, v: c.rlike(str(v)),
    "Text": lambda c, v: matches(c, str(v)),
}


def compile_filters(filters: Sequence[dict]) -> Column:
    """``[{"Eq": {"FieldName": "a", "FilterValue": "x"}}, {"Or": {"Gt": {...}}}, ...]`` as a predicate.

    Values are compared as strings. Clauses fold from left to right, each joined to what stands before it by And (the default) or Or; an
    empty list keeps every row. A null field matches nothing.
    """
    result: Column | None = None
    for clause in filters:
        if len(clause) != 1:
            raise FilterError(f"a clause has one operation: {clause!r}")
        ((name, body),) = clause.items()
        how = "And"
        if name in ("And", "Or"):
            how = name
            if len(body) != 1:
                raise FilterError(f"a clause has one operation: {clause!r}")
            ((name, body),) = body.items()
        if name not in OPERATIONS:
            raise FilterError(f"unknown operation {name!r}")
        test = F.coalesce(OPERATIONS[name](F.col(body["FieldName"]).cast("string"), body["FilterValue"]), F.lit(False))
        result = test if result is None else (result & test if how == "And" else result | test)
    return F.lit(True) if result is None else result
