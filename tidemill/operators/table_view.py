"""Paging: typed filters, full-text search, stable multi-sort, exact totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.functions.expressions import any_of, quoted, truthy
from tidemill.operators.rows import ORDER, free_name, ordinals, with_order
from tidemill.operators.steps import OPERATORS, predicate

PAGE, MAX_PAGE, MAX_VALUE = 100, 1000, 500


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    offset: int
    limit: int


def parse_filter(text: str) -> tuple[str, str, str | None]:
    """``column:op:value`` (the column may hold colons)."""
    for op in sorted(OPERATORS, key=len, reverse=True):
        if op in ("is_null", "is_not_null") and text.endswith(f":{op}"):
            return text[: -len(op) - 1], op, None
        name, found, value = text.partition(f":{op}:")
        if found and name:
            if op in ("is_null", "is_not_null"):
                return name, op, None
            if len(value) > MAX_VALUE:
                raise PreparationError(f"a filter value has {MAX_VALUE} characters at most")
            return name, op, value
    raise PreparationError(f"{text!r} is no filter")


def parse_sort(text: str) -> tuple[str, bool]:
    """``column:asc`` or ``column:desc``, as (column, descending)."""
    name, _, way = text.rpartition(":")
    if not name or way not in ("asc", "desc"):
        raise PreparationError(f"{text!r} is no sort order")
    return name, way == "desc"


def search(df: DataFrame, needle: str) -> Column:
    """Rows with ``needle`` in any column's text, case ignored."""
    if len(needle) > MAX_VALUE:
        raise PreparationError(f"a search has {MAX_VALUE} characters at most")
    low = needle.lower()
    return any_of([truthy(F.contains(F.lower(quoted(c).cast("string")), F.lit(low))) for c, kind in df.dtypes if c != ORDER and not kind.startswith(("map", "struct", "array", "binary"))])


def view(df: DataFrame, filters: tuple[str, ...] = (), needle: str = "") -> DataFrame:
    """The rows that pass all filters and the search."""
    for text in filters:
        name, op, value = parse_filter(text)
        df = df.filter(truthy(predicate(df.schema, name, op, value)))
    return df.filter(search(df, needle)) if needle else df


def ordered(df: DataFrame, sorts: tuple[str, ...]) -> list[Column]:
    keys = []
    for text in sorts:
        name, descending = parse_sort(text)
        if name not in df.columns:
            raise PreparationError(f"there is no column {name!r}")
        keys.append(quoted(name).desc_nulls_last() if descending else quoted(name).asc_nulls_last())
    return keys


def page(df: DataFrame, offset: int = 0, limit: int = PAGE, sorts: tuple[str, ...] = (), filters: tuple[str, ...] = (), needle: str = "") -> Page:
    """One page in a total order (nulls last, then source order), with the
    number of all matching rows and each row's position in the source.

    Sort and limit stay one TakeOrderedAndProject, so each task keeps
    offset + limit rows at most and no full sort is made."""
    if offset < 0 or limit < 1:
        raise PreparationError("offset starts at 0 and limit at 1")
    limit = min(limit, MAX_PAGE)
    full = with_order(df)
    number = free_name(df, "row")
    matching = view(ordinals(full, number), filters, needle)
    rows = matching.orderBy(*ordered(full, sorts), quoted(ORDER).asc()).limit(offset + limit).offset(offset)
    return Page(rows.drop(ORDER), view(df, filters, needle).count(), offset, limit)
