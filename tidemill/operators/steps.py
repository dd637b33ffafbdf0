"""The closed list of preparation steps.

A step is a kind and its parameters. Its operation validates the parameters
against a schema, applies them to a DataFrame, and tells what it reads and how the
columns change. Steps that depend on row order use the order column, which they
carry along and never treat as data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError
from tidemill.functions import expressions as E
from tidemill.functions.expressions import quoted
from tidemill.functions.formula import columns_read, compile_formula
from tidemill.operators.rows import ORDER, with_order

CAST_TARGETS = {"integer": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType()}
COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte")
OPERATORS = (*COMPARISONS, "is_null", "is_not_null", "contains")


@dataclass(frozen=True)
class Step:
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    step_id: str = ""


@dataclass(frozen=True)
class Effect:
    """How columns change: mutated in place, renamed (old, new), created (new
    with the columns it reads), dropped; rows tells that the set of rows changes."""

    mutated: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()
    created: tuple[tuple[str, tuple[str, ...]], ...] = ()
    dropped: tuple[str, ...] = ()
    rows: bool = False


@dataclass(frozen=True)
class Operation:
    validate: Callable[[dict, T.StructType], None]
    apply: Callable[[DataFrame, dict], DataFrame]
    reads: Callable[[dict, T.StructType], tuple[str, ...]]
    effect: Callable[[dict, T.StructType], Effect]


# ---------------------------------------------------------------- parameters


def _name(params: dict, key: str = "column") -> str:
    value = params.get(key)
    if not isinstance(value, str) or not value:
        raise PreparationError(f"parameter {key!r} must be a name")
    return value


def _names(params: dict, key: str = "columns", may_miss: bool = False) -> tuple[str, ...]:
    value = params.get(key)
    if value is None and may_miss:
        return ()
    if not isinstance(value, (list, tuple)) or not value or not all(isinstance(x, str) and x for x in value):
        raise PreparationError(f"parameter {key!r} must be a list of names")
    return tuple(dict.fromkeys(value))


def _present(names: tuple[str, ...], schema: T.StructType) -> None:
    known = {f.name for f in schema if f.name != ORDER}
    if missing := [n for n in names if n not in known]:
        raise PreparationError(f"there is no column {', '.join(map(repr, missing))}")


def _free(name: str, schema: T.StructType) -> None:
    if name.lower() in {f.name.lower() for f in schema}:
        raise PreparationError(f"the name {name!r} is taken")


def _textual(kind: T.DataType, name: str) -> None:
    if not isinstance(kind, T.StringType):
        raise PreparationError(f"column {name!r} of type {kind.simpleString()} is no text")


def _set(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace a column in place, keeping the order of columns."""
    return df.select(*(value.alias(c) if c == name else quoted(c) for c in df.columns))


# ---------------------------------------------------------------- literals and predicates


def literal(value: Any, kind: T.DataType, name: str) -> Column:
    """A form's value as a literal of the column's type; an error if it is none."""
    text = str(value).strip().replace(" ", "").replace(" ", "") if not isinstance(value, str) or not isinstance(kind, T.StringType) else value
    try:
        if isinstance(kind, T.StringType):
            return F.lit(str(value))
        if isinstance(kind, T.BooleanType):
            word = text.lower()
            if word in E.TRUE_WORDS or word in E.FALSE_WORDS:
                return F.lit(word in E.TRUE_WORDS)
        elif isinstance(kind, E.INTEGRAL):
            return F.lit(int(Decimal(text.replace(",", ".")))).cast("bigint") if Decimal(text.replace(",", ".")) % 1 == 0 else F.lit(float(text.replace(",", ".")))
        elif isinstance(kind, E.FLOATING):
            return F.lit(float(text.replace(",", ".")))
        elif isinstance(kind, T.DecimalType):
            return F.lit(Decimal(text.replace(",", ".")))
        elif isinstance(kind, E.TEMPORAL):
            moment = _moment(str(value).strip())
            if moment is not None:
                return F.lit(moment.date()) if isinstance(kind, T.DateType) else F.lit(moment.isoformat(sep=" ")).cast(kind)
    except (ValueError, InvalidOperation, OverflowError):
        pass
    raise PreparationError(f"{value!r} is no value for column {name!r} of type {kind.simpleString()}")


def _moment(text: str) -> datetime | None:
    if text:
        try:
            return datetime.fromisoformat(text).replace(tzinfo=None)
        except ValueError:
            pass
    for form in ("%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d.%m.%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%Y.%m.%d"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    return None


def predicate(schema: T.StructType, column: str, op: str, value: Any = None) -> Column:
    """A three-valued condition; eq and ne compare nulls safely, order never
    matches NaN."""
    _present((column,), schema)
    kind, c = schema[column].dataType, quoted(column)
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if isinstance(kind, E.NESTED):
        raise PreparationError(f"column {column!r} of type {kind.simpleString()} cannot be compared")
    if op == "contains":
        return F.contains(c.cast("string"), F.lit(str(value)))
    if op not in COMPARISONS:
        raise PreparationError(f"there is no comparison {op!r}")
    if value is None:
        raise PreparationError("a comparison needs a value")
    v = literal(value, kind, column)
    if op in ("eq", "ne"):
        return c.eqNullSafe(v) if op == "eq" else ~c.eqNullSafe(v)
    out = {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    return out & ~F.isnan(c) if isinstance(kind, E.FLOATING) else out


# ---------------------------------------------------------------- the steps


def _plain(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if f.name != ORDER]


def _v_drop(p, s):
    names = _names(p)
    _present(names, s)
    if len(names) == len(_plain(s)):
        raise PreparationError("a table keeps one column at least")


def _v_rename(p, s):
    _present((_name(p),), s)
    if _name(p, "to").lower() != _name(p).lower():
        _free(_name(p, "to"), s)


def _v_reorder(p, s):
    order = p.get("order")
    if not isinstance(order, (list, tuple)) or sorted(map(str, order)) != sorted(_plain(s)):
        raise PreparationError("order must name each column once")


def _v_duplicate(p, s):
    _present((_name(p),), s)
    _free(_name(p, "to"), s)


def _v_add(p, s):
    _free(_name(p, "name"), s)
    compile_formula(_name(p, "expression"), s)


def _v_cast(p, s):
    name, to = _name(p), p.get("to")
    _present((name,), s)
    if to not in CAST_TARGETS:
        raise PreparationError(f"cannot cast to {to!r}")
    kind = s[name].dataType
    number = isinstance(kind, (*E.NUMERIC, T.BooleanType))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) or isinstance(kind, E.TEMPORAL) and to in ("integer", "float", "boolean") or number and to in ("date", "datetime") or isinstance(kind, T.BinaryType) and to != "string":
        raise PreparationError(f"a cast of {kind.simpleString()} to {to} has no clear meaning")


def _a_cast(df, p):
    name, to = p["column"], p["to"]
    kind, target, c = df.schema[name].dataType, CAST_TARGETS[p["to"]], quoted(p["column"])
    if isinstance(kind, T.StringType):
        value = {"boolean": E.boolean_words, "date": E.parse_date, "datetime": E.parse_datetime, "float": E.number, "integer": lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("bigint"))}.get(to, lambda x: x)(c)
    else:
        value = c.try_cast(target)
    return _set(df, name, value)


def _v_filter(p, s):
    predicate(s, _name(p), p.get("operator"), p.get("value"))


def _v_sort(p, s):
    name = _name(p)
    _present((name,), s)
    if not isinstance(p.get("descending", False), bool):
        raise PreparationError("descending must be true or false")
    if isinstance(s[name].dataType, T.MapType):
        raise PreparationError(f"column {name!r} has no order")


def _a_sort(df, p):
    """The order column is numbered anew, so later keep-first steps follow it.
    The sort is a range exchange; ids rise with the partitions it makes."""
    c = quoted(p["column"])
    key = c.desc_nulls_last() if p.get("descending") else c.asc_nulls_last()
    return with_order(df).orderBy(key, quoted(ORDER).asc()).withColumn(ORDER, F.monotonically_increasing_id())


def _v_replace(p, s):
    name = _name(p)
    _present((name,), s)
    kind, mode = s[name].dataType, p.get("mode", "exact")
    if mode not in ("exact", "substring"):
        raise PreparationError("mode must be exact or substring")
    if not isinstance(kind, (T.StringType, *E.NUMERIC)):
        raise PreparationError(f"values of type {kind.simpleString()} cannot be replaced")
    if mode == "substring" and (not isinstance(kind, T.StringType) or not p.get("value")):
        raise PreparationError("a substring must be a text and not empty")
    if not isinstance(kind, T.StringType):
        literal(p.get("value"), kind, name)
        literal(p.get("to"), kind, name)


def _a_replace(df, p):
    name = p["column"]
    kind, c = df.schema[name].dataType, quoted(name)
    if not isinstance(kind, T.StringType):
        value = F.when(c == literal(p["value"], kind, name), literal(p["to"], kind, name).cast(kind)).otherwise(c)
    elif p.get("mode", "exact") == "exact":
        value = F.when(c == F.lit(str(p["value"])), F.lit(str(p["to"]))).otherwise(c)
    else:
        value = F.replace(c, F.lit(str(p["value"])), F.lit(str(p["to"])))
    return _set(df, name, value)


def _v_fill(p, s):
    name = _name(p)
    _present((name,), s)
    if isinstance(s[name].dataType, E.NESTED):
        raise PreparationError(f"column {name!r} cannot be filled")
    literal(p.get("value"), s[name].dataType, name)


def _a_fill(df, p):
    name = p["column"]
    kind = df.schema[name].dataType
    return _set(df, name, F.coalesce(quoted(name), literal(p["value"], kind, name).cast(kind)))


def _v_texts(p, s):
    names = _names(p)
    _present(names, s)
    for n in names:
        _textual(s[n].dataType, n)


def _each(df: DataFrame, names: tuple[str, ...], f: Callable[[Column], Column]) -> DataFrame:
    return df.select(*(f(quoted(c)).alias(c) if c in names else quoted(c) for c in df.columns))


def _a_normalize(df, p):
    tokens = [str(t).strip().lower() for t in p.get("tokens") or E.NULL_TOKENS]
    return _each(df, _names(p), lambda c: F.when(F.lower(E.strip(c)).isin(*tokens), None).otherwise(c))


def _v_case(p, s):
    _v_texts(p, s)
    if p.get("mode") not in ("lower", "upper", "title"):
        raise PreparationError("mode must be lower, upper or title")


def _v_dedupe(p, s):
    names = _names(p, may_miss=True)
    _present(names, s)
    for n in names or _plain(s):
        if isinstance(s[n].dataType, T.MapType):
            raise PreparationError(f"column {n!r} cannot be compared")


def _a_dedupe(df, p):
    """Keep the first row of each key. min_by keeps one row on the map side, so a
    key with a third of all rows costs a row a task."""
    had = ORDER in df.columns
    full = with_order(df)
    names = list(_names(p, may_miss=True)) or _plain(full.schema)
    rest = [c for c in full.columns if c not in names and c != ORDER]
    keys = [quoted(c) for c in names]
    if not rest:
        out = full.groupBy(*keys).agg(F.min(quoted(ORDER)).alias(ORDER))
    else:
        best = F.min_by(F.struct(*(quoted(c) for c in rest)), quoted(ORDER)).alias("__first__")
        out = full.groupBy(*keys).agg(best, F.min(quoted(ORDER)).alias(ORDER))
        out = out.select(*(quoted(c) if c in names or c == ORDER else F.col("__first__").getField(c).alias(c) for c in full.columns))
    return out.select(*(quoted(c) for c in full.columns if had or c != ORDER))


def _v_number(p, s):
    name = _name(p)
    _present((name,), s)
    if not isinstance(s[name].dataType, (T.StringType, *E.NUMERIC)):
        raise PreparationError(f"column {name!r} holds no numbers as text")


def _v_datetime(p, s):
    _present((_name(p),), s)
    _textual(s[_name(p)].dataType, _name(p))
    if p.get("format"):
        E.java_notation(str(p["format"]))


def _one(p, s):
    return (_name(p),)


def _many(p, s):
    return _names(p)


OPERATIONS: dict[str, Operation] = {
    "drop_columns": Operation(_v_drop, lambda df, p: df.drop(*_names(p)), lambda p, s: (), lambda p, s: Effect(dropped=_names(p))),
    "rename_column": Operation(_v_rename, lambda df, p: df.withColumnRenamed(p["column"], p["to"]), _one, lambda p, s: Effect(renamed=((p["column"], p["to"]),))),
    "reorder_columns": Operation(_v_reorder, lambda df, p: df.select(*(quoted(c) for c in p["order"]), *(quoted(c) for c in df.columns if c == ORDER)), lambda p, s: (), lambda p, s: Effect()),
    "duplicate_column": Operation(_v_duplicate, lambda df, p: df.withColumn(p["to"], quoted(p["column"])), _one, lambda p, s: Effect(created=((p["to"], (p["column"],)),))),
    "add_column": Operation(
        _v_add,
        lambda df, p: df.withColumn(p["name"], compile_formula(p["expression"], df.schema)),
        lambda p, s: columns_read(p["expression"], s),
        lambda p, s: Effect(created=((p["name"], columns_read(p["expression"], s)),)),
    ),
    "cast_column": Operation(_v_cast, _a_cast, _one, lambda p, s: Effect(mutated=_one(p, s))),
    "filter_rows": Operation(_v_filter, lambda df, p: df.filter(E.truthy(predicate(df.schema, p["column"], p["operator"], p.get("value")))), _one, lambda p, s: Effect(rows=True)),
    "drop_rows": Operation(_v_filter, lambda df, p: df.filter(~E.truthy(predicate(df.schema, p["column"], p["operator"], p.get("value")))), _one, lambda p, s: Effect(rows=True)),
    "sort_rows": Operation(_v_sort, _a_sort, _one, lambda p, s: Effect(rows=True)),
    "replace_values": Operation(_v_replace, _a_replace, _one, lambda p, s: Effect(mutated=_one(p, s))),
    "fill_missing": Operation(_v_fill, _a_fill, _one, lambda p, s: Effect(mutated=_one(p, s))),
    "normalize_nulls": Operation(_v_texts, _a_normalize, _many, lambda p, s: Effect(mutated=_names(p))),
    "deduplicate": Operation(_v_dedupe, _a_dedupe, lambda p, s: _names(p, may_miss=True) or tuple(_plain(s)), lambda p, s: Effect(rows=True)),
    "trim_whitespace": Operation(_v_texts, lambda df, p: _each(df, _names(p), E.strip), _many, lambda p, s: Effect(mutated=_names(p))),
    "change_case": Operation(_v_case, lambda df, p: _each(df, _names(p), {"lower": F.lower, "upper": F.upper, "title": E.title_case}[p["mode"]]), _many, lambda p, s: Effect(mutated=_names(p))),
    "parse_number": Operation(_v_number, lambda df, p: _set(df, p["column"], E.parse_number(quoted(p["column"]))), _one, lambda p, s: Effect(mutated=_one(p, s))),
    "parse_datetime": Operation(_v_datetime, lambda df, p: _set(df, p["column"], E.parse_datetime(quoted(p["column"]), p.get("format"))), _one, lambda p, s: Effect(mutated=_one(p, s))),
}


def operation(step: Step) -> Operation:
    if step.kind not in OPERATIONS:
        raise PreparationError(f"there is no step {step.kind!r}")
    return OPERATIONS[step.kind]
