"""Values of a column as JSON and back, without loss: what is stored with a filter
must select the very same rows when it is read again."""

from __future__ import annotations

import base64
import datetime as dt
import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError

MAX_TEXT = 4096
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class NotStorable(PreparationError):
    """A value that no exact form stands for."""


def _checked(value: Any, kind: type, wanted: T.DataType) -> Any:
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
        raise NotStorable(f"{type(value).__name__} is no value of {wanted.simpleString()}")
    return value


def encode(value: Any, kind: T.DataType) -> Any:
    """A text, number or truth value. Decimals, times and bytes are texts (a JSON
    number would lose digits); durations are whole microseconds. Refused: nulls, texts
    beyond MAX_TEXT (cut ones would select other rows), NaN and infinities (no
    equality), nested types."""
    if value is None:
        raise NotStorable("a missing value is no value of a filter")
    if isinstance(kind, T.StringType):
        if len(_checked(value, str, kind)) > MAX_TEXT:
            raise NotStorable("the text is too long for a filter")
        return value
    if isinstance(kind, T.BooleanType):
        return _checked(value, bool, kind)
    if isinstance(kind, _WHOLE):
        return _checked(value, int, kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        number = float(_checked(value, (int, float), kind))
        if not math.isfinite(number):
            raise NotStorable("NaN and infinities equal nothing that a filter could name")
        return number
    if isinstance(kind, T.DecimalType):
        return str(_checked(value, (int, Decimal), kind))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _checked(value, dt.datetime, kind).isoformat()
    if isinstance(kind, T.DateType):
        return _checked(value, dt.date, kind).isoformat()
    if isinstance(kind, T.TimeType):
        return _checked(value, dt.time, kind).isoformat()
    if isinstance(kind, T.DayTimeIntervalType):
        return _checked(value, dt.timedelta, kind) // dt.timedelta(microseconds=1)
    if isinstance(kind, T.BinaryType):
        return base64.b64encode(bytes(_checked(value, (bytes, bytearray), kind))).decode()
    raise NotStorable(f"{kind.simpleString()} is no type of a filter's value")


def decode(stored: Any, kind: T.DataType) -> Column:
    """The value as a literal of the column's type. Times with a zone name an instant;
    those without are taken in the session's zone, as they were read."""
    if isinstance(kind, T.StringType):
        return F.lit(str(stored))
    if isinstance(kind, T.BooleanType):
        return F.lit(bool(stored))
    if isinstance(kind, (*_WHOLE, T.FloatType, T.DoubleType)):
        return F.lit(stored).cast(kind)
    if isinstance(kind, T.DecimalType):
        return F.lit(str(stored)).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)):
        return F.lit(str(stored)).cast(kind)
    if isinstance(kind, T.DayTimeIntervalType):
        return F.lit(dt.timedelta(microseconds=int(stored)))
    if isinstance(kind, T.BinaryType):
        return F.unbase64(F.lit(str(stored)))
    raise NotStorable(f"{kind.simpleString()} is no type of a filter's value")
