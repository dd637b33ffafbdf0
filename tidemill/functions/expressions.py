"""Column expressions that several operators share.

Spark runs in ANSI mode: whatever may fail on data goes through ``try_`` forms, so
that a value that cannot be read becomes null and never ends the job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError

# The text forms that mean "no value", "true" and "false".
NULL_TOKENS = ("", "-", "—", "н/д", "нд", "n/a", "na", "null", "none", "нет данных")
TRUE_WORDS = ("1", "true", "t", "yes", "y", "да", "истина")
FALSE_WORDS = ("0", "false", "f", "no", "n", "нет", "ложь")
# Date notations tried in this order, the day before the month.
DATE_NOTATIONS = ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "yyyy.M.d")
DATETIME_NOTATIONS = (
    "yyyy-M-d'T'H:m:s[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-M-d H:m:s[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-M-d'T'H:m",
    "yyyy-M-d H:m",
    "d.M.yyyy H:m:s",
    "d.M.yyyy H:m",
    "d/M/yyyy H:m:s",
    "d/M/yyyy H:m",
)

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SPECIAL_NUMBER = r"(?i)^[+-]?(inf|infinity|nan)$"
_STRPTIME = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%y": "yy", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "h", "%%": "%"}

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def number(text: Column) -> Column:
    """A double, or null where the text is no plain notation of one. Java's
    suffixes (``5d``) are no numbers."""
    return F.when(text.rlike(NUMBER) | text.rlike(SPECIAL_NUMBER), text.try_cast("double"))


def _marks(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.translate(text, mark, ""))


def parse_number(c: Column) -> Column:
    """Numbers with spaces, digit groups and a decimal comma or point.

    Of two kinds of marks the later one is the decimal mark and the other groups
    digits; a single mark is decimal; several of one kind group digits. Groups count
    only if the first has one to three digits and each other one three."""
    text = F.regexp_replace(c.cast("string"), r"(?U)[\s\u00a0]", "")
    sign = F.regexp_extract(text, "^[+-]?", 0)
    body = F.substring(text, F.length(sign) + 1, F.length(text))
    points, commas = _marks(body, "."), _marks(body, ",")
    both = (points > 0) & (commas > 0)
    ends = F.reverse(body)
    decimal = F.when(F.instr(ends, ",") < F.instr(ends, "."), ",").otherwise(".")
    whole = F.when(both, F.split_part(body, decimal, F.lit(1))).otherwise(body)
    fraction = F.when(both, F.substring(body, F.length(whole) + 2, F.length(body))).otherwise("0")
    groups = F.split(F.translate(whole, ".,", "  "), " ")
    sound = groups[0].rlike(r"^\d{1,3}$") & F.forall(F.slice(groups, 2, F.size(groups)), lambda g: g.rlike(r"^\d{3}$")) & fraction.rlike(r"^\d+$")
    joined = F.concat(sign, F.array_join(groups, ""), F.lit("."), fraction)
    return number(F.when((both | (points > 1) | (commas > 1)) & sound, joined).otherwise(F.translate(text, ",", ".")))


def parse_date(c: Column) -> Column:
    text = strip(c)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_NOTATIONS))


def parse_datetime(c: Column, notation: str | None = None) -> Column:
    """A timestamp without zone; a date alone is its midnight."""
    text = strip(c.cast("string"))
    forms = (java_notation(notation),) if notation else (*DATETIME_NOTATIONS, *DATE_NOTATIONS)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms))


def java_notation(notation: str) -> str:
    """A strptime format as a Java one."""
    out, i, quoting = "", 0, ""
    while i < len(notation):
        two = notation[i : i + 2]
        if two in _STRPTIME:
            out, i = out + _STRPTIME[two], i + 2
        elif notation[i] == "%":
            raise PreparationError(f"unknown directive {two!r} in a date format")
        else:
            quoting = notation[i]
            out += f"'{quoting}'" if quoting.isalpha() else quoting
            i += 1
    return out


def boolean_words(c: Column) -> Column:
    text = F.lower(strip(c))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def is_nan(c: Column, kind: T.DataType) -> Column:
    return F.coalesce(F.isnan(c), F.lit(False)) if isinstance(kind, FLOATING) else F.lit(False)


def finite(c: Column, kind: T.DataType) -> Column:
    """c, with null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c) if isinstance(kind, FLOATING) else c


def steady_sum(c: Column) -> Column:
    """The sum of doubles, the same for any order of rows: whole parts and fractions (in
    units of 2^-30) are summed as longs. What is not finite or is 2^32 and beyond is
    summed as it is."""
    small = F.abs(c) < F.lit(float(1 << 32))
    whole = F.floor(c)
    units = F.floor((c - whole) * float(1 << 30) + 0.5)
    parts = F.sum(F.when(small, whole)).cast("double"), F.sum(F.when(small, units)) / float(1 << 30), F.sum(F.when(~small, c))
    return F.when(F.count(c) > 0, reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)))


def truthy(predicate: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(predicate, F.lit(False))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def title_case(c: Column) -> Column:
    """The first letter of each run of letters in upper case, the rest in lower."""
    words = F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def as_text(f: T.StructField) -> Column:
    """A text that tells the values of a column apart as grouping does."""
    c = quoted(f.name)
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(f.dataType, FLOATING):
        c = F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)
    return c.cast("string")
