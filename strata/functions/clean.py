"""Column-level cleaning expressions (FN-01..FN-08).

Every function takes a column name (and, where the result depends on the
type, the column's data type) and returns a Spark ``Column``: nothing here
touches rows on the driver, so a stage of rules folds into one ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# The whitespace set of Python's str.strip() (Unicode White_Space
# plus the ASCII separators U+001C..U+001F), as a Java regex character class.
PY_WHITESPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x85\\xA0\\u1680"
    "\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL_TYPES)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIME_TYPES)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


#: Decimal numbers, exponents and the names of infinity; no type suffixes, no hexadecimal.
NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
WHOLE_RE = r"^\s*[+-]?[0-9]+\s*$"


def text_double(text: Column) -> Column:
    """Text that is a number as double, else null (NaN counts as null)."""
    return F.when(text.rlike(NUMBER_RE), F.trim(text).try_cast("double"))


def text_long(text: Column) -> Column:
    """Whole-number text read exactly (no way through double, which loses
    digits above 2^53); other number text through double."""
    return F.when(text.rlike(WHOLE_RE), F.trim(text).try_cast("bigint")).otherwise(text_double(text).try_cast("bigint"))


def to_double(c: str, dtype: T.DataType) -> Column:
    """FN-01 numeric coerce: bad text -> null (D1); integers stay integers (D3)."""
    if is_numeric(dtype):
        return F.col(c)
    if isinstance(dtype, T.BooleanType):
        return F.col(c).cast("double")
    return text_double(F.col(c))


def as_double(c: str, dtype: T.DataType) -> Column:
    """Like ``to_double`` but always DOUBLE (used for statistics)."""
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return F.col(c).cast("double")
    return text_double(F.col(c))


def fractional_flag(c: str, dtype: T.DataType) -> Column:
    """Aggregate: true when any parsed value has a fractional part."""
    if is_integral(dtype):
        return F.lit(False)
    d = as_double(c, dtype)
    return F.coalesce(F.max((d != F.floor(d)) & ~F.isnan(d)), F.lit(False))


def to_integer(c: str, dtype: T.DataType) -> Column:
    """FN-02 nullable integer, applied once the whole column is known to hold
    whole numbers only (``fractional_flag`` false)."""
    if is_integral(dtype):
        return F.col(c).cast("long")
    return text_long(F.col(c)) if is_string(dtype) else as_double(c, dtype).try_cast("long")


def to_text(c: str, dtype: T.DataType) -> Column:
    """FN-03 text cast; null stays null."""
    if is_string(dtype):
        return F.col(c)
    return F.col(c).cast("string")


def to_timestamp_any(c: str, dtype: T.DataType) -> Column:
    """FN-04 generic date parse, bad -> null."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.col(c)
    if isinstance(dtype, T.DateType):
        return F.col(c).cast("timestamp")
    from .dates import parse_generic
    return parse_generic(F.col(f"`{c}`").cast("string"))


def lower(c: str) -> Column:
    return F.lower(F.col(c).cast("string"))


def upper(c: str) -> Column:
    return F.upper(F.col(c).cast("string"))


def title(c: str) -> Column:
    """FN-06 title case that capitalises every run of cased letters (D12):
    mark a word start after each non-cased character, ``initcap``, unmark."""
    marked = F.regexp_replace(F.col(c).cast("string"), "([^\\p{Lu}\\p{Ll}\\p{Lt}])", "$1\u0001 ")
    return F.regexp_replace(F.initcap(marked), "\u0001 ", "")


def strip(c: str) -> Column:
    """FN-07 strip all (Unicode) whitespace at both ends."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(F.col(c).cast("string"), f"^{ws}+|{ws}+$", "")


def fill_default(c: str, dtype: T.DataType) -> Column | None:
    """FN-08 fill null with "" for text columns; None (no change) otherwise."""
    if is_string(dtype):
        return F.coalesce(F.col(c), F.lit(""))
    return None


def fill_value(c: str, dtype: T.DataType, value) -> Column | None:
    """Fill nulls of ``c`` with a scalar computed by a statistic (AG-05..07).

    Returns None when the value cannot be stored without changing the type
    (a fractional value in an integer column), which mirrors the reference
    leaving such a column unchanged.
    """
    if value is None:
        return None
    if is_integral(dtype):
        if isinstance(value, float) and not float(value).is_integer():
            return None
        return F.coalesce(F.col(c), F.lit(int(value)).cast(dtype))
    if is_numeric(dtype):
        return F.coalesce(F.col(c), F.lit(value).cast(dtype))
    if is_string(dtype):
        text = repr(float(value)) if isinstance(value, float) else str(value)
        return F.coalesce(F.col(c), F.lit(text))
    return F.coalesce(F.col(c), F.lit(value).cast(dtype))
