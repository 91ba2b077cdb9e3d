"""Date parsing (FN-04, FN-05) and the whole-column format vote (AG-18, D4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import to_timestamp_any

# The ten date formats tried in this order (the reference's
# strptime list, written as Spark datetime patterns that also accept
# non-padded digits as pandas does).
DATE_FORMATS = [
    "yyyy-M-d",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyyMMdd",
    "d-MMM-yyyy",
    "d-MMMM-yyyy",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s",
    "M-d-yyyy",
    "d.M.yyyy",
]


# The text shape each format can match (same order as
# DATE_FORMATS). A parse is only attempted on text of the right shape: a
# failed ``try_to_timestamp`` costs an exception inside the JVM, a regex
# test does not.
DATE_SHAPES = [
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    r"^[0-9]{8}$",
    r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$",
    r"^[0-9]{1,2}-[A-Za-z]+-[0-9]{4}$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
    r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    r"^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$",
]
_SHAPE = dict(zip(DATE_FORMATS, DATE_SHAPES))


def parse_text_with(text: Column, fmt: str) -> Column:
    """``try_to_timestamp(text, fmt)`` guarded by the format's text shape."""
    return F.when(text.rlike(_SHAPE[fmt]), F.try_to_timestamp(text, F.lit(fmt)))


def parse_with(c: str, fmt: str) -> Column:
    return parse_text_with(F.col(f"`{c}`"), fmt)


# the generic cast only reads text that starts with a year
ISO_SHAPE = r"^\s*[+-]?[0-9]{4}"


def parse_generic(text: Column) -> Column:
    """FN-04 generic parse (ISO-like text), guarded like the formats."""
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def parse_per_value(c: str, dtype: T.DataType) -> Column:
    """``per_value`` mode: every value takes the first format that parses it."""
    if not isinstance(dtype, T.StringType):
        return to_timestamp_any(c, dtype)
    return F.coalesce(*[parse_with(c, f) for f in DATE_FORMATS], parse_generic(F.col(f"`{c}`")))


def format_vote_exprs(c: str) -> list[Column]:
    """AG-18: one count per format, all in one aggregate."""
    return [F.count(parse_with(c, f)).alias(f"_fmt{i}") for i, f in enumerate(DATE_FORMATS)]


def first_format_from_votes(votes: list[int]) -> str | None:
    for fmt, n in zip(DATE_FORMATS, votes):
        if n and n > 0:
            return fmt
    return None


def parse_first_format(c: str, dtype: T.DataType, fmt: str | None) -> Column:
    """``first_format`` mode (faithful, D4): the first format that parses at
    least one value wins for the whole column; other values become null."""
    if not isinstance(dtype, T.StringType):
        return to_timestamp_any(c, dtype)
    if fmt is None:
        return parse_generic(F.col(f"`{c}`"))
    return parse_with(c, fmt)


def vote(df: DataFrame, c: str) -> str | None:
    """Run the vote for one column (one aggregate job)."""
    row = df.agg(*format_vote_exprs(c)).first()
    return first_format_from_votes(list(row))
