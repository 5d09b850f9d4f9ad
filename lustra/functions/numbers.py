"""Reading numbers out of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.text import quoted, trim_text

# Fixed value: the number grammar, with whitespace around it. Spark's own cast would also
# take "1.0d", "1f" and hexadecimal floats, which count as text here, so the cast is guarded.
NUMBER_PATTERN = (
    r"(?iU)^[\s\x1c-\x1f]*"
    r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)"
    r"[\s\x1c-\x1f]*$"
)


def parse_number(column: Column | str) -> Column:
    """Text to double; anything outside the grammar becomes null."""
    text = quoted(column) if isinstance(column, str) else column
    return F.when(text.rlike(NUMBER_PATTERN), trim_text(text).try_cast("double"))


def quiet_nan(column: Column, data_type: T.DataType) -> Column:
    """NaN and null are one concept here, so NaN becomes null."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def as_number(name: str, data_type: T.DataType) -> Column | None:
    """The column read as a number, or None where its type never counts as one.

    Dates, timestamps and booleans are never coerced.
    """
    if isinstance(data_type, T.StringType):
        return parse_number(name)
    if isinstance(data_type, T.NumericType):
        return quiet_nan(quoted(name), data_type)
    return None
