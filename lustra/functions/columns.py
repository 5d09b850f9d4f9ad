"""Schema rules: which columns count as numeric, text, identifier or never-negative."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A column whose lower-case name contains one of these must not be negative.
NEVER_NEGATIVE_WORDS = (
    "salary",
    "age",
    "price",
    "cost",
    "amount",
    "count",
    "quantity",
    "revenue",
    "income",
)

# Identifier names, next to every name that ends in "_id".
IDENTIFIER_NAMES = ("id", "ID", "Id", "uuid", "UUID", "guid", "GUID")
IDENTIFIER_SUFFIX = "_id"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def id_columns(names: Iterable[str]) -> list[str]:
    return [n for n in names if n in IDENTIFIER_NAMES or n.lower().endswith(IDENTIFIER_SUFFIX)]


def rejects_negatives(name: str) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in NEVER_NEGATIVE_WORDS)


def data_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}


def is_fixed_width(data_type: T.DataType) -> bool:
    """Types whose running aggregate value fits in place in Spark's hash aggregate."""
    return isinstance(
        data_type,
        (
            T.BooleanType,
            T.ByteType,
            T.ShortType,
            T.IntegerType,
            T.LongType,
            T.FloatType,
            T.DoubleType,
            T.DateType,
            T.TimestampType,
            T.TimestampNTZType,
        ),
    )
