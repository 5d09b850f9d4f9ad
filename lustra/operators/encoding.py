"""Label and one-hot encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.text import quoted
from lustra.operators.cleaning import known_columns, replace_columns
from lustra.operators.lookup import GROUP_ROWS, Lookup, build_lookup
from lustra.session import materialize

METHODS = ("label", "onehot")
# Categories of a column that become columns, unless another bound is given; more of them are an error.
MAX_CATEGORIES = 10_000
# Fixed value: the label class of a missing value, sorted among the other classes.
MISSING_CLASS = "nan"
# monotonically_increasing_id keeps the partition above this bit and the row below it.
PARTITION_SHIFT = 33


@dataclass(frozen=True)
class LabelEncoder:
    """One lookup of class and code per column; a class not seen in the fit gets null."""

    lookups: dict[str, Lookup] = field(default_factory=dict)

    @property
    def shuffles(self) -> bool:
        """Whether the transform joins a table too large to broadcast."""
        return any(not lookup.broadcastable for lookup in self.lookups.values())

    def transform(self, df: DataFrame) -> DataFrame:
        for column, lookup in self.lookups.items():
            if column not in df.columns:
                continue
            (code,) = lookup.value_columns
            classes = F.coalesce(quoted(column).cast("string"), F.lit(MISSING_CLASS))
            attached = lookup.attach(df.withColumn(lookup.key, classes))
            df = replace_columns(attached, {column: quoted(code)}).drop(lookup.key, code)
        return df


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``class``, ``code`` and the rows behind each class; codes follow the text order.

    The distinct classes are sorted across partitions and written once. A class's code is
    its place within its partition plus the sizes of the partitions before it, so the
    order costs no single-partition window.
    """
    classes = F.coalesce(quoted(column).cast("string"), F.lit(MISSING_CLASS)).alias("class")
    counted = df.select(classes).groupBy("class").agg(F.count(F.lit(1)).alias(GROUP_ROWS))
    placed = materialize(
        counted.orderBy("class").withColumn("_place", F.monotonically_increasing_id()),
        "label-classes",
    )
    part = F.shiftright("_place", PARTITION_SHIFT)
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["count"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(starts, "part bigint, start bigint")
    within = F.col("_place").bitwiseAND(F.lit((1 << PARTITION_SHIFT) - 1))
    # One row per shuffle partition: bounded by the partition count, not by the data.
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .select("class", (F.col("start") + within).alias("code"), GROUP_ROWS)
    )


def fit_labels(df: DataFrame, columns: Sequence[str]) -> LabelEncoder:
    lookups = {}
    for column in known_columns(df, columns):
        key = f"_class_of_{column}"
        codes = label_codes(df, column).withColumnsRenamed(
            {"class": key, "code": f"_code_of_{column}"}
        )
        lookups[column] = build_lookup(codes, key, written=True)
    return LabelEncoder(lookups)


@dataclass(frozen=True)
class OneHotEncoder:
    """The categories of each column in value order; null and unseen values are all false."""

    categories: dict[str, list[Any]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for column, values in self.categories.items():
            if column not in df.columns:
                continue
            names = {f"{column}_{_text(v)}": v for v in values}
            taken = (set(df.columns) - {column}) & set(names)
            if taken:
                raise ValueError(f"one-hot columns already exist: {sorted(taken)}")
            df = df.select(
                *[quoted(c) for c in df.columns if c != column],
                *[
                    F.coalesce(quoted(column) == F.lit(v), F.lit(False)).alias(name)
                    for name, v in names.items()
                ],
            )
        return df


def _text(value: Any) -> str:
    """Category text as Spark casts it."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def fit_onehot(
    df: DataFrame, columns: Sequence[str], max_categories: int | None = MAX_CATEGORIES
) -> OneHotEncoder:
    """Collect the categories, which become columns; more than ``max_categories`` are an error, None is no bound."""
    categories = {}
    for column in known_columns(df, columns):
        values = df.select(quoted(column).alias("v")).filter("v is not null").distinct()
        if max_categories is not None:
            values = values.limit(max_categories + 1)
        found = [row["v"] for row in values.collect()]
        if max_categories is not None and len(found) > max_categories:
            raise ValueError(f"column {column!r} has more than {max_categories} categories")
        categories[column] = sorted(found)
    return OneHotEncoder(categories)


def encode_categorical(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "label",
    max_categories: int | None = MAX_CATEGORIES,
) -> DataFrame:
    """Fit and apply in one call."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    model = fit_labels(df, columns) if method == "label" else fit_onehot(df, columns, max_categories)
    return model.transform(df)
