"""Profiles and reports. Tables in, small tables out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types, numeric_columns, text_columns
from lustra.functions.numbers import quiet_nan
from lustra.functions.text import quoted
from lustra.operators.quantiles import column_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def _present(df: DataFrame) -> dict[str, Column]:
    """Each column with NaN read as null."""
    return {f.name: quiet_nan(quoted(f.name), f.dataType) for f in df.schema}


def missing_cells(df: DataFrame) -> Column:
    """Aggregate: null cells over all columns."""
    counts = [F.count_if(c.isNull()) for c in _present(df).values()]
    return reduce(lambda a, b: a + b, counts, F.lit(0).cast("bigint"))


def cell_counts(df: DataFrame) -> DataFrame:
    """One row: ``rows``, ``missing_cells``, and ``duplicate_rows`` beyond the first of each distinct row.

    Rows are compared on raw values; null equals null. All three come from one pass, as the distinct rows with their counts
    tell the others. Map columns cannot be compared: they are left out of the comparison and only counted.
    """
    types = data_types(df)
    present = _present(df)
    comparable = [c for n, c in present.items() if not isinstance(types[n], T.MapType)]
    others = [c for n, c in present.items() if isinstance(types[n], T.MapType)]
    zero = F.lit(0).cast("bigint")
    keys = [f"k{i}" for i in range(len(comparable))]
    distinct = df.groupBy(*[c.alias(k) for c, k in zip(comparable, keys, strict=True)]).agg(
        F.count(F.lit(1)).alias("copies"),
        reduce(lambda a, b: a + b, [F.count_if(c.isNull()) for c in others], zero).alias("others"),
    )
    nulls = reduce(lambda a, b: a + b, [F.isnull(k).cast("bigint") for k in keys], zero)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), zero)

    return distinct.agg(
        total(F.col("copies")).alias("rows"),
        total(nulls * F.col("copies") + F.col("others")).alias("missing_cells"),
        total(F.col("copies") - 1).alias("duplicate_rows"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each distinct row."""
    return cell_counts(df).select("duplicate_rows")


def merge_single_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Put one-row tables with different columns side by side without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(quoted(c)).alias(c) for c in stacked.columns])


def quality_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, numeric and text columns."""
    return cell_counts(df).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "missing_cells",
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(text_columns(df))).cast("bigint").alias("text_columns"),
        "duplicate_rows",
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, sample std, min, exact quartiles, max."""
    present = _present(df)
    chosen = [c for c in numeric_columns(df) if columns is None or c in set(columns)]
    values = {c: present[c].cast("double") for c in chosen}
    quartiles = column_quantiles(df, values, QUARTILES)
    numbers = df.select(*[values[c].alias(f"v{i}") for i, c in enumerate(chosen)])
    aggregates, rows = [], []
    for i, c in enumerate(chosen):
        aggregates += [
            F.count(f"v{i}").alias(f"count{i}"),
            F.avg(f"v{i}").alias(f"mean{i}"),
            F.stddev_samp(f"v{i}").alias(f"std{i}"),
            F.min(f"v{i}").alias(f"min{i}"),
            F.max(f"v{i}").alias(f"max{i}"),
        ]
        p25, p50, p75 = (F.lit(q).cast("double") for q in quartiles[c])
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"count{i}").alias("count"),
                F.col(f"mean{i}").alias("mean"),
                F.col(f"std{i}").alias("std"),
                F.col(f"min{i}").alias("min"),
                p25.alias("p25"),
                p50.alias("p50"),
                p75.alias("p75"),
                F.col(f"max{i}").alias("max"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame(
            [],
            "column string, count bigint, mean double, std double, min double, "
            "p25 double, p50 double, p75 double, max double",
        )
    return numbers.agg(*aggregates).select(F.inline(F.array(*rows)))


def column_info(df: DataFrame) -> DataFrame:
    """One row per column: name, non-null count, type."""
    present = _present(df)
    types = data_types(df)
    counts = [F.count(c).alias(f"n{i}") for i, c in enumerate(present.values())]
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"n{i}").alias("non_null"),
            F.lit(types[name].simpleString()).alias("type"),
        )
        for i, name in enumerate(present)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def preview(df: DataFrame, order_by: str | Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows in the given order; planned as a top-k, not as a full sort."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[quoted(o) for o in order]).limit(rows)
