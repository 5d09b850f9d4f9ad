"""Forward and backward fill over a total row order, without gathering rows in one task.

A window over the whole table would plan a single partition. Here the order is cut into
buckets along frozen boundaries; a window fills inside each bucket, and one row per bucket
carries the last value seen before it. The carries are a small table of bounded length.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types
from lustra.functions.text import quoted
from lustra.operators.cleaning import known_columns

DIRECTIONS = ("forward", "backward")
ROWS_PER_BUCKET = 4_000_000
MAX_BUCKETS = 8192
SKETCH_ACCURACY = 50_000
# A position that holds this share of the rows is cut further by the rest of the order.
HOT_SHARE = 1 / 128
MAX_INNER_CUTS = 512
INNER_SAMPLE_ROWS = 20_000
# Room for the inner buckets of one outer bucket; the last one is for larger positions.
INNER_RANGE = MAX_INNER_CUTS + 2

POSITION, OUTER, BUCKET = "_position", "_outer_bucket", "_bucket"


def order_position(name: str, data_type: T.DataType) -> Column:
    """The order column as a double that never decreases where the column increases."""
    column = quoted(name)
    if isinstance(data_type, T.NumericType):
        return column.cast("double")
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(data_type, T.TimestampNTZType):
        seconds = F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
        return (F.unix_date(column.cast("date")).cast("bigint") * 86400 + seconds).cast("double")
    raise ValueError(f"the first order column must be a number, date or timestamp: {name}")


def _to_plain(name: str, data_type: T.DataType) -> Column:
    """An order value in a form that comes back from the driver unchanged in any time zone."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(quoted(name))
    if isinstance(data_type, T.TimestampNTZType):
        return quoted(name).cast("string")
    return quoted(name)


def _from_plain(value: Any, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(data_type)


@dataclass(frozen=True)
class OrderedFill:
    """Frozen bucket boundaries; ``transform`` starts no job."""

    order_by: tuple[str, ...]
    columns: tuple[str, ...]
    direction: str
    cuts: tuple[float, ...]
    inner_cuts: tuple[tuple[float, tuple[tuple, ...]], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        bucketed = self._with_bucket(df)
        forward = self.direction == "forward"
        order = [quoted(c) for c in self.order_by]
        last_key = order[0] if len(order) == 1 else F.struct(*order)

        nearest = F.max_by if forward else F.min_by
        carried = {c: f"_carried_{i}" for i, c in enumerate(self.columns)}
        per_bucket = bucketed.groupBy(BUCKET).agg(
            *[
                nearest(quoted(c), F.when(quoted(c).isNotNull(), last_key)).alias(carried[c])
                for c in self.columns
            ]
        )
        # One row per bucket, at most MAX_BUCKETS and the inner cuts: safe in one task.
        bucket_order = F.col(BUCKET).asc() if forward else F.col(BUCKET).desc()
        before = Window.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
        carries = per_bucket.select(
            BUCKET,
            *[F.last(name, ignorenulls=True).over(before).alias(name) for name in carried.values()],
        )

        inside = (
            Window.partitionBy(BUCKET)
            .orderBy(*[c.asc() if forward else c.desc() for c in order])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        in_bucket = {c: f"_inside_{i}" for i, c in enumerate(self.columns)}
        filled = bucketed.select(
            "*",
            *[
                F.last(quoted(c), ignorenulls=True).over(inside).alias(in_bucket[c])
                for c in self.columns
            ],
        )
        # The window left the rows partitioned and sorted by bucket, so a merge join moves
        # the carries only. They are few, but their texts may be long: no broadcast is forced.
        joined = filled.join(carries.hint("merge"), BUCKET, "left")
        return joined.select(
            *[
                F.coalesce(F.col(in_bucket[c]), F.col(carried[c])).alias(c)
                if c in carried
                else quoted(c)
                for c in df.columns
            ]
        )

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        first = self.order_by[0]
        placed = df.withColumn(POSITION, order_position(first, data_types(df)[first]))
        if self.cuts:
            splits = [-math.inf, *self.cuts, math.inf]
            placed = Bucketizer(splits=splits, inputCol=POSITION, outputCol=OUTER).transform(placed)
        else:
            placed = placed.withColumn(OUTER, F.lit(0.0))
        inner = F.lit(0)
        if self.inner_cuts:
            inner = self._inner_bucket(data_types(df))
        bucket = F.col(OUTER).cast("bigint") * INNER_RANGE + inner
        return placed.withColumn(BUCKET, bucket).drop(POSITION, OUTER)

    def _inner_bucket(self, types: dict[str, T.DataType]) -> Column:
        """Inner bucket of the hot positions.

        A hot position starts its own outer bucket, so what else lies in there comes later
        in the order and takes the last inner bucket.
        """
        key = F.struct(*[quoted(c).alias(c) for c in self.order_by])

        def boundary(values: tuple) -> Column:
            return F.struct(
                *[
                    _from_plain(v, types[c]).alias(c)
                    for c, v in zip(self.order_by, values, strict=True)
                ]
            )

        def search(cuts: tuple[tuple, ...], low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(key < boundary(cuts[middle]), search(cuts, low, middle)).otherwise(
                search(cuts, middle + 1, high)
            )

        hot = [position for position, _ in self.inner_cuts]
        inner = F.lit(0)
        for position, cuts in self.inner_cuts:
            inner = F.when(F.col(POSITION) == position, search(cuts, 0, len(cuts))).otherwise(inner)
        starts = [float(c) for c in self.cuts]
        after_hot = [float(bisect_left(starts, p) + 1) for p in hot]
        is_later = F.col(OUTER).isin(after_hot) & ~F.col(POSITION).isin(hot)
        return F.when(is_later, F.lit(INNER_RANGE - 1)).otherwise(inner)


def fit_ordered_fill(
    df: DataFrame,
    order_by: str | Sequence[str] | None,
    columns: Sequence[str] | None = None,
    direction: str = "forward",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    hot_share: float = HOT_SHARE,
) -> OrderedFill:
    """Choose the bucket boundaries from a quantile sketch of the first order column.

    Only columns with missing cells are filled; the same pass counts them.
    ``order_by`` must be unique together and free of nulls. Positions that hold a large
    share of the rows are cut again, along a bounded sample of the whole order.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    order = (order_by,) if isinstance(order_by, str) else tuple(order_by or ())
    if not order:
        raise ValueError("an ordered fill needs order_by")
    wanted = known_columns(df, columns) if columns else df.columns
    wanted = [c for c in wanted if c not in set(order)]
    types = data_types(df)
    position = order_position(order[0], types[order[0]])
    # As text, since a column object per grid point would take seconds to build.
    grid = ", ".join(f"{i / MAX_BUCKETS!r}D" for i in range(1, MAX_BUCKETS))
    sketch = f"percentile_approx({POSITION}, array({grid}), {SKETCH_ACCURACY})"
    sketched = df.withColumn(POSITION, position).agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(sketch).alias("grid"),
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(wanted)],
    ).first()
    rows, quantiles = sketched["rows"], sketched["grid"] or []
    chosen = [c for i, c in enumerate(wanted) if sketched[f"n{i}"] < rows]
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    buckets = min(MAX_BUCKETS, max(math.ceil(rows / rows_per_bucket), parallelism))
    cuts = {quantiles[MAX_BUCKETS * i // buckets - 1] for i in range(1, buckets)} if rows else set()

    shares = {v: n / MAX_BUCKETS for v, n in Counter(quantiles).items()}
    hot = {v: share for v, share in shares.items() if share >= max(hot_share, 2 / buckets)}
    inner = _inner_cuts(df, order, position, hot, rows, buckets) if hot else ()
    cuts |= {p for p, _ in inner}
    return OrderedFill(order, tuple(chosen), direction, tuple(sorted(cuts)), inner)


def _inner_cuts(
    df: DataFrame,
    order: tuple[str, ...],
    position: Column,
    hot: dict[float, float],
    rows: int,
    buckets: int,
) -> tuple[tuple[float, tuple[tuple, ...]], ...]:
    """Boundaries of the whole order inside each hot position, from a bounded sample."""
    hot_rows = rows * sum(hot.values())
    types = data_types(df)
    sample = (
        df.select(position.alias(POSITION), *[quoted(c) for c in order])
        .filter(F.col(POSITION).isin(list(hot)))
        .sample(min(1.0, INNER_SAMPLE_ROWS / hot_rows), seed=7)
        .orderBy(*[quoted(c) for c in order])
        .select(POSITION, *[_to_plain(c, types[c]).alias(c) for c in order])
        .collect()
    )
    found = []
    for value, share in sorted(hot.items()):
        # The sample is in order, so a dict keeps the distinct keys in order as well.
        here = (tuple(r[c] for c in order) for r in sample if r[POSITION] == value)
        keys = list(dict.fromkeys(here))
        wanted = min(math.ceil(share * buckets), math.floor(share * MAX_INNER_CUTS), len(keys))
        places = dict.fromkeys(len(keys) * i // (wanted + 1) for i in range(1, wanted + 1))
        if places:
            found.append((value, tuple(keys[place] for place in places)))
    return tuple(found)


def forward_fill(
    df: DataFrame, order_by: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Last non-null value above, in the given order; leading nulls stay."""
    return fit_ordered_fill(df, order_by, columns, "forward").transform(df)


def backward_fill(
    df: DataFrame, order_by: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """First non-null value below, in the given order; trailing nulls stay."""
    return fit_ordered_fill(df, order_by, columns, "backward").transform(df)
