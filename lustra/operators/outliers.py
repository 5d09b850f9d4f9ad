"""Outliers: cap them or remove their rows, by interquartile range or by z-score."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types, numeric_columns
from lustra.functions.numbers import as_number
from lustra.functions.text import quoted
from lustra.operators.cleaning import known_columns, replace_columns
from lustra.operators.quantiles import column_quantiles

METHODS = ("iqr", "zscore")
DEFAULT_FACTOR = 1.5
# Fixed value: the z-score threshold does not depend on the factor.
Z_THRESHOLD = 3.0


@dataclass(frozen=True)
class Bounds:
    """Fitted limits of one column. With ``mean`` set the test is on the z-score."""

    column: str
    low: float
    high: float
    mean: float | None = None
    std: float | None = None

    def is_low(self, number: Column) -> Column:
        if self.mean is None:
            return number < self.low
        return (F.abs((number - self.mean) / self.std) >= Z_THRESHOLD) & (number < self.mean)

    def is_high(self, number: Column) -> Column:
        if self.mean is None:
            return number > self.high
        return (F.abs((number - self.mean) / self.std) >= Z_THRESHOLD) & (number > self.mean)


@dataclass(frozen=True)
class OutlierModel:
    """Bounds per column, and whether to cap values or to remove rows. Null is never an outlier."""

    bounds: tuple[Bounds, ...]
    cap: bool

    @property
    def drops(self) -> bool:
        """Whether the transform drops rows."""
        return not self.cap

    def report(self, df: DataFrame) -> DataFrame:
        """One row per column: values beyond its bounds in ``df``."""
        types = data_types(df)
        rows = []
        for b in self.bounds:
            number = as_number(b.column, types[b.column])
            outside = F.count_if(b.is_low(number) | b.is_high(number))
            rows.append(F.struct(F.lit(b.column).alias("column"), outside.alias("outliers")))
        if not rows:
            return df.sparkSession.createDataFrame([], "column string, outliers bigint")
        return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))

    def transform(self, df: DataFrame) -> DataFrame:
        types = data_types(df)
        present = [b for b in self.bounds if b.column in types]
        if self.cap:
            return replace_columns(df, {b.column: _capped(b, types[b.column]) for b in present})
        for b in present:
            number = as_number(b.column, types[b.column])
            outside = b.is_low(number) | b.is_high(number)
            df = df.filter(~F.coalesce(outside, F.lit(False)))
        return df


def _capped(bounds: Bounds, data_type: T.DataType) -> Column:
    """Text stays text, as only some of its cells may be numbers; numbers become double."""
    number = as_number(bounds.column, data_type).cast("double")
    low, high, rest = F.lit(bounds.low), F.lit(bounds.high), number
    if isinstance(data_type, T.StringType):
        low, high, rest = low.cast("string"), high.cast("string"), quoted(bounds.column)
    return (
        F.when(bounds.is_low(number), low).when(bounds.is_high(number), high).otherwise(rest)
    )


def fit_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "iqr",
    factor: float = DEFAULT_FACTOR,
    cap: bool = False,
    simultaneous: bool = False,
) -> OutlierModel:
    """Fit the bounds; without ``columns`` every numeric column takes part.

    Capping needs one fit for all columns. It turns a column into double, so an integer
    column without any outlier is left out, which spares large identifiers. Removing rows
    fits each column on the rows the columns before it left over; ``simultaneous`` fits all
    of them on the whole input.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    chosen = known_columns(df, columns) if columns is not None else numeric_columns(df)
    if cap:
        bounds = _fit_bounds(df, chosen, method, factor)
        return OutlierModel(tuple(_needed_caps(df, bounds)), cap=True)
    if simultaneous:
        return OutlierModel(tuple(_fit_bounds(df, chosen, method, factor)), cap=False)
    fitted: list[Bounds] = []
    current = df
    for column in chosen:
        step = OutlierModel(tuple(_fit_bounds(current, [column], method, factor)), cap=False)
        fitted.extend(step.bounds)
        current = step.transform(current)
    return OutlierModel(tuple(fitted), cap=False)


def _fit_bounds(
    df: DataFrame, columns: Sequence[str], method: str, factor: float
) -> list[Bounds]:
    types = data_types(df)
    values = {c: n.cast("double") for c in columns if (n := as_number(c, types[c])) is not None}
    if not values:
        return []
    names = list(values)
    if method == "zscore":
        numbers = df.select(*[values[c].alias(f"v{i}") for i, c in enumerate(names)])
        fits = []
        for i in range(len(names)):
            fits += [F.avg(f"v{i}").alias(f"mean{i}"), F.stddev_samp(f"v{i}").alias(f"std{i}")]
        seen = numbers.agg(*fits).first()
        return [
            Bounds(
                c,
                seen[f"mean{i}"] - Z_THRESHOLD * seen[f"std{i}"],
                seen[f"mean{i}"] + Z_THRESHOLD * seen[f"std{i}"],
                seen[f"mean{i}"],
                seen[f"std{i}"],
            )
            for i, c in enumerate(names)
            # An infinite cell leaves no usable mean or spread; the column is left alone.
            if seen[f"std{i}"] and math.isfinite(seen[f"std{i}"])
        ]
    bounds = []
    for c, (q1, q3) in column_quantiles(df, values, [0.25, 0.75]).items():
        # A column without two values, without any spread or with infinite quartiles is left alone.
        if q1 is None or q3 - q1 == 0 or not math.isfinite(q3 - q1):
            continue
        reach = factor * (q3 - q1)
        bounds.append(Bounds(c, q1 - reach, q3 + reach))
    return bounds


def _needed_caps(df: DataFrame, bounds: Sequence[Bounds]) -> list[Bounds]:
    """Drop the bounds of integer columns whose values all lie inside."""
    types = data_types(df)
    whole = [b for b in bounds if isinstance(types[b.column], T.IntegralType)]
    if not whole:
        return list(bounds)
    found = OutlierModel(tuple(whole), cap=True).report(df).filter("outliers = 0").collect()
    unneeded = {row["column"] for row in found}
    return [b for b in bounds if b.column not in unneeded]


def remove_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "iqr",
    factor: float = DEFAULT_FACTOR,
    cap: bool = False,
    simultaneous: bool = False,
) -> DataFrame:
    """Fit and apply in one call."""
    return fit_outliers(df, columns, method, factor, cap, simultaneous).transform(df)
