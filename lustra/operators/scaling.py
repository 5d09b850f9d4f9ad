"""Standard and min-max scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types
from lustra.functions.numbers import as_number
from lustra.operators.cleaning import known_columns, replace_columns

METHODS = ("standard", "minmax")
SCALABLE_TYPES = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Scaler:
    """Per column what to subtract and what to divide by; null stays null."""

    parameters: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        types = data_types(df)
        return replace_columns(
            df,
            {
                c: (as_number(c, types[c]).cast("double") - F.lit(center)) / F.lit(spread)
                for c, (center, spread) in self.parameters.items()
                if c in types
            },
        )


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard") -> Scaler:
    """One aggregate over all columns. A constant column has spread 1 and so becomes 0.

    A column with an infinite value raises, as no spread would keep its finite values apart.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    types = data_types(df)
    chosen = [c for c in known_columns(df, columns) if isinstance(types[c], SCALABLE_TYPES)]
    if not chosen:
        return Scaler({})
    values = df.select(
        *[as_number(c, types[c]).cast("double").alias(f"v{i}") for i, c in enumerate(chosen)]
    )
    fits = []
    for i in range(len(chosen)):
        fits += [F.min(f"v{i}").alias(f"min{i}"), F.max(f"v{i}").alias(f"max{i}")]
        if method == "standard":
            fits += [F.avg(f"v{i}").alias(f"mean{i}"), F.stddev_pop(f"v{i}").alias(f"std{i}")]
    seen = values.agg(*fits).first()
    parameters = {}
    for i, c in enumerate(chosen):
        low, high = seen[f"min{i}"], seen[f"max{i}"]
        if low is not None and (math.isinf(low) or math.isinf(high)):
            raise ValueError(f"column {c!r} holds infinite values and can't be scaled")
        if low is None:
            parameters[c] = (0.0, 1.0)
        elif low == high:
            parameters[c] = (low, 1.0)
        elif method == "standard":
            parameters[c] = (seen[f"mean{i}"], seen[f"std{i}"] or 1.0)
        else:
            parameters[c] = (low, high - low)
    return Scaler(parameters)


def normalize(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Fit and apply in one call."""
    return fit_scaler(df, columns, method).transform(df)
