"""Column selection and group aggregates as features."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types
from lustra.functions.numbers import quiet_nan
from lustra.functions.text import quoted
from lustra.operators.cleaning import known_columns
from lustra.operators.lookup import GROUP_ROWS, Lookup, build_lookup
from lustra.operators.quantiles import group_quantiles

ACTIONS = ("keep", "drop")
MEDIAN_NAMES = ("median", "quantile")
ORDERED_NAMES = ("first", "last")


def select_features(df: DataFrame, columns: Sequence[str], action: str = "keep") -> DataFrame:
    """Keep the given columns in the given order, or drop them."""
    if action == "keep":
        return df.select(*[quoted(c) for c in known_columns(df, columns)])
    if action == "drop":
        return df.drop(*[c for c in columns if c in df.columns])
    raise ValueError(f"action must be one of {ACTIONS}, not {action!r}")


def _skew(c: Column) -> Column:
    """Bias-corrected skewness: null below three values, 0 for a constant group."""
    n = F.count(c)
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.min(c) == F.max(c), 0.0).otherwise(corrected)


# Aggregate name to expression, with the null rules of data-frame aggregation: an all-null
# group sums to 0 and multiplies to 1, everything but the counts is null.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "count": F.count,
    "size": lambda c: F.count(F.lit(1)),
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "any": lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
    "all": lambda c: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
    "skew": _skew,
}
# These take numbers and booleans only.
NUMBER_AGGREGATES = frozenset(
    ("mean", "sum", "prod", "std", "var", "sem", "any", "all", "skew", *MEDIAN_NAMES)
)
# The result has the type of the column.
SAME_TYPE_AGGREGATES = frozenset(("min", "max", *ORDERED_NAMES))
AGGREGATE_NAMES = tuple(AGGREGATES) + MEDIAN_NAMES + ORDERED_NAMES


@dataclass(frozen=True)
class GroupFeatures:
    """Group tables to be joined back, in order."""

    lookups: list[Lookup] = field(default_factory=list)

    @property
    def shuffles(self) -> bool:
        """Whether the transform joins a table too large to broadcast."""
        return any(not lookup.broadcastable for lookup in self.lookups)

    def transform(self, df: DataFrame) -> DataFrame:
        for lookup in self.lookups:
            df = lookup.attach(df)
        return df


def _takes(function: str, data_type: T.DataType) -> bool:
    """Whether an aggregate can be taken of values of a type."""
    if function in NUMBER_AGGREGATES:
        return isinstance(data_type, (T.NumericType, T.BooleanType))
    return function in ("count", "size") or not isinstance(data_type, T.MapType)


def fit_group_features(
    df: DataFrame,
    aggregations: Mapping[str, Mapping[str, Any]],
    order_by: str | Sequence[str] | None = None,
) -> GroupFeatures:
    """Fit features named ``<name>_<function>`` over one group column each.

    Neighbouring features of the same group column share one aggregation and one join. A
    feature may use one that was built before it. An incomplete rule, one on unknown columns,
    or one whose function does not take values of the column's type is skipped with a warning;
    an unknown function is an error.
    """
    batches: list[tuple[str, dict[str, tuple[str, str]]]] = []
    known = data_types(df)
    for name, rule in aggregations.items():
        group, column, function = rule.get("group_by"), rule.get("column"), rule.get("function")
        function = function or "mean"
        if not group or not column or group not in known or column not in known:
            warnings.warn(f"feature {name!r}: incomplete rule or unknown column", stacklevel=2)
            continue
        if function not in AGGREGATE_NAMES:
            raise ValueError(f"feature {name!r}: function must be one of {AGGREGATE_NAMES}")
        if not _takes(function, known[column]):
            found = known[column].simpleString()
            warnings.warn(f"feature {name!r}: no {function} of {found} values", stacklevel=2)
            continue
        feature = f"{name}_{function}"
        if feature in known:
            raise ValueError(f"feature column {feature!r} already exists")
        if not batches or batches[-1][0] != group or column in batches[-1][1]:
            batches.append((group, {}))
        batches[-1][1][feature] = (column, function)
        known[feature] = known[column] if function in SAME_TYPE_AGGREGATES else T.DoubleType()

    lookups: list[Lookup] = []
    current = df
    for group, features in batches:
        used = {group, *(column for column, _ in features.values())}
        source = df if used <= set(df.columns) else current
        lookup = build_lookup(_group_table(source, group, features, order_by), group)
        lookups.append(lookup)
        current = lookup.attach(current)
    return GroupFeatures(lookups)


def _group_table(
    df: DataFrame,
    group: str,
    features: Mapping[str, tuple[str, str]],
    order_by: str | Sequence[str] | None,
) -> DataFrame:
    types = data_types(df)
    values = {c: quiet_nan(quoted(c), types[c]) for c, _ in features.values()}
    for c, value in values.items():
        if isinstance(types[c], T.BooleanType):
            values[c] = value.cast("int")
    exprs, medians = [F.count(F.lit(1)).alias(GROUP_ROWS)], {}
    for feature, (column, function) in features.items():
        if function in MEDIAN_NAMES:
            medians.setdefault(column, []).append(feature)
        elif function in ORDERED_NAMES:
            exprs.append(_ordered_pick(values[column], function, order_by).alias(feature))
        else:
            exprs.append(AGGREGATES[function](values[column]).alias(feature))
    key = quoted(group)
    table = df.filter(key.isNotNull()).groupBy(key.alias(group)).agg(*exprs)
    for column, names in medians.items():
        quantiles = group_quantiles(df, group, values[column], [0.5])
        middle = quantiles.select(
            F.col("key").alias(group), *[F.get("quantiles", F.lit(0)).alias(n) for n in names]
        )
        table = table.join(middle, group, "left")
    return table.select(quoted(group), GROUP_ROWS, *[quoted(f) for f in features])


def _ordered_pick(
    value: Column, function: str, order_by: str | Sequence[str] | None
) -> Column:
    """First or last non-null value in row order."""
    order = [order_by] if isinstance(order_by, str) else list(order_by or ())
    if not order:
        raise ValueError(f"the aggregate {function!r} needs order_by")
    key = quoted(order[0]) if len(order) == 1 else F.struct(*[quoted(o) for o in order])
    pick = F.min_by if function == "first" else F.max_by
    return pick(value, F.when(value.isNotNull(), key))


def aggregate_features(
    df: DataFrame,
    aggregations: Mapping[str, Mapping[str, Any]],
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Fit and apply in one call."""
    return fit_group_features(df, aggregations, order_by).transform(df)
