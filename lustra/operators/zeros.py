"""Zeros that stand for missing values: flag, drop, blank out or replace them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import data_types
from lustra.functions.numbers import as_number
from lustra.functions.text import quoted
from lustra.operators.cleaning import known_columns, replace_columns
from lustra.operators.lookup import GROUP_ROWS, Lookup, build_lookup
from lustra.operators.modes import column_modes
from lustra.operators.quantiles import column_quantiles
from lustra.session import materialize

FLAG_PREFIX = "is_valid_"


@dataclass(frozen=True)
class ZeroRepair:
    """What to do with the zeros of one column.

    ``action`` is drop, replace or keep; replace puts in the group mean where there is one
    and ``value`` otherwise, null included.
    """

    column: str
    action: str
    value: float | None = None
    group_means: Lookup | None = None
    flag: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns:
            return df
        number = as_number(self.column, data_types(df)[self.column])
        is_zero = F.coalesce(number == 0, F.lit(False))
        if self.flag:
            df = df.withColumn(FLAG_PREFIX + self.column, ~is_zero)
        if self.action == "drop":
            return df.filter(~is_zero)
        if self.action == "keep":
            return df
        number = number.cast("double")
        substitute: Column = F.lit(self.value).cast("double")
        if self.group_means is None:
            return replace_columns(
                df, {self.column: F.when(is_zero, substitute).otherwise(number)}
            )
        (mean,) = self.group_means.value_columns
        attached = self.group_means.attach(df)
        repaired = F.when(is_zero, F.coalesce(quoted(mean), substitute)).otherwise(number)
        return replace_columns(attached, {self.column: repaired}).drop(mean)


@dataclass(frozen=True)
class ZeroRepairs:
    """Repairs in the order of the rules; a row dropped by one is gone for the next."""

    repairs: list[ZeroRepair] = field(default_factory=list)

    @property
    def shuffles(self) -> bool:
        """Whether the transform joins a group table too large to broadcast."""
        return any(r.group_means and not r.group_means.broadcastable for r in self.repairs)

    @property
    def drops(self) -> bool:
        """Whether the transform drops rows."""
        return any(r.action == "drop" for r in self.repairs)

    def transform(self, df: DataFrame) -> DataFrame:
        for repair in self.repairs:
            df = repair.transform(df)
        return df


def fit_invalid_zeros(
    df: DataFrame, rules: Mapping[str, Mapping[str, Any]], flag_invalid: bool = False
) -> ZeroRepairs:
    """Fit the substitutes rule by rule.

    Strategies: ``drop``, ``neighborhood_mean`` (with ``group_by``), ``median``, ``mode``;
    any other name blanks the zero out. Statistics leave zeros out and are taken on the
    rows the earlier rules left over.
    """
    repairs: list[ZeroRepair] = []
    current = df
    for column in known_columns(df, rules):
        repair = _fit_rule(current, column, rules[column], flag_invalid)
        if repair is not None:
            repairs.append(repair)
            current = repair.transform(current)
    return ZeroRepairs(repairs)


def _fit_rule(
    df: DataFrame, column: str, rule: Mapping[str, Any], flag: bool
) -> ZeroRepair | None:
    number = as_number(column, data_types(df)[column])
    if number is None:
        return None
    strategy = rule.get("strategy", "drop")
    group_by = rule.get("group_by")
    non_zero = F.when(number != 0, number.cast("double"))

    if strategy == "drop":
        return ZeroRepair(column, "drop", flag=flag)
    if strategy == "median":
        (median,) = column_quantiles(df, {column: non_zero}, [0.5])[column]
        return ZeroRepair(column, "replace", median, flag=flag)
    if strategy == "mode":
        mode = column_modes(df, {column: non_zero})[column]
        return ZeroRepair(column, "replace", mode, flag=flag)
    if strategy == "neighborhood_mean" and group_by:
        if group_by in df.columns:
            overall, lookup = _group_means(df, column, non_zero, group_by)
            return ZeroRepair(column, "replace", overall, lookup, flag)
        overall = df.agg(F.avg(non_zero)).first()[0]
        action = "keep" if overall is None else "replace"
        return ZeroRepair(column, action, overall, flag=flag)
    return ZeroRepair(column, "replace", None, flag=flag)


def _group_means(
    df: DataFrame, column: str, non_zero: Column, group_by: str
) -> tuple[float | None, Lookup]:
    """Overall mean and group means from one pass; rows without a group count for the former."""
    groups = materialize(
        df.groupBy(quoted(group_by)).agg(
            F.avg(non_zero).alias(f"_mean_of_{column}"),
            F.sum(non_zero).alias("_sum"),
            F.count(non_zero).alias("_values"),
            F.count(F.lit(1)).alias(GROUP_ROWS),
        ),
        "zero-means",
    )
    overall = groups.agg(F.try_divide(F.sum("_sum"), F.sum("_values"))).first()[0]
    means = groups.filter(quoted(group_by).isNotNull()).drop("_sum", "_values")
    return overall, build_lookup(means, group_by, written=True)


def handle_invalid_zeros(
    df: DataFrame, rules: Mapping[str, Mapping[str, Any]], flag_invalid: bool = False
) -> DataFrame:
    """Fit and apply in one call."""
    return fit_invalid_zeros(df, rules, flag_invalid).transform(df)
