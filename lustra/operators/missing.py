"""Missing values: drop rows, or fill with a constant, a median or a mode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types
from lustra.functions.numbers import as_number
from lustra.functions.text import quoted
from lustra.operators.cleaning import MAJORITY, known_columns, replace_columns
from lustra.operators.modes import column_modes
from lustra.operators.ordered_fill import fit_ordered_fill
from lustra.operators.quantiles import column_quantiles

STRATEGIES = ("drop", "fill", "forward_fill", "backward_fill")
# What a column without any value is filled with.
EMPTY_NUMBER = 0.0
EMPTY_TEXT = "Unknown"


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    chosen = known_columns(df, columns) if columns else df.columns
    return df.na.drop(how="any", subset=chosen) if chosen else df


@dataclass(frozen=True)
class FillModel:
    """One fill value per column; ``numbers`` lists the columns read as numbers first."""

    values: Mapping[str, Any] = field(default_factory=dict)
    numbers: frozenset[str] = frozenset()
    missing_counts: Mapping[str, int] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        types = data_types(df)
        replacements = {}
        for name in types:
            column = quoted(name)
            if name in self.numbers:
                column = as_number(name, types[name])
                value = self.values.get(name)
                if value is not None and not _keeps_type(types[name], value):
                    column = column.cast("double")
            elif name not in self.values:
                continue
            if name in self.values:
                column = F.coalesce(column, F.lit(self.values[name]))
            replacements[name] = column
        return replace_columns(df, replacements)


def _keeps_type(data_type: T.DataType, value: float) -> bool:
    """A whole number fits into an integer column; everything else needs double."""
    return isinstance(data_type, T.IntegralType) and isinstance(value, int)


def fit_fill(
    df: DataFrame, columns: Sequence[str] | None = None, fill_value: Any = None
) -> FillModel:
    """Fit the fill values.

    Numbers take a numeric ``fill_value`` or else their median, text takes a text
    ``fill_value`` or else its mode. Text counts as numeric when more than half of all rows
    hold a number. Booleans are filled with their mode, dates and timestamps stay as they
    are. Only columns with missing cells are fitted and changed.
    """
    types = data_types(df)
    chosen = known_columns(df, columns) if columns else df.columns
    numeric_fill = isinstance(fill_value, (int, float))
    text_fill = isinstance(fill_value, str)
    candidates = {c: n for c in chosen if (n := as_number(c, types[c])) is not None}
    labels = [c for c in chosen if isinstance(types[c], (T.StringType, T.BooleanType))]

    counts = [F.count(F.lit(1)).alias("rows")]
    for i, number in enumerate(candidates.values()):
        counts.append(F.count(number).alias(f"n{i}"))
        if not numeric_fill:
            counts.append(F.approx_count_distinct(number).alias(f"d{i}"))
    counts += [F.count(quoted(c)).alias(f"t{i}") for i, c in enumerate(labels)]
    if not candidates and not labels:
        return FillModel()
    seen = df.agg(*counts).first()
    rows = seen["rows"]

    numeric, missing, distinct = [], {}, {}
    for i, name in enumerate(candidates):
        is_text = isinstance(types[name], T.StringType)
        if is_text and not seen[f"n{i}"] > rows * MAJORITY:
            continue
        numeric.append(name)
        missing[name] = rows - seen[f"n{i}"]
        if not numeric_fill:
            distinct[name] = seen[f"d{i}"]
    words = [c for c in labels if c not in set(numeric)]
    missing.update({c: rows - seen[f"t{i}"] for i, c in enumerate(labels) if c in set(words)})

    values: dict[str, Any] = {}
    gaps = [c for c in numeric if missing[c]]
    if numeric_fill:
        constant = int(fill_value) if isinstance(fill_value, bool) else fill_value
        values.update({c: constant for c in gaps})
    elif gaps:
        medians = column_quantiles(df, {c: candidates[c] for c in gaps}, [0.5], distinct)
        for name in gaps:
            (median,) = medians[name]
            values[name] = EMPTY_NUMBER if median is None else median

    word_gaps = [c for c in words if missing[c]]
    if text_fill:
        values.update({c: fill_value for c in word_gaps if isinstance(types[c], T.StringType)})
    word_gaps = [c for c in word_gaps if c not in values]
    text_gaps = [c for c in word_gaps if isinstance(types[c], T.StringType)]
    flag_gaps = [c for c in word_gaps if c not in set(text_gaps)]
    for name, mode in column_modes(df, {c: quoted(c) for c in text_gaps}).items():
        values[name] = EMPTY_TEXT if mode is None else mode
    for name, mode in column_modes(df, {c: quoted(c) for c in flag_gaps}).items():
        if mode is not None:
            values[name] = mode

    promoted = [c for c in numeric if c in values or isinstance(types[c], T.StringType)]
    return FillModel(values, frozenset(promoted), missing)


def handle_missing_values(
    df: DataFrame,
    strategy: str = "drop",
    fill_value: Any = None,
    columns: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Fit and apply one strategy. The ordered fills need the row order in ``order_by``."""
    if strategy == "drop":
        return drop_missing(df, columns)
    if strategy == "fill":
        return fit_fill(df, columns, fill_value).transform(df)
    if strategy in ("forward_fill", "backward_fill"):
        direction = strategy.removesuffix("_fill")
        return fit_ordered_fill(df, order_by, columns, direction).transform(df)
    raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
