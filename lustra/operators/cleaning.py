"""Blank handling, empty rows, trimming, text standardisation and numeric cleaning."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions import numbers, text
from lustra.functions.columns import data_types, rejects_negatives
from lustra.functions.text import quoted

MAJORITY = 0.5


def replace_columns(df: DataFrame, replacements: dict[str, Column]) -> DataFrame:
    """One projection that swaps in new expressions and keeps the column order."""
    if not replacements:
        return df
    return df.select(
        *[replacements[c].alias(c) if c in replacements else quoted(c) for c in df.columns]
    )


def known_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that exist; a missing one is skipped with a warning."""
    found = []
    for name in names:
        if name in df.columns:
            found.append(name)
        else:
            warnings.warn(f"column {name!r} not found, skipped", stacklevel=3)
    return found


def trim_columns(df: DataFrame) -> DataFrame:
    """Trim every text column."""
    names, plain = _plain_trim(df)
    return replace_columns(plain, {c: text.finish_trim(quoted(c)) for c in names})


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Trim every text column, blank text to null, NaN to null."""
    names, plain = _plain_trim(df)
    replacements = {
        c: F.nullif(text.finish_trim(quoted(c)), F.lit("")) for c in names
    }
    for field in df.schema:
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            replacements[field.name] = numbers.quiet_nan(quoted(field.name), field.dataType)
    return replace_columns(plain, replacements)


def _plain_trim(df: DataFrame) -> tuple[list[str], DataFrame]:
    """The text columns, and the table with their spaces stripped.

    A projection of its own, so that the result is computed once and not in each place
    that reads it; that also keeps the generated code small enough to be compiled.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return names, replace_columns(df, {c: F.trim(quoted(c)) for c in names})


def drop_empty_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Drop rows that are null in every column; ``ignore`` names bookkeeping columns."""
    subset = [c for c in df.columns if c not in set(ignore)]
    return df.na.drop(how="all", subset=subset) if subset else df


def drop_blank_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Drop rows in which every column is null, NaN or blank text, before these are nulled.

    The same rows as :func:`drop_empty_rows` after :func:`blanks_to_null`. There, the filter
    would be pushed below the projection and repeat all of its expressions; here it reads
    the plain columns and stops at the first one with a value, text last.
    """
    hidden = set(ignore)
    others, texts = [], []
    for field in df.schema:
        if field.name in hidden:
            continue
        column = quoted(field.name)
        if isinstance(field.dataType, T.StringType):
            texts.append(F.coalesce(text.trim_text(column) != "", F.lit(False)))
        else:
            others.append(numbers.quiet_nan(column, field.dataType).isNotNull())
    conditions = others + texts
    return df.filter(reduce(lambda a, b: a | b, conditions)) if conditions else df


def standardize_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim and lower-case the given text columns; other types are left alone."""
    types = data_types(df)
    chosen = [c for c in known_columns(df, columns) if isinstance(types[c], T.StringType)]
    return replace_columns(df, {c: text.standardize(c) for c in chosen})


@dataclass(frozen=True)
class NumericCleaner:
    """Numeric coercion and negative-value nulling for a fixed set of columns."""

    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, {c: after for c, (_, _, after) in self._steps(df).items()})

    def report(self, df: DataFrame) -> DataFrame:
        """One row per column: cells lost to coercion and cells lost for being negative."""
        steps = self._steps(df)
        if not steps:
            empty = "column string, coerced bigint, negatives_nulled bigint"
            return df.sparkSession.createDataFrame([], empty)
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    (F.count(before) - F.count(number)).alias("coerced"),
                    (F.count(number) - F.count(after)).alias("negatives_nulled"),
                )
                for name, (before, number, after) in steps.items()
            ]
        )
        return df.agg(rows.alias("rows")).select(F.inline("rows"))

    def _steps(self, df: DataFrame) -> dict[str, tuple[Column, Column, Column]]:
        types = data_types(df)
        steps = {}
        for name in self.columns:
            number = numbers.as_number(name, types[name]) if name in types else None
            if number is None:
                continue
            after = F.when(number >= 0, number) if rejects_negatives(name) else number
            steps[name] = (quoted(name), number, after)
        return steps


def numeric_detection(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per candidate column: rows, cells that read as numbers, the verdict.

    A column is numeric when strictly more than half of all rows, nulls included, hold a
    number. All candidates are counted in one pass.
    """
    types = data_types(df)
    candidates = {
        name: number
        for name in (df.columns if columns is None else known_columns(df, columns))
        if (number := numbers.as_number(name, types[name])) is not None
    }
    if not candidates:
        empty = "column string, total_rows bigint, numeric_rows bigint, is_numeric boolean"
        return df.sparkSession.createDataFrame([], empty)
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(number).alias(f"n{i}") for i, number in enumerate(candidates.values())],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.col("total_rows"),
                F.col(f"n{i}").alias("numeric_rows"),
                (F.col(f"n{i}") > F.col("total_rows") * MAJORITY).alias("is_numeric"),
            )
            for i, name in enumerate(candidates)
        ]
    )
    return counted.select(F.inline(rows))


def fit_numeric_cleaner(df: DataFrame, columns: Sequence[str] | None = None) -> NumericCleaner:
    """Choose the columns to clean.

    Named columns are taken as they are and need no job. Otherwise only columns on which
    cleaning can have an effect are counted: text, and numbers that must not be negative.
    """
    if columns is not None:
        return NumericCleaner(tuple(known_columns(df, columns)))
    affected = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType)
        or (isinstance(f.dataType, T.NumericType) and rejects_negatives(f.name))
    ]
    if not affected:
        return NumericCleaner(())
    types = data_types(df)
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(numbers.as_number(c, types[c])).alias(f"n{i}") for i, c in enumerate(affected)],
    ).first()
    return NumericCleaner(
        tuple(c for i, c in enumerate(affected) if seen[f"n{i}"] > seen["rows"] * MAJORITY)
    )


def clean_numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fit and apply in one call."""
    return fit_numeric_cleaner(df, columns).transform(df)
