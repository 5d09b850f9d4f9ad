"""Most frequent value, the smallest one on a tie."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lustra.functions.text import quoted


def column_modes(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, Any]:
    """Mode of several expressions of one type; None for a column without values.

    Values are counted per column with map-side combine and the winner is taken from the
    counts, so no task holds all values of a column, as the built-in ``mode`` would.
    """
    if not columns:
        return {}
    names = list(columns)
    long_form = df.select(*[columns[n].alias(n) for n in names]).unpivot(
        [], [quoted(n) for n in names], "name", "value"
    )
    counts = long_form.filter("value is not null").groupBy("name", "value").count()
    winner = F.min_by("value", F.struct(-F.col("count"), F.col("value")))
    found = counts.groupBy("name").agg(winner.alias("mode")).collect()
    modes = {row["name"]: row["mode"] for row in found}
    return {n: modes.get(n) for n in names}
