"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types, id_columns, is_fixed_width
from lustra.functions.text import quoted
from lustra.operators.cleaning import known_columns, trim_columns

KEEP_CHOICES = ("first", "last", False)


def duplicate_key(
    df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> list[str]:
    """The columns that make two rows duplicates.

    None means every column but identifiers and the order columns; an empty list, or a
    table of identifiers only, means every column. Map columns cannot be compared and
    never take part.
    """
    types = data_types(df)
    comparable = [
        c for c in df.columns if not isinstance(types[c], T.MapType) and c not in set(order_by)
    ]
    if subset:
        known = known_columns(df, subset)
        if not known:
            raise ValueError(f"none of the key columns {list(subset)} exists")
        return known
    if subset is None:
        ids = set(id_columns(comparable))
        return [c for c in comparable if c not in ids] or comparable
    return comparable


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: str | Sequence[str] | None = None,
    trimmed: bool = False,
) -> DataFrame:
    """Keep one row per key, or with ``keep=False`` only the rows that have no double.

    Text is trimmed first and stays trimmed; null equals null. ``order_by`` names the
    unique row order that first and last refer to, null being its smallest value; it may be
    left out when the whole row is the key. ``trimmed`` says that the text is trimmed already.

    Every form collapses a key on the map side before the shuffle, so a key that holds a
    third of all rows arrives as one row per map task.
    """
    if keep not in KEEP_CHOICES:
        raise ValueError(f"keep must be one of {KEEP_CHOICES}, not {keep!r}")
    order = [order_by] if isinstance(order_by, str) else list(order_by or ())
    table = df if trimmed else trim_columns(df)
    keys = duplicate_key(table, subset, order)
    rest = [c for c in df.columns if c not in set(keys)]

    if keep is False:
        return _without_doubles(table, keys, rest)
    if not rest:
        return table.dropDuplicates(keys)
    if not order:
        raise ValueError("first and last need order_by when the key is not the whole row")
    types = data_types(table)
    if len(order) == 1 and all(is_fixed_width(types[c]) for c in rest):
        return _pick_by_aggregate(table, keys, rest, order[0], keep)
    return _pick_by_rank(table, keys, order, keep)


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _pick_by_aggregate(
    df: DataFrame, keys: list[str], rest: list[str], order: str, keep: str
) -> DataFrame:
    """Fixed-width leftovers fit a hash aggregate: no sort, one row per key is shuffled.

    As in the rank, rows without an order value come before all others.
    """
    at = _sql_name(order)
    placed = F.count(quoted(order))
    unplaced_wins = placed < F.count(F.lit(1)) if keep == "first" else placed == 0
    pick = F.min_by if keep == "first" else F.max_by

    def chosen_value(c: str) -> Column:
        without_place = F.expr(f"first({_sql_name(c)}) FILTER (WHERE {at} IS NULL)")
        return F.when(unplaced_wins, without_place).otherwise(pick(quoted(c), quoted(order)))

    chosen = df.groupBy(*[quoted(k) for k in keys]).agg(*[chosen_value(c).alias(c) for c in rest])
    return chosen.select(*[quoted(c) for c in df.columns])


def _pick_by_rank(df: DataFrame, keys: list[str], order: list[str], keep: str) -> DataFrame:
    """Rank-one filter; Spark prunes each map partition to one row per key before the shuffle."""
    direction = F.asc if keep == "first" else F.desc
    ranked = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(
        *[direction(_sql_name(o)) for o in order]
    )
    return (
        df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")
    )


def _without_doubles(df: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """A count per key decides; with count one, any value of the other columns is the row's."""
    counted = df.groupBy(*[quoted(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.first(quoted(c)).alias(c) for c in rest]
    )
    return counted.filter("_copies = 1").select(*[quoted(c) for c in df.columns])
