"""Left join of a one-row-per-key table back onto the rows it was computed from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.text import quoted
from lustra.session import materialize

# Largest side that is broadcast, measured on the written table.
BROADCAST_BYTES = 64 * 1024 * 1024
# A group is hot when it holds at least this share of all rows; there are at most 1/share.
HOT_SHARE = 0.001
GROUP_ROWS = "_group_rows"
ROW_OVERHEAD_BYTES = 64
FIXED_VALUE_BYTES = 16


@dataclass(frozen=True)
class Lookup:
    """A measured table with the unique, non-null column ``key`` and some value columns."""

    table: DataFrame
    key: str
    total_rows: int
    broadcastable: bool
    hot_groups: int

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.table.columns if c not in (self.key, GROUP_ROWS)]

    def attach(self, df: DataFrame) -> DataFrame:
        """Left join on the key; a null or unknown key gets nulls. Starts no job.

        A table beyond the broadcast bound is joined by shuffle for ordinary keys only.
        Rows of hot keys, a list of bounded length, meet a broadcast of just these keys,
        and rows without a key need no join, so neither gathers in one task.
        """
        values = self.table.drop(GROUP_ROWS)
        if self.broadcastable:
            return df.join(F.broadcast(values), self.key, "left").select(
                *[quoted(c) for c in df.columns], *[quoted(c) for c in self.value_columns]
            )
        present = df.filter(quoted(self.key).isNotNull())
        absent = df.filter(quoted(self.key).isNull())
        types = {f.name: f.dataType for f in self.table.schema}
        absent = absent.select(
            *[quoted(c) for c in df.columns],
            *[F.lit(None).cast(types[c]).alias(c) for c in self.value_columns],
        )
        if self.hot_groups == 0:
            return present.join(values, self.key, "left").select(*absent.columns).union(absent)
        is_hot = F.col(GROUP_ROWS) >= self.total_rows * HOT_SHARE
        hot = self.table.filter(is_hot).drop(GROUP_ROWS)
        ordinary = self.table.filter(~is_hot).drop(GROUP_ROWS)
        hot_rows = present.join(F.broadcast(hot), self.key, "inner")
        other_rows = present.join(F.broadcast(hot.select(quoted(self.key))), self.key, "left_anti")
        return (
            other_rows.join(ordinary, self.key, "left")
            .select(*absent.columns)
            .union(hot_rows.select(*absent.columns))
            .union(absent)
        )


def row_bytes(table: DataFrame) -> Column:
    """Upper estimate of what a row of the table takes in a broadcast."""
    size = F.lit(ROW_OVERHEAD_BYTES + FIXED_VALUE_BYTES * len(table.columns))
    for field in table.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(quoted(field.name)), F.lit(0))
    return size


def build_lookup(
    table: DataFrame,
    key: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    label: str = "lookup",
    written: bool = False,
) -> Lookup:
    """Write ``table`` once, unless it is ``written`` already, measure it, decide how to join it.

    ``table`` has one row per non-null key and the column ``_group_rows`` with the number
    of rows behind each key.
    """
    if not written:
        table = materialize(table, label)
    measured = table.agg(
        F.coalesce(F.sum(row_bytes(table)), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(GROUP_ROWS), F.lit(0)).alias("rows"),
    ).first()
    broadcastable = measured["bytes"] <= broadcast_bytes
    hot_groups = 0
    if not broadcastable:
        hot_groups = table.filter(F.col(GROUP_ROWS) >= measured["rows"] * HOT_SHARE).count()
    return Lookup(table, key, measured["rows"], broadcastable, hot_groups)
