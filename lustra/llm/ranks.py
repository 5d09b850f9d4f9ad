"""Places of rows in a total order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lustra.session import materialize

#: ``monotonically_increasing_id`` keeps the partition above this bit and the row below it.
PART_SHIFT = 33


def dense(placed: DataFrame, at: str) -> DataFrame:
    """A written table whose column ``at`` was made by ``monotonically_increasing_id``, with gapless numbers there.

    A row's number is its place in its part plus the sizes of the parts before; there is one
    row for each part that was written, whatever the number of rows.
    """
    part = F.shiftright(at, PART_SHIFT)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    place = F.col(at).bitwiseAND(F.lit((1 << PART_SHIFT) - 1))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(at, F.col("__start") + place)
        .drop("__part", "__start")
    )


def ranked(df: DataFrame, order: list[str], at: str, label: str) -> DataFrame:
    """``df``, written once in the given order, with the place of each row as the column ``at``.

    The sort deals the rows out by ranges, so one key may hold any share of them as long as
    the later columns of the order differ. Rows equal in all of them lie side by side.
    """
    return dense(materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), label), at)
