"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in parts. How many rows of each part go to each shard is drawn first, from the
multivariate hypergeometric law that a uniform permutation of all rows would give, so that the
columns add up to the exact shard sizes. Each part permutes its rows and deals them out by its
line of the matrix; each shard permutes what it gets. Shard sizes differ by one row at most.

Permutations follow hashes of the row, so reruns agree. A shard is permuted in cells: the cell
of a row and its place in the cell are drawn by hash, and the slots count on over the cells,
so no task holds a whole shard. Rows are dealt to parts by a hash of id and text: a part has
about ``rows_per_part`` rows, plus the copies of rows that agree in both.

Null ids and texts are values like others. Copies of a text are placed independently of each
other, as a uniform shuffle does. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
ROWS_PER_PART = 20_000
SEED = 11


def matrix(parts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows that each part sends to each shard: parts down, shards across."""
    total = sum(parts)
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    draw = np.random.default_rng(seed)
    lines = np.zeros((len(parts), shards), np.int64)
    for i, n in enumerate(parts):
        lines[i] = draw.multivariate_hypergeometric(left, n, method="marginals")
        left -= lines[i]
    return lines


def _row_hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shuffle_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """``row`` (a struct of all given columns), ``shard`` and ``slot``, one row for each row.

    The matrix has one line per part and is drawn on the driver from the counts of the parts;
    it goes back as a table of ``parts x shards`` small numbers.
    """
    spark = docs.sparkSession
    total = docs.count()
    n_parts = max(1, -(-total // rows_per_part))
    key = _row_hash(seed, F.col(id_col), F.col(text_col))
    # Copies of a row have one hash; the second hash takes a number that sets them apart.
    dealt = docs.select(F.struct("*").alias("row"), key.alias("key")).withColumn(
        "part", F.pmod(F.col("key"), F.lit(n_parts)).cast("int")
    )
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    lines = matrix([sizes.get(p, 0) for p in range(n_parts)], shards, seed)
    ends = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(line)]) for p, line in enumerate(lines)], "part int, ends array<bigint>"
    )
    in_part = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), F.col("key")), "key")
    placed = dealt.withColumn("place", F.row_number().over(in_part)).join(ends, "part")
    shard = F.size(F.filter("ends", lambda e: e < F.col("place")))
    # Copies differ by their place in the part.
    again = F.xxhash64(F.lit(seed + 2), F.col("key"), F.col("place"))
    n_cells = max(1, -(-total // shards // rows_per_part))
    exchanged = placed.select(
        "row", shard.cast("int").alias("shard"), again.alias("again"), F.pmod(F.shiftright(again, 20), F.lit(n_cells)).cast("int").alias("cell")
    )
    if n_cells == 1:
        by_shard = Window.partitionBy("shard").orderBy("again")
        return exchanged.select("row", "shard", (F.row_number().over(by_shard) - 1).cast("long").alias("slot"))
    in_cell = Window.partitionBy("shard", "cell").orderBy("again")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = exchanged.groupBy("shard", "cell").count().select(
        "shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    return (
        exchanged.withColumn("n", F.row_number().over(in_cell))
        .join(offsets, ["shard", "cell"])
        .select("row", "shard", (F.col("offset") + F.col("n") - 1).alias("slot"))
    )
