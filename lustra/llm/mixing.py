"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target from its weight; a target stops at a multiple of the source's size
and the excess goes to the others by weight. A source is taken in complete epochs first. The
rest of its budget is a weighted sample without replacement: each document draws the
exponential key ``-ln(u) / quality weight``, documents are ordered by key within their source,
and those whose prefix sum of sizes fits the budget are taken; the document at the border is
taken if that brings the sum closer. ``u`` is a hash of the id, so reruns agree.

The prefix sums need no sort of a whole source: keys fall into numbered bins, sums per source
and bin tell the bin in which the budget ends, and only that bin's documents are put in order.
The number of bins follows the number of rows, so a bin stays small in a hot source too.

Null and empty texts have size 0 and are taken 0 times. Null ids draw a key like others.
Repeated rows are rows of their own; rows with one id share their key and are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lustra.llm.quality import words_of
from lustra.session import materialize

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words to take, in shares of all words.
SHARE = 1.5
#: Largest target of a source, in multiples of its size.
MOST = 2.0
#: Rows that share a bin of a source, about.
ROWS_PER_BIN = 50_000
SEED = "mix"
#: A hash digit string of 13 hexadecimal digits has this many values.
_STEPS = float(1 << 52)
#: Sources whose plan may be broadcast; with more, the plan is joined by shuffle.
BROADCAST_SOURCES = 20_000
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` for each source.

    Sources fill up in the order of limit over weight: a source whose limit is below its share
    of what is left keeps the limit, the others share the rest by weight. This is what
    sharing the excess again and again comes to. Works on one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*(F.lit(float(w)) for w in weights))
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(listed, F.col("place") % len(weights))
    )
    by_room = Window.orderBy(F.col("room"), F.col("place"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        placed.withColumn("limit", most * F.col("source_size"))
        .withColumn("room", F.col("limit") / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("all", F.sum("source_size").over(by_room.rowsBetween(*WHOLE)))
        .withColumn("level", (share * F.col("all") - F.col("filled")) / F.col("weight_left"))
    )
    # The first source, by room, that its share does not fill sets the level of all after it.
    first = F.min(F.when(F.col("room") > F.col("level"), F.struct("room", "place", "level"))).over(
        by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return filled.select(
        "source", "source_size", F.coalesce(F.col("weight") * first["level"], F.col("limit")).alias("target")
    )


def sample_key(id_col: Column, quality: Column, seed: str = SEED) -> Column:
    """Exponential key of a document: small keys are taken first, good documents draw smaller ones."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / _STEPS
    return -F.ln(u) / quality


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """``row`` (a struct of all given columns), its source's numbers, and how often it is taken.

    ``quality`` has ``id_col`` and a positive ``weight`` per document (1 where missing). The
    result has ``source, size, source_size, target, epochs, picked, times``; ``times`` is
    ``epochs`` plus 1 for a picked document, 0 for one without words.
    """
    sized = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
    )
    if quality is None:
        weighted = sized.withColumn("w", F.lit(1.0))
    else:
        known = quality.groupBy(F.col(id_col).alias("id")).agg(F.max("weight").cast("double").alias("w"))
        weighted = sized.join(known, "id", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    keyed = weighted.withColumn("key", sample_key(F.col("id"), F.col("w")))
    slim = materialize(keyed.select("id", "source", "size", "crc", "key"), "mix-keys")

    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plans = source_targets(sizes, weights, share, most).withColumn("epochs", epochs.cast("int"))
    plans = plans.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plans = materialize(plans, "mix-plans")
    n_bins = max(64, slim.count() // rows_per_bin)
    limits = materialize(_borders(slim, plans, n_bins), "mix-borders")

    if limits.count() <= BROADCAST_SOURCES:
        limits = F.broadcast(limits)
    order = F.struct("key", "id", "crc")
    place = _bin(n_bins)
    return (
        keyed.withColumnRenamed("source", "own_source")
        .join(limits, F.col("own_source").eqNullSafe(F.col("source")))
        .withColumn(
            "picked",
            (F.col("size") > 0)
            & F.coalesce(
                (place < F.col("cut_bin")) | ((place == F.col("cut_bin")) & (order <= F.col("last"))),
                place < F.col("cut_bin"),
                F.lit(False),
            ),
        )
        .withColumn("times", F.when(F.col("size") > 0, F.col("epochs") + F.col("picked").cast("int")).otherwise(0))
        .select("row", "source", "size", "source_size", "target", "epochs", "picked", "times")
    )


def _bin(n_bins: int) -> Column:
    """Number of the bin of a key: a share of 0 to 1 that grows with the key, cut evenly."""
    return F.floor((1 - F.exp(-F.col("key"))) * n_bins).cast("long")


def _borders(slim: DataFrame, plans: DataFrame, n_bins: int) -> DataFrame:
    """The plans with the bin in which each budget ends, and the last document taken in it."""
    # Repeated rows have one key and are taken or left together.
    binned = slim.withColumn("bin", _bin(n_bins)).groupBy("source", "bin", "key", "id", "crc").agg(F.sum("size").alias("size"))
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    budgets = plans.select(F.col("source").alias("s"), "rest")
    cuts = (
        bins.join(budgets, F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("below") < F.col("rest")) & (F.col("rest") <= F.col("below") + F.col("bin_size")))
        .select("s", F.col("bin").alias("cut_bin"), "below", "rest")
    )
    inside = binned.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut_bin")))
    upto = Window.partitionBy("s").orderBy("key", "id", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = inside.withColumn("upto", F.col("below") + F.sum("size").over(upto))
    over, under = F.col("upto") - F.col("rest"), F.col("rest") - F.col("upto") + F.col("size")
    last = (
        summed.filter((F.col("size") > 0) & ((over <= 0) | (over < under)))
        .groupBy("s")
        .agg(F.max(F.struct("key", "id", "crc")).alias("last"))
        .withColumnRenamed("s", "s2")
    )
    cuts = cuts.select("s", "cut_bin").join(last, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    return plans.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for good documents, 0.5 for bad ones, 1 if unlabelled."""
    good = F.min("quality") == 1
    return labels.groupBy("doc_id").agg(F.when(good, 2.0).otherwise(0.5).alias("weight"))
