"""Exact quantiles with linear interpolation, for whole columns and per group.

Columns are stacked into rows of key and value, so a column is a group like any other, only one that
holds all rows. A wanted rank of a key is first enclosed by a *bracket* of two values, then read off
a table of the distinct values inside with their counts:

* **Sketch.** KLL sketches are built by key and shard of the input and merged in two levels, so a key that holds
  a third of the rows, or all of them, is never merged from all tasks at once. Their quantiles on a fine grid tell
  a bracket that holds the rank, and how many distinct values to expect: neighbours on the grid that are equal have one value
  between them. A key of few values keeps its whole range; a bracket that may hold too many is sketched again from the inside.
* **Read.** Values inside a bracket are counted with map-side combine, one row for each value; all
  that lies below is one more row. The running count then gives the values at both neighbours of the
  position. Exact counts show whether the bracket held the ranks. One that missed is tried again with a wider
  margin, and after that as the whole range, so a bad sketch costs passes but never a wrong answer.

The same interpolation is used everywhere, so a result does not depend on the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lustra.functions.text import quoted
from lustra.operators.lookup import BROADCAST_BYTES, row_bytes
from lustra.session import materialize

# Distinct values of a bracket that one task puts in order.
VALUES_PER_TASK = 50_000
# Rows of a group up to which all its values are put in order by one task. Groups beyond that are bracketed, as
# many as MOST_GROUPS at most; in tables where there could be more, the limit rises.
SORTABLE_ROWS = 5_000_000
MOST_GROUPS = 100_000
# Size of the sketches. A rank of a KLL sketch of this size is off by less than ERROR of all rows, but for one in a hundred.
SKETCH_SIZE = 2048
ERROR = 0.0017
# Steps of the grid on which a sketch is asked for its quantiles.
GRID_STEPS = 2_000
# A bracket reaches so many errors to both sides, and after a miss MORE_MARGIN times as far.
MARGIN = 2.5
MORE_MARGIN = 8
MOST_MISSES = 1
# Shards of the first level of merging.
SHARDS = 64
INFINITY = float("inf")
# ``expected`` distinct values, ``rows`` of the whole key, and the quantiles that are wanted from inside.
BRACKETS = (
    "key int, low double, high double, misses int, expected double, rows bigint, "
    "wanted array<struct<part:int,share:double>>"
)

Keep = Callable[[DataFrame, str], DataFrame]


def column_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    distinct_estimates: Mapping[str, int] | None = None,
    values_per_task: int = VALUES_PER_TASK,
    sketch_size: int = SKETCH_SIZE,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several numeric expressions; None for a column without values.

    All columns share each pass over the table. ``distinct_estimates`` spare the sketch when all columns have few values.
    """
    if not columns:
        return {}
    names = [f"v{i}" for i in range(len(columns))]
    values = df.select(*[c.cast("double").alias(n) for n, c in zip(names, columns.values(), strict=True)])
    entries = ", ".join(f"struct({i} as key, {n} as value)" for i, n in enumerate(names))
    rows = values.selectExpr(f"inline(array({entries}))")
    spark = df.sparkSession

    def keep(table: DataFrame, label: str) -> DataFrame:
        """A row or two for each column: a local table, on which Spark starts no jobs."""
        return spark.createDataFrame(table.collect(), table.schema)

    first = None
    if distinct_estimates is not None and all(distinct_estimates[c] <= values_per_task for c in columns):
        wanted = [(i, float(p)) for i, p in enumerate(probabilities)]
        first = spark.createDataFrame([(i, -INFINITY, INFINITY, 0, 0.0, None, wanted) for i in range(len(columns))], BRACKETS)
    found = _selected(rows.filter("value is not null"), probabilities, values_per_task, sketch_size, keep, first)
    by_key: dict[int, dict[int, float]] = {}
    for row in found.collect():
        by_key.setdefault(row["key"], {})[row["part"]] = row["quantile"]
    parts = range(len(probabilities))
    return {c: [by_key.get(i, {}).get(p) for p in parts] for i, c in enumerate(columns)}


def group_quantiles(
    df: DataFrame,
    group: str,
    value: Column,
    probabilities: Sequence[float],
    sortable_rows: int = SORTABLE_ROWS,
) -> DataFrame:
    """One row per non-null group that has values: ``key`` and the array ``quantiles``.

    Groups up to ``sortable_rows`` are read off their running counts, which spill. The few that are larger are
    bracketed; only if there are any, the rows are told apart by a join with the list of these.
    """
    rows = df.select(quoted(group).alias("key"), value.cast("double").alias("value"))
    rows = rows.filter("key is not null and value is not null")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    seen = sizes.agg(F.max("size").alias("largest"), F.sum("size").alias("rows")).first()
    limit = max(sortable_rows, (seen["rows"] or 0) // MOST_GROUPS)
    if (seen["largest"] or 0) <= limit:
        return _as_arrays(_read_all(rows, probabilities))
    big = _side(materialize(sizes.filter(F.col("size") > limit).select("key"), "big-groups"))
    return _as_arrays(_read_all(rows.join(big, "key", "left_anti"), probabilities)).unionByName(
        select_quantiles(rows.join(big, "key", "left_semi"), probabilities)
    )


def select_quantiles(
    rows: DataFrame,
    probabilities: Sequence[float],
    values_per_task: int = VALUES_PER_TASK,
    sketch_size: int = SKETCH_SIZE,
) -> DataFrame:
    """Quantiles of ``value`` per ``key`` by bracketing, the brackets kept as a table."""
    present = rows.filter("key is not null and value is not null")
    return _as_arrays(_selected(present, probabilities, values_per_task, sketch_size, materialize))


def _as_arrays(parts: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("part", "quantile")))
    return parts.groupBy("key").agg(F.transform(ordered, lambda entry: entry["quantile"]).alias("quantiles"))


def _side(table: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast if it is measured to be small."""
    size = table.agg(F.sum(row_bytes(table)).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _selected(
    present: DataFrame,
    probabilities: Sequence[float],
    values_per_task: int,
    sketch_size: int,
    keep: Keep,
    brackets: DataFrame | None = None,
) -> DataFrame:
    """``key, part, quantile``. ``keep`` fixes the small tables between the passes."""
    found: list[DataFrame] = []
    side = _side if keep is materialize else F.broadcast
    ready: list[DataFrame] = []
    if brackets is None:
        brackets = keep(_narrowed(_sketched(present, probabilities, sketch_size), values_per_task, sketch_size), "quantile-brackets")
    while True:
        # A bracket that missed so often is the whole range and is read whatever it holds.
        is_ready = (F.col("expected") <= values_per_task) | (F.col("misses") > MOST_MISSES)
        ready.append(brackets.filter(is_ready))
        wide = brackets.filter(~is_ready)
        if not wide.isEmpty():
            resketched = _sketched_inside(present, side(wide), sketch_size)
            brackets = keep(_narrowed(resketched, values_per_task, sketch_size), "quantile-brackets")
            continue
        parts = keep(_read(present, side(reduce(DataFrame.unionByName, ready))), "quantile-parts")
        found.append(parts.filter("confirmed").select("key", "part", "quantile"))
        missed = parts.filter("not confirmed")
        if missed.isEmpty():
            return reduce(DataFrame.unionByName, found)
        ready, brackets = [], keep(_reopened(missed), "quantile-brackets")


def _merged(rows: DataFrame, keys: Sequence[str], sketch_size: int) -> DataFrame:
    """Count and sketch of ``inside`` and the count of ``is_below`` by ``keys``: by shard first, then of all shards."""
    shard = F.pmod(F.spark_partition_id(), F.lit(SHARDS))
    by_shard = (
        rows.withColumn("shard", shard)
        .groupBy(*keys, "shard")
        .agg(
            F.count_if("is_below").alias("below"),
            F.count("inside").alias("inside"),
            F.kll_sketch_agg_double("inside", sketch_size).alias("sketch"),
        )
    )
    merged = by_shard.groupBy(*keys).agg(
        F.sum("below").alias("below"), F.sum("inside").alias("inside"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    # A sketch takes constant ranks only. As text, to keep the plan small.
    ranks = F.split(F.lit(",".join(repr(i / GRID_STEPS) for i in range(GRID_STEPS + 1))), ",").cast("array<double>")
    return merged.withColumn("grid", F.when(F.col("inside") > 0, F.kll_sketch_get_quantile_double("sketch", ranks))).drop("sketch")


def _sketched(present: DataFrame, probabilities: Sequence[float], sketch_size: int) -> DataFrame:
    """The whole range of each key, as a bracket that was measured."""
    rows = present.select("key", F.lit(False).alias("is_below"), F.col("value").alias("inside"))
    wanted = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(float(p)).alias("share")) for i, p in enumerate(probabilities)])
    return _merged(rows, ["key"], sketch_size).select(
        "*",
        F.lit(-INFINITY).alias("low"),
        F.lit(INFINITY).alias("high"),
        F.lit(0).alias("misses"),
        F.col("inside").alias("rows"),
        wanted.alias("wanted"),
    )


def _sketched_inside(present: DataFrame, brackets: DataFrame, sketch_size: int) -> DataFrame:
    """The brackets, measured again from the values inside."""
    keys = ["key", "low", "high", "misses"]
    inside = F.col("value") >= F.col("low")
    rows = (
        present.join(brackets.select(*keys), "key")
        .filter(F.col("value") <= F.col("high"))
        .select(*keys, (~inside).alias("is_below"), F.when(inside, F.col("value")).alias("inside"))
    )
    return _merged(rows, keys, sketch_size).join(brackets.drop("expected"), keys)


def _narrowed(measured: DataFrame, values_per_task: int, sketch_size: int) -> DataFrame:
    """The next brackets of the measured ones.

    A bracket that turns out not to hold its ranks becomes the whole range, with one more miss. One that cannot
    be made smaller holds heavy values and is read as it is. Written as SQL text, which is planned faster than columns.
    """
    error = f"{ERROR * MARGIN * SKETCH_SIZE / sketch_size!r}D * pow({MORE_MARGIN}, misses)"
    # Distinct values to expect between two points of the grid. A bracket that missed can be empty.
    values = f"1 + (size(array_distinct(slice(grid, {{0}} + 1, {{1}} - {{0}} + 1))) - 1) * inside / {GRID_STEPS}"
    at = "(w.share * (rows - 1) - below + 0.5) / nullif(inside, 0)"
    placed = f"""transform(wanted, w -> named_struct(
        'want', w,
        'holds', below <= floor(w.share * (rows - 1)) and ceil(w.share * (rows - 1)) < below + inside,
        'first', int(least(greatest(floor(({at} - error - 1 / nullif(inside, 0)) * {GRID_STEPS}), 0), {GRID_STEPS})),
        'last', int(least(greatest(ceil(({at} + error + 1 / nullif(inside, 0)) * {GRID_STEPS}), 0), {GRID_STEPS}))))"""
    bounded = f"""transform(placed, p -> named_struct(
        'place', p,
        'low', case when p.first > 0 then grid[p.first] else low end,
        'high', case when p.last < {GRID_STEPS} then grid[p.last] else high end))"""

    def bracket(low: str, high: str, misses: str, expected: str, wanted: str) -> str:
        return (
            f"named_struct('low', {low}, 'high', {high}, 'misses', {misses}, "
            f"'expected', double({expected}), 'rows', rows, 'wanted', {wanted})"
        )

    stuck = f"case when b.low = low and b.high = high then 1 else {values.format('b.place.first', 'b.place.last')} end"
    inner = bracket("b.low", "b.high", "misses", stuck, "array(b.place.want)")
    missed = bracket("double('-inf')", "double('inf')", "misses + 1", "double('inf')", "array(b.place.want)")
    single = f"transform(bounded, b -> case when b.place.holds then {inner} else {missed} end)"
    unchanged = f"array({bracket('low', 'high', 'misses', 'values', 'wanted')})"
    return (
        measured.selectExpr("*", f"{error} as error", f"{values.format(0, GRID_STEPS)} as values")
        .selectExpr("*", f"{placed} as placed")
        .selectExpr("*", f"{bounded} as bounded")
        .selectExpr(
            "key",
            f"inline(case when values <= {values_per_task} and forall(placed, p -> p.holds) then {unchanged} else {single} end)",
        )
    )


def _reopened(missed: DataFrame) -> DataFrame:
    """Brackets of parts that were not inside, as whole ranges with one more miss."""
    return missed.groupBy("key", "rows", (F.col("misses") + 1).alias("misses")).agg(
        F.lit(-INFINITY).alias("low"),
        F.lit(INFINITY).alias("high"),
        F.lit(INFINITY).alias("expected"),
        F.collect_list(F.struct("part", "share")).alias("wanted"),
    )


def _read(present: DataFrame, brackets: DataFrame) -> DataFrame:
    """``key, part, share, misses, rows, quantile, confirmed`` from the values inside the brackets and their counts."""
    keys = ["key", "low", "high"]
    counted = (
        present.join(brackets.select(*keys), "key")
        .filter("value <= high")
        # Everything below the bracket collapses into one null entry that sorts first.
        .selectExpr(*keys, "case when value >= low then value end as value")
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    reached = counted.selectExpr(
        *keys,
        "value",
        "sum(copies) over (partition by key, low, high order by value nulls first) as reached",
        "sum(copies) over (partition by key, low, high) as counted",
    )
    wanted = brackets.selectExpr(*keys, "misses", "rows", "inline(wanted)")
    # Without a sketch, the bracket is the whole range and the count is that of all rows.
    joined = reached.join(wanted, keys).selectExpr(
        "key", "part", "share", "misses", "coalesce(rows, counted) as rows", "reached", "value"
    )
    return _picked(joined, ["key", "part", "share", "misses", "rows"])


def _read_all(rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``key, part, quantile`` from the running count of all values of a key."""
    wanted = ", ".join(f"struct({i} as part, {float(p)!r}D as share)" for i, p in enumerate(probabilities))
    counted = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("copies"))
    reached = counted.selectExpr(
        "key",
        "value",
        "sum(copies) over (partition by key order by value) as reached",
        "sum(copies) over (partition by key) as rows",
    )
    return _picked(reached.selectExpr("*", f"inline(array({wanted}))"), ["key", "part", "share", "rows"])


def _picked(reached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value between the two ranks around the position, and whether counted values were there.

    The position is that of linear interpolation over all rows: ``share`` of the way from the first to the last.
    The entry that reaches a rank has no value if the rank is below the bracket, and there is none if it is above.
    """
    position = "share * (rows - 1)"
    picked = reached.groupBy(*keys).agg(
        F.expr(f"min(struct(reached, value)) filter (where reached > floor({position}))").alias("lower"),
        F.expr(f"min(struct(reached, value)) filter (where reached > ceil({position}))").alias("upper"),
    )
    ends = picked.selectExpr(*keys, "lower.value as first", "upper.value as last", f"{position} - floor({position}) as between")
    # Infinite neighbours that are the same have no distance.
    return ends.selectExpr(
        *keys,
        "case when between = 0 or first = last then first else first + (last - first) * between end as quantile",
        "first is not null and last is not null as confirmed",
    )
