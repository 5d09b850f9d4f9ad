"""Merkle manifest of a table: one digest for all rows, and a short proof for each of them.

The rows of a group, in the order of their ids, are the leaves of one tree; the roots of the
groups are the leaves of a last tree, whose root stands for the table. Every ``FANOUT``
consecutive nodes are hashed into their parent.

Only every ``EVERY``-th level is stored (a checkpoint). ``proofs`` walks from the root down: it
groups the nodes of a stored level by the aligned subtree they belong to, at most ``FANOUT ** EVERY``
of them, hashes the levels between this checkpoint and the next again, gives each node its siblings,
and drops those levels. A subtree meets the proof of its own root by a join on the subtree, so
the long proofs are put together in the last step and never shuffled row by row.

Cases: nulls are leaves like others (``-`` in the digest); null groups come first and are a group
of their own; null ids come first in their group; repeated ids are ordered by their digest, and rows equal
in all hashed columns are equal leaves side by side, so each of them has a leaf of its own. A group of one row is
its own root. An empty table gives empty levels and no proofs. Columns that are not named are not read, and
their names do not matter. A text is hashed where it is read and goes nowhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.llm.ranks import ranked
from lustra.operators.lookup import GROUP_ROWS, build_lookup
from lustra.session import new_scratch_path

#: Nodes hashed into one parent, and levels from one stored level to the next.
FANOUT = 8
EVERY = 3
#: Highest tree that can be asked for; with two nodes a parent that is more rows than a long can count.
TALLEST = 62
STEP = "struct<place:int,others:array<string>>"


def _field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, a colon, and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: sha256 of its values, none of which can run into the next."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def parent(node: Column, step: Column) -> Column:
        left = F.slice(step["others"], F.lit(1), step["place"])
        right = F.slice(step["others"], step["place"] + 1, F.size(step["others"]))
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")), 256)

    return F.aggregate(proof, leaf, parent)


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level and left to right."""
    return F.flatten(F.transform(proof, lambda step: step["others"]))


def _height(leaves: Column, fanout: int) -> Column:
    """Levels above so many leaves."""
    powers = [fanout**k for k in range(TALLEST) if fanout**k < 1 << 62]
    return sum((F.when(F.lit(p) < leaves, 1).otherwise(0) for p in powers), F.lit(0))


@dataclass(frozen=True)
class Forest:
    """Trees of one kind in a folder: the stored levels 0, ``every``, 2 x ``every`` and so on.

    A stored node has its ``tree``, its ``position`` in the level, the ``rest`` of levels above it, its
    ``digest``, and ``row``, which is null above the leaves.
    """

    spark: SparkSession
    path: str
    stored: int
    fanout: int
    every: int

    def level(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level-{number * self.every}")

    def roots(self) -> DataFrame:
        """``tree, digest``: the last stored level holds one node of each tree."""
        return self.level(self.stored).select("tree", "digest")

    def _subtrees(self, number: int) -> DataFrame:
        """The aligned subtrees above a stored level, each with its nodes in order."""
        width = self.fanout**self.every
        node = F.struct("position", "digest", "row")
        return (
            self.level(number)
            .groupBy("tree", F.expr(f"position div {width}").alias("subtree"))
            .agg(F.min("rest").alias("rest"), F.sort_array(F.collect_list(node)).alias("nodes"))
            .withColumn("level0", F.transform("nodes", lambda n: n["digest"]))
        )

    def _with_levels(self, subtrees: DataFrame, last: int) -> DataFrame:
        """Add ``level1`` to the last one wanted. A root that was reached is passed on."""
        for k in range(last):
            parents = F.transform(self._runs(f"level{k}"), lambda run: F.sha2(F.array_join(run["nodes"], ""), 256))
            level = F.when(F.col("rest") > k, parents).otherwise(F.col(f"level{k}"))
            subtrees = subtrees.withColumn(f"level{k + 1}", level)
        return subtrees

    def _runs(self, nodes: str) -> Column:
        """The runs of siblings of an array, numbered."""
        numbers = F.expr(f"sequence(0, int((size({nodes}) - 1) div {self.fanout}))")

        def run(number: Column) -> Column:
            members = F.slice(nodes, number * self.fanout + 1, F.lit(self.fanout))
            return F.struct(number.alias("number"), members.alias("nodes"))

        return F.transform(numbers, run)

    def store_next(self, number: int) -> None:
        """Hash a stored level up to the next one that is stored."""
        top = self._with_levels(self._subtrees(number), self.every)
        top.select(
            "tree",
            F.col("subtree").alias("position"),
            F.greatest(F.col("rest") - self.every, F.lit(0)).alias("rest"),
            F.get(f"level{self.every}", F.lit(0)).alias("digest"),
            F.lit(None).cast("int").alias("row"),
        ).write.parquet(f"{self.path}/level-{(number + 1) * self.every}")

    def _siblings(self, level: Column | str, at: Column) -> Column:
        """A step of a proof: the place of the node ``at`` in its run, and the rest of the run."""
        place = at % self.fanout
        first = at - place
        left = F.slice(level, first + 1, place)
        right = F.slice(level, first + place + 2, F.lit(self.fanout - 1) - place)
        return F.struct(place.cast("int").alias("place"), F.concat(left, right).alias("others"))

    def _expand(self, number: int, above: DataFrame) -> DataFrame:
        """Proofs of the nodes of a stored level from those of the subtrees' roots."""
        none = F.array().cast(f"array<{STEP}>")
        known = [c for c in above.columns if c not in ("tree", "position", "proof")]
        subtrees = self._with_levels(self._subtrees(number), self.every - 1)
        # One row for each subtree on both sides; the subtrees are in place, so only ``above`` is shuffled.
        upper = above.withColumnRenamed("position", "subtree").hint("shuffle_hash")
        subtrees = subtrees.join(upper, ["tree", "subtree"])
        steps = [
            F.when(
                F.col("rest") > k,
                F.array(self._siblings(f"level{k}", F.expr(f"int(run.number div {self.fanout ** (k - 1)})"))),
            ).otherwise(none)
            for k in range(1, self.every)
        ]
        inner = [f"level{k}" for k in range(1, self.every)]
        runs = subtrees.select("tree", "rest", *known, "proof", *inner, F.explode(self._runs("nodes")).alias("run")).select(
            "tree", "rest", *known, "run.nodes", F.concat(*steps, "proof").alias("above")
        )
        nodes = runs.withColumn("digests", F.transform("nodes", lambda n: n["digest"])).select(
            "tree", "rest", *known, "above", "digests", F.posexplode("nodes").alias("at", "node")
        )
        own = F.when(F.col("rest") > 0, F.array(self._siblings("digests", F.col("at")))).otherwise(none)
        return nodes.select(
            "tree", "node.position", "node.digest", "node.row", *known, F.concat(own, "above").alias("proof")
        )

    def proofs(self, above: DataFrame) -> DataFrame:
        """``tree, position, digest, row, proof`` of all leaves, and what else ``above`` has.

        ``above`` has one row for each ``tree``, with the ``proof`` that continues that of the tree.
        """
        found = above.withColumn("position", F.lit(0).cast("long"))
        for number in reversed(range(self.stored)):
            found = self._expand(number, found.drop("digest", "row"))
        return found


def _forest(leaves: DataFrame, path: str, fanout: int, every: int) -> Forest:
    """Store the leaves (``tree, position, rest, digest, row``) and every few levels above them."""
    spark = leaves.sparkSession
    leaves.select("tree", "position", "rest", "digest", "row").write.parquet(f"{path}/level-0")
    forest = _open_forest(spark, path, fanout, every)
    for number in range(forest.stored):
        forest.store_next(number)
    return forest


def _open_forest(spark: SparkSession, path: str, fanout: int, every: int) -> Forest:
    tallest = spark.read.parquet(f"{path}/level-0").agg(F.max("rest")).first()[0] or 0
    return Forest(spark, path, max(1, -(-tallest // every)), fanout, every)


@dataclass(frozen=True)
class Manifest:
    """The trees of all groups, and the tree of their roots."""

    groups: Forest
    top: Forest

    def root(self) -> str | None:
        """The digest of the whole table; None if it is empty."""
        row = self.top.roots().first()
        return row["digest"] if row else None

    def proofs(self) -> DataFrame:
        """``group, id, extra, leaf, subroot, root, proof``, one row for each row of the table.

        ``proof`` holds for each level the place of the node among its siblings, and these.
        """
        none = F.array().cast(f"array<{STEP}>")
        whole = self.top.roots().select("tree", F.col("digest").alias("root"), none.alias("proof"))
        above = self.top.proofs(whole).select(
            F.col("row.tree").alias("tree"), "root", F.col("digest").alias("subroot"), "proof"
        )
        return self.groups.proofs(above).select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "proof")


def build_manifest(
    docs: DataFrame,
    columns: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    extra: Mapping[str, Column] | None = None,
    path: str | None = None,
    fanout: int = FANOUT,
    every: int = EVERY,
) -> Manifest:
    """Hash ``columns`` of all rows into a manifest below ``path`` (else in the shared folder).

    ``extra`` are small expressions over the row, of types that can be ordered; ``proofs`` returns them.
    """
    spark = docs.sparkSession
    path = path or new_scratch_path(spark, "merkle")
    extras = F.struct(*[c.alias(n) for n, c in (extra or {}).items()]) if extra else F.lit(None).cast("int")
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        # Never null, and in the same order as the groups with null first.
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("key"),
        group.alias("group"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        extras.alias("extra"),
    )
    leaves = ranked(leaves, ["key", "id", "digest"], "rank", "merkle-leaves")
    groups = leaves.groupBy("key").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias(GROUP_ROWS))
    # The groups may be many, so they come back by a measured join that knows the large ones.
    lookup = build_lookup(groups.withColumn("rest", _height(F.col(GROUP_ROWS), fanout)), "key", label="merkle-groups")
    placed = lookup.attach(leaves).select(
        "tree", (F.col("rank") - F.col("tree")).alias("position"), "rest", "digest", F.struct("group", "id", "extra").alias("row")
    )
    trees = _forest(placed, f"{path}/groups", fanout, every)

    roots = ranked(trees.roots(), ["tree"], "position", "merkle-roots")
    height = _height(F.lit(lookup.table.count()), fanout)
    subroots = roots.select(F.lit(0).cast("long").alias("tree"), "position", height.alias("rest"), "digest", F.struct("tree").alias("row"))
    return Manifest(trees, _forest(subroots, f"{path}/top", fanout, every))


def open_manifest(spark: SparkSession, path: str, fanout: int = FANOUT, every: int = EVERY) -> Manifest:
    """A manifest that ``build_manifest`` stored below ``path`` with the same shape."""
    return Manifest(*(_open_forest(spark, f"{path}/{name}", fanout, every) for name in ("groups", "top")))
