"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.session import materialize


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Links between different nodes, each once, smaller end first."""
    low, high = F.least(a, b), F.greatest(a, b)
    return df.filter(F.col(a) != F.col(b)).select(low.alias("u"), high.alias("v")).distinct()


def _rooted(parent: DataFrame) -> DataFrame:
    """Follow the parents to the root, doubling the step each time."""
    while True:
        up = parent.select(F.col("node").alias("p"), F.col("parent").alias("root"))
        jumped = materialize(
            parent.withColumnRenamed("parent", "p").join(up, "p").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("p")).alias("moved")),
            "parents",
        )
        parent = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return parent


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of links ``u, v``; a component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows these parents to the root
    and contracts the links, until none is left. Tables of a round are written to the shared
    folder. No links give no rows.
    """
    left = materialize(_ordered(links, "u", "v"), "links")
    labels = None
    while labels is None or not left.isEmpty():
        ends = left.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
            left.select(F.col("v").alias("node"), F.col("u").alias("other"))
        )
        parent = materialize(
            ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("parent")), "parents"
        )
        parent = _rooted(parent)
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("n2"), F.col("parent").alias("p2"))
            labels = materialize(
                labels.join(up, F.col("parent") == F.col("n2"), "left").select("node", F.coalesce("p2", "parent").alias("parent")),
                "labels",
            )
        up = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        vp = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        left = materialize(_ordered(left.join(up, "u").join(vp, "v"), "pu", "pv"), "links")
    return labels.withColumnRenamed("parent", "component")
