"""Connected components by alternating large-star and small-star joins.

Every round is aggregates and equi-joins on the node, so a hub's neighbours are never in one cell; AQE splits the
partitions of a hub. Each round is written to the shared folder, which cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.storage import saved


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of the node and its neighbours.

    ``edges`` has (hi, lo), hi > lo. Large-star looks at all neighbours and moves the greater ones; small-star
    looks at the lesser ones and moves them and the node.
    """
    if both_ways:
        around = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(
            edges.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
    else:
        around = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
    least = around.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root"))
    moved = around.join(least, "node").select(F.col("near").alias("hi"), F.col("root").alias("lo"))
    if both_ways:
        moved = around.join(least, "node").where("near > node").select(F.col("near").alias("hi"), F.col("root").alias("lo"))
    else:
        moved = moved.unionByName(least.select(F.col("node").alias("hi"), F.col("root").alias("lo")))
    return moved.where("hi > lo").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the least node of its component.

    Links may repeat, point either way or join a node to itself; rows with a null end are no links. Nodes are of any
    ordered type. Without links the result is empty.
    """
    now = saved(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                .where(f"`{a}` is not null and `{b}` is not null and hi > lo").distinct(), "links")
    before, mark = None, _mark(now)
    while mark != before:
        before = mark
        now = saved(_stars(_stars(now, True), False), "links")
        mark = _mark(now)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
