"""Distances by hub labels: built once, a distance is one join of two lists.

Nodes are ordered by degree, then id. A node's list ``into`` has the hubs that
reach it, ``out`` those that it reaches, each with the distance. A hub is
listed where it is the highest node of all shortest paths between the two, so
for every pair within the cutoff the highest node of its shortest paths is in
both lists, and no sum of two lists is below the distance.

The lists are built for all nodes at once, a level a round: a list entry goes
on along an edge to lower nodes only, and is dropped where the lists of the
levels before already give as short a way. The rounds are as many as the
cutoff; questions, however many seeds they have, take none.

Defined results: loops and repeated edges change nothing; nodes without edges
are known where ``nodes`` names them, and only to themselves; seeds that no
list has are dropped, as in ``graph.shortest`` with ``nodes``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import discard, materialize


@dataclass(frozen=True)
class Labels:
    """into(id, hub, dist): hub reaches id; out(id, hub, dist): id reaches hub."""

    into: DataFrame
    out: DataFrame
    cutoff: int


def build(edges: DataFrame, cutoff: int = 3, nodes: DataFrame | None = None) -> Labels:
    pairs = edges.select("src", "dst").filter("src <> dst").distinct()
    ends = pairs.select(F.col("src").alias("id")).union(pairs.select("dst"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    every = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    every = (every if nodes is None else every.union(nodes.select("id"))).filter("id IS NOT NULL").distinct()
    order = materialize(every.join(degree, "id", "left").select("id", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("id").alias("name")).alias("order")), "order")
    # edges with the places of their ends in the order
    steps = pairs.join(order.select(F.col("id").alias("src"), F.col("order").alias("src_order")), "src").join(order.select(F.col("id").alias("dst"), F.col("order").alias("dst_order")), "dst")
    steps = materialize(steps, "steps")
    there = steps.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("dst_order").alias("to_order"))
    back = steps.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.col("src_order").alias("to_order"))
    own = order.select("id", F.col("id").alias("hub"), F.col("order").alias("hub_order"), F.lit(0).alias("dist"))
    into, out = materialize(own, "into"), materialize(own, "out")
    for d in range(1, cutoff + 1):
        further = [_level(mine, other, way, d) for mine, other, way in ((into, out, there), (out, into, back))]
        fresh = [materialize(mine.unionByName(more), name) for mine, more, name in ((into, further[0], "into"), (out, further[1], "out"))]
        discard(into)
        discard(out)
        into, out = fresh
    return Labels(into.select("id", "hub", "dist"), out.select("id", "hub", "dist"), cutoff)


def _level(mine: DataFrame, other: DataFrame, way: DataFrame, d: int) -> DataFrame:
    """The entries of distance ``d``: those before them, one step on to a lower node, where no two entries are as short."""
    last = mine.filter(F.col("dist") == d - 1).select("id", "hub", "hub_order")
    reached = last.join(way, "id").filter(F.col("hub_order") > F.col("to_order")).select(F.col("to").alias("id"), "hub", "hub_order").distinct()
    # hub to x by the hub's other list, x to id by the id's own list
    by = other.select(F.col("id").alias("hub"), F.col("hub").alias("x"), F.col("dist").alias("d1"))
    rest = mine.select("id", F.col("hub").alias("x"), F.col("dist").alias("d2"))
    known = reached.select("id", "hub").join(by, "hub").join(rest, ["id", "x"]).filter(F.col("d1") + F.col("d2") <= d).select("id", "hub").distinct()
    return reached.join(known, ["id", "hub"], "left_anti").withColumn("dist", F.lit(d))


def distances(labels: Labels, pairs: DataFrame) -> DataFrame:
    """(src, dst, dist) of the pairs (src, dst) within the cutoff, along the edges."""
    asked = pairs.select("src", "dst").distinct().join(labels.out.select(F.col("id").alias("src"), "hub", F.col("dist").alias("d1")), "src")
    both = asked.join(labels.into.select(F.col("id").alias("dst"), "hub", F.col("dist").alias("d2")), ["dst", "hub"])
    return both.groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("dist")).filter(F.col("dist") <= labels.cutoff)


def shortest(labels: Labels, seeds: DataFrame) -> DataFrame:
    """(seed, id, dist): the shorter of the distances from and to each seed, up to the cutoff; as ``graph.shortest``."""
    own = seeds.select("seed").distinct()

    def reach(first: DataFrame, second: DataFrame) -> DataFrame:
        near = own.join(first.select(F.col("id").alias("seed"), "hub", F.col("dist").alias("d1")), "seed")
        return near.join(second.select("id", "hub", F.col("dist").alias("d2")), "hub").select("seed", "id", (F.col("d1") + F.col("d2")).alias("dist"))

    found = reach(labels.out, labels.into).unionByName(reach(labels.into, labels.out))
    return found.filter(F.col("dist") <= labels.cutoff).groupBy("seed", "id").agg(F.min("dist").alias("dist"))
