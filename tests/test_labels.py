import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, labels


def random_graph(spark, n, m, seed, hubs=0):
    r = random.Random(seed)
    pick = lambda: f"n{r.randrange(hubs)}" if hubs and r.random() < 0.4 else f"n{r.randrange(n)}"
    return spark.createDataFrame([(pick(), pick(), "CALLS", 1.0) for _ in range(m)], "src string, dst string, type string, weight double")


@pytest.mark.parametrize("n,m,hubs,cutoff", [(40, 70, 0, 3), (60, 200, 4, 2), (30, 40, 0, 5)])
def test_labels_give_all_distances(spark, n, m, hubs, cutoff):
    edges = random_graph(spark, n, m, n, hubs)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)] + [("alone",)], "id string")
    built = labels.build(edges, cutoff, nodes)
    seeds = nodes.select(F.col("id").alias("seed"))
    want = sorted(map(tuple, graph.shortest(seeds, edges, cutoff, nodes).select("seed", "id", "dist").collect()))
    assert sorted(map(tuple, labels.shortest(built, seeds).select("seed", "id", "dist").collect())) == want
    pairs = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst")))
    along = sorted(map(tuple, graph.distances(nodes.select(F.col("id").alias("s"), "id"), edges, cutoff, ("s",)).select("s", "id", "dist").collect()))
    assert sorted(map(tuple, labels.distances(built, pairs).select("src", "dst", "dist").collect())) == along
    # no hub is listed below a node that is higher
    assert built.into.count() <= len(along) + 1


def test_a_hub_keeps_short_lists(spark):
    """A star: each leaf lists the hub and itself, and not the other leaves, which lie two steps off."""
    edges = spark.range(2000).select(F.concat(F.lit("leaf"), "id").alias("src"), F.lit("hub").alias("dst"))
    both = edges.union(edges.select("dst", "src"))
    built = labels.build(both, 2)
    assert built.into.count() == built.out.count() == 2 * 2000 + 1
    seeds = spark.createDataFrame([("leaf5",), ("nowhere",)], "seed string")
    assert labels.shortest(built, seeds).groupBy("dist").count().orderBy("dist").collect() == [(0, 1), (1, 1), (2, 1999)]


def test_no_edges(spark):
    edges = random_graph(spark, 5, 5, 1).limit(0)
    built = labels.build(edges, 3)
    assert labels.shortest(built, spark.createDataFrame([("a",)], "seed string")).collect() == []
