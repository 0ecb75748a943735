"""Communities by modularity: local moving on DataFrames, contraction, and greedy merges of what is left.

A level begins with every node as its own community. In each round half of the
nodes, chosen by a hash, look at the communities of their neighbours and move
to the one with the highest gain in modularity; all moves of a round are
joins and sums, and a hub's neighbours are summed before they meet. The best
state of the rounds is contracted: a community becomes a node, and edges are
summed. Once the contracted graph has at most ``FINAL_EDGES`` edges, greedy
merges finish it in one task; until then level follows level. No group of rows
is larger than that bound, whatever the graph.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import beside, discard, materialize


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) by spreading the smallest id, with a jump to the label's label in each round."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = materialize(both, "both")
    state = materialize(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    written = state
    for _ in range(rounds):
        seen = both.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("m"))
        fresh = state.join(seen, "id", "left").select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = fresh.select(F.col("id").alias("component"), F.col("component").alias("further"))
        fresh = materialize(fresh.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "old"), "labels")
        discard(written)
        written = fresh
        state = fresh.select("id", "component")
        if fresh.filter("component <> old").isEmpty():
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


LEVELS, ROUNDS = 12, 10
#: Edges of the contracted graph that one task merges at most. A level ends once fewer than 1 in SETTLED nodes move.
FINAL_EDGES, SETTLED = 50_000, 200


def greedy_merges(weighted: list[tuple[str, str, float]], total: float) -> dict[str, str]:
    """Node to the smallest node of its community, by greedy merges. weighted: each pair once, a loop with its own weight; total: twice the sum of all edges' weights of the whole graph."""
    graph: dict[str, dict[str, float]] = {}
    degree: dict[str, float] = {}
    for a, b, w in weighted:
        graph.setdefault(a, {})
        graph.setdefault(b, {})
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
        if a != b:
            graph[a][b] = graph[b][a] = w
    share = {a: d / total for a, d in degree.items()}
    gain = {a: {b: 2 * w / total - 2 * share[a] * share[b] for b, w in near.items()} for a, near in graph.items()}
    heap = [(-g, *sorted((a, b))) for a, near in gain.items() for b, g in near.items() if a < b]
    heapq.heapify(heap)
    member = {a: [a] for a in graph}
    while heap:
        g, a, b = heapq.heappop(heap)
        if -g <= 0:
            break
        if a not in gain or gain[a].get(b) != -g:
            continue
        for c in set(gain[a]) | set(gain[b]):
            if c in (a, b):
                continue
            if c in gain[a] and c in gain[b]:
                q = gain[a][c] + gain[b][c]
            elif c in gain[a]:
                q = gain[a][c] - 2 * share[b] * share[c]
            else:
                q = gain[b][c] - 2 * share[a] * share[c]
            gain[a][c] = gain[c][a] = q
            gain[c].pop(b, None)
            heapq.heappush(heap, (-q, *sorted((a, c))))
        gain[a].pop(b, None)
        del gain[b]
        share[a] += share.pop(b)
        member[a] += member.pop(b)
    return {x: min(xs) for xs in member.values() for x in xs}


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of the communities in ``labels`` (id, community); edges are taken without direction and weight."""
    plain = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    own = plain.join(labels.select(F.col("id").alias("a"), F.col("community").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("y")), "b")
    m = own.count()
    if not m:
        return 0.0
    inside = own.filter("x = y").count() / m
    ends = own.select(F.col("x").alias("c")).union(own.select(F.col("y").alias("c"))).groupBy("c").agg((F.count("*") / (2 * m)).alias("s"))
    return inside - (ends.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0)


def _moved(links: DataFrame, loops: DataFrame, nodes: DataFrame, total: float, level: int) -> DataFrame:
    """(id, community) after the rounds of a level. links (src, dst, w): both directions, no loops; nodes (id, k)."""
    state = materialize(nodes.select("id", "k", F.col("id").alias("c")), "communities")
    n, best, best_q, still = state.count(), None, None, 0
    for turn in range(ROUNDS):
        near = links.join(beside(state.select(F.col("id").alias("dst"), "c"), n), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
        near = materialize(near, "near")
        sums = materialize(state.groupBy("c").agg(F.sum("k").alias("tot")), "sums")
        few = beside(sums)  # once most nodes share a few communities, these are hot keys and few rows
        own = near.join(beside(state.select("id", F.col("c")), n), ["id", "c"]).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()["w"]
        loop = loops.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()["w"]
        q = (own + loop) / total - sums.agg(F.sum((F.col("tot") / total) * (F.col("tot") / total)).alias("s")).first()["s"]
        if best_q is None or q > best_q + 1e-12:
            if best is not None:
                discard(best)
            best, best_q, still = state, q, 0
        else:
            still += 1
        if turn == ROUNDS - 1 or still > 3:
            if state is not best:
                discard(state)
            break
        # the gain of being in c and not alone; a node's own community counts without it
        scored = near.join(few, "c").join(beside(state.select("id", "k", F.col("c").alias("old")), n), "id")
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)) / total
        scored = scored.select("id", "c", F.round(gain, 9).alias("gain"), (F.col("c") == F.col("old")).alias("mine"))
        top = scored.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("m"), F.max(F.when(F.col("mine"), F.col("gain"))).alias("stay"))
        # where no neighbour is in its own community, staying has the gain of what else is in there
        alone = state.join(few, "c").select("id", "k", "c", "tot").join(beside(top, n), "id", "left")
        stay = F.coalesce("stay", F.round(-F.col("k") * (F.col("tot") - F.col("k")) / total, 9))
        awake = F.pmod(F.xxhash64("id", F.lit(turn), F.lit(level)), F.lit(2)) == 0
        goes = awake & F.col("m").isNotNull() & (-F.col("m.g") > stay + 1e-9) & (F.col("m.c") != F.col("c"))
        fresh = alone.select("id", "k", F.when(goes, F.col("m.c")).otherwise(F.col("c")).alias("c"), F.coalesce(goes, F.lit(False)).alias("moved"))
        fresh = materialize(fresh, "communities")
        moved = fresh.filter("moved").count()
        discard(near)
        discard(sums)
        if state is not best:
            discard(state)
        state = fresh.select("id", "k", "c")
        state.written_at = fresh.written_at
        if moved * SETTLED <= n and turn % 2:
            still = max(still, 3)  # one more look at what this round has made
    return best.select("id", F.col("c").alias("community"))


def communities(edges: DataFrame, final_edges: int = FINAL_EDGES) -> DataFrame:
    """(id, community): the community's smallest id; the edges are taken without direction and weight, those with a null end are left out."""
    plain = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    plain = materialize(plain.withColumn("w", F.lit(1.0)), "plain")
    total = 2.0 * plain.count()
    labels = materialize(plain.select(F.col("a").alias("id")).union(plain.select("b")).distinct().withColumn("community", F.col("id")), "labels")
    if not total:
        return labels

    def renamed(found: DataFrame) -> DataFrame:
        """The labels of all nodes, from those of the level's: a community is named by its smallest id."""
        found = materialize(found, "found")
        joined = labels.join(beside(found.select(F.col("id").alias("community"), F.col("community").alias("next"))), "community")
        least = materialize(joined.groupBy("next").agg(F.min("id").alias("least")), "least")
        return materialize(joined.join(beside(least), "next").select("id", F.col("least").alias("community"), F.col("community").alias("before")), "labels")

    current, size = plain, plain.count()  # a, b, w: each pair once
    for level in range(LEVELS):
        if level and size <= final_edges:
            break
        loops = current.filter("a = b").select(F.col("a").alias("id"), (2 * F.col("w")).alias("w"))
        links = current.filter("a <> b")
        links = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(links.select("b", "a", "w"))
        ends = links.select(F.col("src").alias("id"), "w").union(loops)
        nodes = materialize(ends.groupBy("id").agg(F.sum("w").alias("k")), "nodes")
        further = renamed(_moved(materialize(links, "links"), loops, nodes, total, level))
        names = materialize(further.select(F.col("before").alias("id"), "community").distinct(), "names")
        known = names.count()
        merged = current.join(beside(names.select(F.col("id").alias("a"), F.col("community").alias("x")), known), "a").join(beside(names.select(F.col("id").alias("b"), F.col("community").alias("y")), known), "b")
        merged = merged.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
        merged = materialize(merged, "contracted")
        before, size = size, merged.count()
        labels, current = further.select("id", "community"), merged
        if size >= before:  # nothing was joined
            break
    if size > final_edges:
        return labels

    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = greedy_merges(sorted(zip(rows["a"], rows["b"], rows["w"], strict=True)), total)
        return pd.DataFrame({"id": list(found), "community": list(found.values())})

    # one group of at most ``final_edges`` rows
    found = current.groupBy(F.lit(0).alias("all")).applyInPandas(work, "id string, community string")
    return renamed(found).select("id", "community")
