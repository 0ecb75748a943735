"""The code graph by names: a use points to a name, a name to its definitions.

A name with 10^5 callers and 10^4 definitions stands for 10^9 edges; here it
is 110,000 rows. ``left`` (src, hub, type, weight) and ``right`` (hub, dst)
meet in hubs: one for each name that is used, and one for each name that is a
parent. Every src of a hub has an edge to every dst of it, but for itself.

Edges between the same two symbols overwrite each other (see ``graph``): the
last one processed gives type and weight. Pairs that several routes reach are
found by joins on two keys and kept as ``exceptions`` (src, dst, type, weight),
the edges as they end up; a pair of one route needs no such row.

Traversals take a step as two joins, through hubs that a query enters once.
Ranks flow to hubs, are summed there, and flow on; ``corrections`` (src, dst,
weight) make up for what the sums count too much: exceptions and a symbol's
uses of its own name.

Results equal those on ``graph.resolve_edges`` of the same symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import discard, materialize

from . import graph


@dataclass(frozen=True)
class NameGraph:
    left: DataFrame
    right: DataFrame
    files: DataFrame
    exceptions: DataFrame
    corrections: DataFrame


def _hub(kind: str, key: str):
    return F.concat(F.lit(kind), F.col(key))


def build(symbols: DataFrame) -> NameGraph:
    """symbols: as for ``graph.resolve_edges``."""
    own = symbols.select(F.col("symbol_id").alias("id"), "type", "ord", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"))
    own = materialize(own.filter("key IS NOT NULL"), "names")

    def used(array: str, phase: int, kind: str) -> DataFrame:
        return symbols.select(F.col("symbol_id").alias("src"), F.explode(F.array_distinct(array)).alias("key"), "ord", F.lit(phase).alias("phase"), F.lit(kind).alias("type"))

    uses = used("calls", 0, graph.CALLS).unionByName(used("base_classes", 1, graph.EXTENDS)).unionByName(used("type_hints", 3, graph.USES_TYPE)).filter("key IS NOT NULL")
    last = F.max_by(F.struct("type", "ord", "phase"), F.struct("ord", "phase"))
    uses = uses.groupBy("src", "key").agg(last.alias("e")).select("src", "key", "e.*")
    # names that nothing bears are no hubs
    uses = materialize(uses.join(own.select("key").distinct(), "key", "left_semi"), "uses")
    targets = materialize(own.select("key", F.col("id").alias("dst")).distinct(), "targets")
    owners = materialize(own.filter("type = 'class'").select("key", F.col("id").alias("src")).distinct(), "owners")
    children = symbols.filter("parent IS NOT NULL AND parent <> ''").groupBy(F.col("parent").alias("key"), F.col("symbol_id").alias("dst")).agg(F.max("ord").alias("ord"))
    children = materialize(children.join(owners.select("key").distinct(), "key", "left_semi"), "children")
    files = symbols.select(F.col("symbol_id").alias("src"), F.concat(F.lit("file::"), "file_path").alias("dst")).distinct()

    several = _several(uses, targets, owners, children)
    weight = F.create_map(*[F.lit(x) for kv in graph.WEIGHTS.items() for x in kv])
    by_use = several.join(targets, "dst").join(uses, ["src", "key"]).select("src", "dst", "type", "ord", "phase")
    by_parent = several.join(children, "dst").join(owners, ["key", "src"]).select("src", "dst", F.lit(graph.CONTAINS).alias("type"), "ord", F.lit(2).alias("phase"))
    routes = by_use.unionByName(by_parent).withColumn("weight", weight[F.col("type")])
    routes = materialize(routes, "routes")
    exceptions = materialize(graph.overwrite(routes), "exceptions")
    counted = routes.groupBy("src", "dst").agg(F.sum("weight").alias("counted"))
    corrections = exceptions.join(counted, ["src", "dst"]).select("src", "dst", (F.col("weight") - F.col("counted")).alias("weight"))
    # a symbol that uses its own name has no edge to itself by that; one that is its own parent has
    selves = uses.join(targets.select("key", F.col("dst").alias("src")), ["key", "src"]).select("src", F.col("src").alias("dst"), (-weight[F.col("type")]).alias("weight"))
    corrections = materialize(corrections.unionByName(selves), "corrections")
    left = uses.select("src", _hub("n:", "key").alias("hub"), "type", weight[F.col("type")].alias("weight"))
    left = left.unionByName(owners.select("src", _hub("p:", "key").alias("hub"), F.lit(graph.CONTAINS).alias("type"), F.lit(graph.WEIGHTS[graph.CONTAINS]).alias("weight")))
    right = targets.select(_hub("n:", "key").alias("hub"), "dst").unionByName(children.select(_hub("p:", "key").alias("hub"), "dst"))
    # hubs without one of their sides lead nowhere
    left = materialize(left.join(right.select("hub").distinct(), "hub", "left_semi").select("src", "hub", "type", "weight"), "left")
    right = materialize(right.join(left.select("hub").distinct(), "hub", "left_semi"), "right")
    return NameGraph(left, right, materialize(files, "files"), exceptions, corrections)


def _several(uses: DataFrame, targets: DataFrame, owners: DataFrame, children: DataFrame) -> DataFrame:
    """(src, dst) that more than one route reaches, src <> dst. Every join is on two keys or on an id, so that no hot name multiplies."""
    u, t = uses.select("src", "key"), targets
    # two names of one symbol, both used by one other
    two = t.select("dst", F.col("key").alias("k1")).join(t.select("dst", F.col("key").alias("k2")), "dst").filter("k1 < k2")
    both = two.select("k1", "k2").distinct().join(u.select("src", F.col("key").alias("k2")), "k2").join(u.select("src", F.col("key").alias("k1")), ["src", "k1"])
    by_use = both.join(two, ["k1", "k2"]).select("src", "dst")
    # a name that a class uses, of a symbol whose parent is the class
    named = children.select("dst", F.col("key").alias("parent")).join(t, "dst")  # dst, parent, key
    using = u.join(owners.select("src", F.col("key").alias("parent")), "src")  # src, key, parent
    mixed = using.join(named.select("parent", "key").distinct(), ["parent", "key"]).join(named, ["parent", "key"]).select("src", "dst")
    # two parents of one symbol that are names of one class
    twice = children.select("dst", F.col("key").alias("k1")).join(children.select("dst", F.col("key").alias("k2")), "dst").filter("k1 < k2")
    classes = twice.select("k1", "k2").distinct().join(owners.select("src", F.col("key").alias("k2")), "k2").join(owners.select("src", F.col("key").alias("k1")), ["src", "k1"])
    by_parent = classes.join(twice, ["k1", "k2"]).select("src", "dst")
    return materialize(by_use.union(mixed).union(by_parent).filter("src <> dst").distinct(), "several")


def expand(names: NameGraph) -> DataFrame:
    """All edges (src, dst, type, weight), as ``graph.resolve_edges`` gives them: for graphs whose names aren't hot, and for tests."""
    pairs = names.left.join(names.right, "hub").filter((F.col("src") != F.col("dst")) | (F.col("type") == graph.CONTAINS))
    once = pairs.select("src", "dst", "type", "weight").join(names.exceptions.select("src", "dst"), ["src", "dst"], "left_anti")
    # the same pair of one route may have come by two parents that are one class: it is an exception unless it is a loop
    once = once.dropDuplicates(["src", "dst"])
    inside = names.files.select("src", "dst", F.lit(graph.DEFINED_IN).alias("type"), F.lit(graph.WEIGHTS[graph.DEFINED_IN]).alias("weight"))
    return once.unionByName(names.exceptions).unionByName(inside)


def edges_from(names: NameGraph, ids: DataFrame) -> DataFrame:
    """The edges out of ``ids`` (id): the names of these alone are followed."""
    src = ids.select(F.col("id").alias("src")).distinct()
    part = NameGraph(*(x.join(src, "src", "left_semi") for x in (names.left,)), names.right, *(x.join(src, "src", "left_semi") for x in (names.files, names.exceptions, names.corrections)))
    return expand(part)


def edges_to(names: NameGraph, ids: DataFrame) -> DataFrame:
    """The edges into ``ids`` (id)."""
    dst = ids.select(F.col("id").alias("dst")).distinct()
    part = NameGraph(names.left, *(x.join(dst, "dst", "left_semi") for x in (names.right, names.files, names.exceptions, names.corrections)))
    return expand(part)


def distances(names: NameGraph, seeds: DataFrame, depth: int, directed: bool = True, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, id, dist) reached from ``seeds`` (keys, id) within ``depth`` edges, along them or, not ``directed``, either way.

    Hubs stand in the table of what is visited like symbols, and are entered once.
    """
    ways = [(names.left.select(F.col("src").alias("id"), "hub"), names.right.select("hub", F.col("dst").alias("to")), names.files.select(F.col("src").alias("id"), F.col("dst").alias("to")), ">")]
    if not directed:
        ways.append((names.right.select(F.col("dst").alias("id"), "hub"), names.left.select("hub", F.col("src").alias("to")), names.files.select(F.col("dst").alias("id"), F.col("src").alias("to")), "<"))
    flag = F.lit("").alias("way")
    visited = materialize(seeds.select(*keys, "id", flag, F.lit(0).alias("dist")).distinct(), "bfs")
    for d in range(1, depth + 1):
        frontier = visited.filter((F.col("dist") == d - 1) & (F.col("way") == "")).select(*keys, "id")
        hubs = None
        for enter, _, _, way in ways:
            found = frontier.join(enter, "id").select(*keys, F.col("hub").alias("id"), F.lit(way).alias("way")).distinct()
            hubs = found if hubs is None else hubs.unionByName(found)
        hubs = hubs.join(visited.select(*keys, "id", "way"), [*keys, "id", "way"], "left_anti")
        hubs = materialize(hubs.withColumn("dist", F.lit(d)), "hubs")
        reached = None
        for _, leave, direct, way in ways:
            found = hubs.filter(F.col("way") == way).select(*keys, F.col("id").alias("hub")).join(leave, "hub").select(*keys, F.col("to").alias("id"))
            found = found.union(frontier.join(direct, "id").select(*keys, F.col("to").alias("id")))
            reached = found if reached is None else reached.union(found)
        fresh = reached.distinct().join(visited.filter("way = ''").select(*keys, "id"), [*keys, "id"], "left_anti")
        fresh = fresh.select(*keys, "id", flag, F.lit(d).alias("dist"))
        further = materialize(visited.unionByName(hubs.select(*visited.columns)).unionByName(fresh), "bfs")
        discard(visited)
        discard(hubs)
        visited = further
    return visited.filter("way = ''").select(*keys, "id", "dist")


def pagerank(names: NameGraph, nodes: DataFrame, alpha: float = graph.ALPHA, iterations: int = graph.MAX_ITERATIONS, tolerance: float | None = graph.TOLERANCE) -> DataFrame:
    """(id, rank) as ``graph.pagerank`` on the expanded edges: ranks are summed in hubs, and corrections are edges like any other."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    direct = names.corrections.unionByName(names.files.select("src", "dst", F.lit(graph.WEIGHTS[graph.DEFINED_IN]).alias("weight")))
    direct = materialize(direct.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "direct")
    fan = names.right.groupBy("hub").agg(F.count("*").alias("fan"))
    out = names.left.join(fan, "hub").select("src", (F.col("weight") * F.col("fan")).alias("w")).union(direct.select("src", "weight"))
    out = out.groupBy("src").agg(F.sum("w").alias("out")).filter("out > 1e-9")
    state = ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "out", F.lit(1.0 / n).alias("rank"))
    state = materialize(state, "ranks")
    loose = F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("m")
    mass = state.agg(loose).first()["m"]
    for _ in range(iterations):
        sent = state.filter("out IS NOT NULL").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("r"))
        hubs = names.left.join(sent, "src").groupBy("hub").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
        flow = hubs.join(names.right, "hub").select(F.col("dst").alias("id"), "r").union(direct.join(sent, "src").select("dst", F.col("weight") * F.col("r")))
        flow = flow.groupBy("id").agg(F.sum("r").alias("flow"))
        rank = F.lit(alpha) * (F.coalesce("flow", F.lit(0.0)) + F.lit(mass / n)) + F.lit((1 - alpha) / n)
        fresh = materialize(state.join(flow, "id", "left").select("id", "out", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change")), "ranks")
        discard(state)
        state = fresh
        seen = fresh.agg(loose, F.sum("change").alias("change")).first()
        mass = seen["m"]
        if tolerance is not None and seen["change"] < n * tolerance:
            return state.select("id", "rank")
    return state.select("id", "rank") if tolerance is None else state.select("id", F.lit(1.0 / n).alias("rank"))
