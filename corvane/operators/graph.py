"""The code graph: edges from names, bounded traversals, PageRank, statistics.

nodes: id, name, type, file_path. edges: src, dst, type, weight, one a (src, dst).
Traversals work on all queries and seeds at once, one join a step, and keep
visited nodes in a table; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.storage import among, beside, discard, materialize

CALLS, EXTENDS, CONTAINS, USES_TYPE, DEFINED_IN = "CALLS", "EXTENDS", "CONTAINS", "USES_TYPE", "DEFINED_IN"
#: Edge types that are named but never made: a place for callers' own edges.
OTHER_TYPES = ("IMPORTS", "USES", "RETURNS", "OVERRIDES", "DECORATES")
NODE_TYPES = ("function", "class", "method", "variable", "import", "file", "module")
WEIGHTS = {CALLS: 1.0, EXTENDS: 1.0, CONTAINS: 1.0, USES_TYPE: 0.8, DEFINED_IN: 0.5}
MAX_NODES, HYBRID_MAX_NODES = 50, 30
ALPHA, TOLERANCE, MAX_ITERATIONS = 0.85, 1e-6, 100


def nodes(symbols: DataFrame) -> DataFrame:
    """Symbols and one node a file."""
    own = symbols.groupBy("symbol_id").agg(F.max_by(F.struct("name", "type", "file_path", "qualified_name", "line_start", "line_end"), "ord").alias("s"))
    own = own.select(F.col("symbol_id").alias("id"), "s.*")
    files = symbols.select("file_path").distinct().select(
        F.concat(F.lit("file::"), "file_path").alias("id"), T.basename(F.col("file_path")).alias("name"), F.lit("file").alias("type"), "file_path",
        F.lit(None).cast("string").alias("qualified_name"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
    )
    return own.unionByName(files)


def overwrite(candidates: DataFrame) -> DataFrame:
    """One edge a (src, dst): that of the last symbol processed, and of its last phase."""
    last = F.max_by(F.struct("type", "weight"), F.struct("ord", "phase"))
    return candidates.groupBy("src", "dst").agg(last.alias("e")).select("src", "dst", "e.type", "e.weight")


def resolve_edges(symbols: DataFrame) -> DataFrame:
    """Edges between symbols by name, and from symbols to their files. Names resolve to every symbol that bears them."""
    keys = symbols.select(F.col("name").alias("key"), F.col("symbol_id").alias("target"), "type").union(
        symbols.select(F.col("qualified_name").alias("key"), F.col("symbol_id").alias("target"), "type")
    ).distinct()

    def named(array: str, phase: int, kind: str) -> DataFrame:
        rows = symbols.select(F.col("symbol_id").alias("src"), "ord", F.explode(F.array_distinct(array)).alias("key"))
        rows = rows.join(keys.select("key", F.col("target").alias("dst")).hint("merge"), "key").filter("src <> dst")
        return _edges(rows, phase, kind)

    def _edges(rows: DataFrame, phase: int, kind: str) -> DataFrame:
        return rows.select("src", "dst", F.lit(kind).alias("type"), F.lit(WEIGHTS[kind]).alias("weight"), "ord", F.lit(phase).alias("phase"))

    children = symbols.filter("parent IS NOT NULL AND parent <> ''").select(F.col("parent").alias("key"), F.col("symbol_id").alias("dst"), "ord")
    owners = keys.filter("type = 'class'").select("key", F.col("target").alias("src"))
    files = symbols.select(F.col("symbol_id").alias("src"), F.concat(F.lit("file::"), "file_path").alias("dst"), "ord")
    every = (
        named("calls", 0, CALLS)
        .unionByName(named("base_classes", 1, EXTENDS))
        .unionByName(_edges(children.join(owners.hint("merge"), "key"), 2, CONTAINS))
        .unionByName(named("type_hints", 3, USES_TYPE))
        .unionByName(_edges(files, 4, DEFINED_IN))
    )
    return overwrite(every)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def distances(seeds: DataFrame, steps: DataFrame, depth: int, keys: tuple[str, ...] = ("query_id",), name: str = "bfs") -> DataFrame:
    """(keys, id, dist) reached from ``seeds`` (keys, id) along ``steps`` (src, dst) within ``depth``."""
    visited = materialize(seeds.select(*keys, "id").distinct().withColumn("dist", F.lit(0)), name)
    for d in range(1, depth + 1):
        frontier = visited.filter(F.col("dist") == d - 1).select(*keys, F.col("id").alias("src"))
        reached = steps.select("src", F.col("dst").alias("id")).join(beside(frontier), "src").select(*keys, "id").distinct()
        fresh = reached.join(beside(visited.select(*keys, "id")), [*keys, "id"], "left_anti").withColumn("dist", F.lit(d))
        further = materialize(visited.unionByName(fresh.select(*visited.columns)), name)
        discard(visited)
        visited = further
    return visited


def trimmed(steps: DataFrame, symbol_ids: DataFrame, most: int) -> DataFrame:
    """``steps`` (src, dst), of those to symbols only the ``most`` with the smallest ids out of each src."""
    marked = steps.join(symbol_ids.select(F.col("id").alias("dst")).distinct().withColumn("symbol", F.lit(True)).hint("merge"), "dst", "left").select("src", "dst", F.col("symbol").isNotNull().alias("symbol"))
    ranked = marked.filter("symbol").withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("at") <= most)
    return ranked.drop("at").unionByName(marked.filter("NOT symbol"))


def expand(seeds: DataFrame, edges: DataFrame, symbol_ids: DataFrame, depth: int = 2, max_nodes: int = MAX_NODES) -> DataFrame:
    """(query_id, id, dist, rank) of symbols near the seeds, nearest first, ties by id; files are passed through only.

    A query that has ``max_nodes`` symbols goes no further, and a level adds no
    more than are missing, the smallest ids first. While symbols are missing,
    all that were reached are kept and fewer than ``max_nodes``, so of a hub's
    neighbours the first two times ``max_nodes`` hold all that can count, and no
    frontier or step grows with a hub. (Nodes that are no symbols are all passed
    through: a symbol has one file.)
    """
    steps = materialize(trimmed(undirected(edges), symbol_ids, 2 * max_nodes), "steps")
    seeds = materialize(seeds.select("query_id", "id").distinct(), "seeds")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    known = among(ends.union(symbol_ids.select("id")), seeds, "id").distinct()
    symbols = among(symbol_ids.select("id"), seeds, "id").distinct().withColumn("symbol", F.lit(True))
    visited = known.join(beside(seeds), "id").select("query_id", "id").join(beside(symbols, seeds.count()), "id", "left")
    visited = materialize(visited.select("query_id", "id", F.col("symbol").isNotNull().alias("symbol"), F.lit(0).alias("dist")), "near")
    for d in range(1, depth + 1):
        missing = visited.groupBy("query_id").agg((F.lit(max_nodes) - F.count_if("symbol")).alias("missing")).filter("missing > 0")
        frontier = visited.filter(F.col("dist") == d - 1).join(missing.select("query_id"), "query_id", "left_semi").select("query_id", F.col("id").alias("src"))
        reached = steps.join(beside(frontier), "src").select("query_id", F.col("dst").alias("id"), "symbol").distinct()
        reached = reached.join(beside(visited.select("query_id", "id")), ["query_id", "id"], "left_anti")
        first = reached.filter("symbol").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("at") <= max_nodes)
        first = first.join(missing, "query_id").filter(F.col("at") <= F.col("missing")).select("query_id", "id", "symbol")
        fresh = first.unionByName(reached.filter("NOT symbol")).withColumn("dist", F.lit(d))
        further = materialize(visited.unionByName(fresh), "near")
        discard(visited)
        visited = further
    discard(steps)
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    found = visited.filter("symbol").withColumn("rank", F.row_number().over(order) - 1)
    return found.filter(F.col("rank") < max_nodes).select("query_id", "id", "dist", "rank")


def shortest(seeds: DataFrame, edges: DataFrame, cutoff: int = 3, nodes: DataFrame | None = None) -> DataFrame:
    """(seed, id, dist): the shorter of the directed distances from and to each seed, up to ``cutoff``."""
    own = seeds.select(F.col("seed"), F.col("seed").alias("id")).distinct()
    if nodes is not None:
        own = nodes.select("id").join(beside(own), "id").select("seed", "id")
    there = distances(own, edges, cutoff, ("seed",))
    back = distances(own, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), cutoff, ("seed",))
    return there.unionByName(back).groupBy("seed", "id").agg(F.min("dist").alias("dist"))


def callers(edges: DataFrame, symbol_ids: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, caller) for the symbols in ``ids``."""
    rows = edges.filter(F.col("type") == CALLS).join(ids.select(F.col("id").alias("dst")).distinct(), "dst")
    return rows.join(symbol_ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("caller"))


def callees(edges: DataFrame, symbol_ids: DataFrame, ids: DataFrame) -> DataFrame:
    rows = edges.filter(F.col("type") == CALLS).join(ids.select(F.col("id").alias("src")).distinct(), "src")
    return rows.join(symbol_ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("callee"))


def call_chain(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, caller, edge, callee, dist): every CALLS edge out of what is reached in fewer than ``depth`` calls."""
    calls = edges.filter(F.col("type") == CALLS).select("src", "dst")
    reached = distances(starts.select(F.col("id").alias("start"), "id"), calls, max(0, depth - 1), ("start",)) if depth > 0 else None
    if reached is None:
        return starts.select(F.col("id").alias("start"), F.lit("").alias("caller"), F.lit(CALLS).alias("edge"), F.lit("").alias("callee"), F.lit(0).alias("dist")).limit(0)
    rows = reached.withColumnRenamed("id", "src").join(calls, "src")
    label = nodes.select("id", "name")
    rows = rows.join(label.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src", "left").join(label.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst", "left")
    return rows.select("start", F.coalesce("caller", "src").alias("caller"), F.lit(CALLS).alias("edge"), F.coalesce("callee", "dst").alias("callee"), "dist")


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = ALPHA, iterations: int = MAX_ITERATIONS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """(id, rank) by weighted power iteration; the mass of nodes without out-edges is spread evenly.

    One written table and one small aggregate of it an iteration, which gives
    the change and the dangling mass. Without convergence in ``iterations`` all ranks
    are 1/n; ``tolerance`` None runs the iterations without a test.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    links = materialize(edges.join(beside(out, n), "src").filter("out > 0").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")), "links")
    state = ids.join(beside(out.filter("out > 0").withColumnRenamed("src", "id"), n), "id", "left")
    state = materialize(state.select("id", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")), "ranks")
    written = state
    loose = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("m")
    mass = state.agg(loose).first()["m"]
    for _ in range(iterations):
        flow = links.join(beside(state.select(F.col("id").alias("src"), "rank"), n), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("flow"))
        fresh = state.join(beside(flow, n), "id", "left")
        rank = F.lit(alpha) * (F.coalesce("flow", F.lit(0.0)) + F.lit(mass / n)) + F.lit((1 - alpha) / n)
        fresh = fresh.select("id", "dangling", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))
        fresh = materialize(fresh, "ranks")
        discard(written)
        written, state = fresh, fresh.select("id", "dangling", "rank")
        seen = fresh.agg(loose, F.sum("change").alias("change")).first()
        mass = seen["m"]
        if tolerance is not None and seen["change"] < n * tolerance:
            return state.select("id", "rank")
    return state.select("id", "rank") if tolerance is None else state.select("id", F.lit(1.0 / n).alias("rank"))


#: Flows of an iteration (about 40 bytes each) meet the ranks by a broadcast up to this number, counted first.
BROADCAST_FLOWS = 500_000
MAX_PUSHES = 1000


def pagerank_push(nodes: DataFrame, edges: DataFrame, alpha: float = ALPHA, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, rank) by pushing residuals: only nodes whose residual is above ``tolerance`` / n send anything.

    A node's rank is what it has sent on or holds; its residual is what has come in since. A round moves
    the residuals of the active nodes along their edges, so the rows shuffled are those of the active nodes' edges,
    fewer from round to round, and not those of the graph. Nodes without out-edges would
    spread their mass evenly; that changes all ranks by the same factor, so it is left out and the ranks are scaled to
    a sum of 1 at the end. What is left in residuals is at most ``tolerance`` / (1 - ``alpha``) of all.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out")).filter("out > 0")
    links = materialize(edges.join(out, "src").select("src", "dst", (F.lit(alpha) * F.col("weight") / F.col("out")).alias("p")), "links")
    state = materialize(ids.select("id", F.lit(0.0).alias("rank"), F.lit(1.0 / n).alias("residual")), "ranks")
    least = tolerance / n
    for _ in range(MAX_PUSHES):
        active = state.filter(F.col("residual") > least).select(F.col("id").alias("src"), "residual")
        count = active.count()
        if not count:
            break
        sent = links.join(F.broadcast(active) if count <= BROADCAST_FLOWS else active, "src")
        flow = materialize(sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("residual")).alias("flow")), "flow")
        small = flow.count() <= BROADCAST_FLOWS  # the ranks stay where they are
        goes = F.col("residual") > least
        rank = F.when(goes, F.col("rank") + F.col("residual")).otherwise(F.col("rank"))
        rest = F.when(goes, F.lit(0.0)).otherwise(F.col("residual")) + F.coalesce("flow", F.lit(0.0))
        further = materialize(state.join(F.broadcast(flow) if small else flow, "id", "left").select("id", rank.alias("rank"), rest.alias("residual")), "ranks")
        discard(state)
        discard(flow)
        state = further
    else:
        raise RuntimeError(f"ranks did not settle in {MAX_PUSHES} rounds")
    total = state.agg(F.sum(F.col("rank") + F.col("residual")).alias("s")).first()["s"]
    return state.select("id", ((F.col("rank") + F.col("residual")) / F.lit(total)).alias("rank"))


def proximity(expanded: DataFrame, seeds: DataFrame, dist: DataFrame, ranks: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, page_id, score): nearness to the closest seed times PageRank; nodes out of reach stay with 0."""
    near = expanded.select("query_id", "id").join(seeds.select("query_id", F.col("id").alias("seed")), "query_id").join(dist, ["seed", "id"], "left")
    near = materialize(near.groupBy("query_id", "id").agg(F.coalesce(F.max(1.0 / (F.col("dist") + 1)), F.lit(0.0)).alias("near")), "nearness")
    paged = pages.select("page_id", F.col("symbol_id").alias("id")).join(beside(near), "id")
    rows = paged.join(among(ranks, near, "id"), "id", "left")
    return rows.select("query_id", "page_id", F.round(F.col("near") * (1 + 100 * F.coalesce("rank", F.lit(0.0))), 9).alias("score"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals, nodes by type, edges by type, distinct files."""
    part = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), name.alias("name"), "n")
    return (
        part(nodes.groupBy("type").agg(F.count("*").alias("n")), "node", F.col("type"))
        .unionByName(part(edges.groupBy("type").agg(F.count("*").alias("n")), "edge", F.col("type")))
        .unionByName(part(nodes.agg(F.count("*").alias("n")), "total", F.lit("nodes")))
        .unionByName(part(edges.agg(F.count("*").alias("n")), "total", F.lit("edges")))
        .unionByName(part(nodes.agg(F.count_distinct("file_path").alias("n")), "total", F.lit("files")))
    )


def tree(symbols: DataFrame, files: int = 20) -> DataFrame:
    """(file_path, symbols): the first files in the order of their first symbol, each with its symbols in order."""
    groups = symbols.groupBy("file_path").agg(F.min("ord").alias("first"), F.sort_array(F.collect_list(F.struct("ord", "type", "name", "line_start"))).alias("symbols"))
    return groups.orderBy("first").limit(files).select("file_path", F.transform("symbols", lambda s: F.concat_ws(" ", s["type"], s["name"])).alias("symbols"))
