"""The graph as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import communities, graph, labels, names
from corvane.sources import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


_TRADE = """
p AS (SELECT *, p_partkey AS k FROM part),
s AS (SELECT 's' || k AS id, 'f' || (k // 4) AS name, p_brand || '.f' || (k // 4) AS qn, CASE WHEN p_size % 5 = 0 THEN 'class' ELSE 'function' END AS type, p_brand AS file_path,
  ['f' || ((k * 3 + 1) % 97), 'f' || ((k * 5 + 1) % 97)] AS calls, CASE WHEN p_size % 5 = 0 THEN ['f' || ((k * 7 + 1) % 97)] ELSE [] END AS bases,
  CASE WHEN p_size % 7 = 0 THEN 'f' || ((k * 11 + 1) % 97) END AS parent, CASE WHEN p_size % 2 = 0 THEN ['f' || ((k * 3 + 1) % 97)] ELSE [] END AS hints, k AS ord FROM p),
n AS (SELECT name AS key, id AS target, type FROM s UNION SELECT qn, id, type FROM s),
ce AS (
  SELECT id AS src, target AS dst, 'CALLS' AS type, 1.0::DOUBLE AS weight, ord, 0 AS phase FROM (SELECT id, ord, unnest(calls) AS c FROM s) x JOIN n ON key = c WHERE id <> target
  UNION ALL SELECT id, target, 'EXTENDS', 1.0, ord, 1 FROM (SELECT id, ord, unnest(bases) AS c FROM s) x JOIN n ON key = c WHERE id <> target
  UNION ALL SELECT target, id, 'CONTAINS', 1.0, ord, 2 FROM s JOIN n ON key = parent WHERE n.type = 'class'
  UNION ALL SELECT id, target, 'USES_TYPE', 0.8, ord, 3 FROM (SELECT id, ord, unnest(hints) AS c FROM s) x JOIN n ON key = c WHERE id <> target
  UNION ALL SELECT id, 'file::' || file_path, 'DEFINED_IN', 0.5, ord, 4 FROM s),
e AS (SELECT src, dst, type, weight FROM ce QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ord DESC, phase DESC) = 1)
"""


def _trade_edges(spark, sf_dir):
    return graph.resolve_edges(A.trade_symbols(spark, sf_dir))


@query(f"WITH {_TRADE} SELECT * FROM e")
def grf_resolve_edges(spark, sf_dir):
    return _trade_edges(spark, sf_dir)


@query(f"""WITH {_TRADE}, nd AS (SELECT id, type, file_path FROM s UNION ALL SELECT DISTINCT 'file::' || file_path, 'file', file_path FROM s)
SELECT 'node' AS kind, type AS name, count(*) AS n FROM nd GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type
UNION ALL SELECT 'total', 'nodes', count(*) FROM nd UNION ALL SELECT 'total', 'edges', count(*) FROM e UNION ALL SELECT 'total', 'files', count(DISTINCT file_path) FROM nd""")
def grf_stats(spark, sf_dir):
    s = A.trade_symbols(spark, sf_dir)
    return graph.stats(graph.nodes(s), graph.resolve_edges(s))


@query(f"WITH {_TRADE} SELECT id, src AS caller FROM (SELECT DISTINCT id FROM s WHERE ord % 50 = 0) JOIN e ON dst = id WHERE e.type = 'CALLS'")
def grf_callers(spark, sf_dir):
    s = A.trade_symbols(spark, sf_dir)
    ids = s.select(F.col("symbol_id").alias("id"), "ord")
    return graph.callers(graph.resolve_edges(s), ids, ids.filter("ord % 50 = 0"))


@query(f"WITH {_TRADE} SELECT id, dst AS callee FROM (SELECT DISTINCT id FROM s WHERE ord % 50 = 0) JOIN e ON src = id WHERE e.type = 'CALLS'")
def grf_callees(spark, sf_dir):
    s = A.trade_symbols(spark, sf_dir)
    ids = s.select(F.col("symbol_id").alias("id"), "ord")
    return graph.callees(graph.resolve_edges(s), ids, ids.filter("ord % 50 = 0"))


_GEO = """
e AS (SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'CALLS' AS type, 1.0::DOUBLE AS weight FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'DEFINED_IN', 0.5 FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'CALLS', 0.8 FROM nation),
nd AS (SELECT 'S' || s_suppkey AS id, s_name AS name, 'function' AS type FROM supplier UNION ALL SELECT 'C' || c_custkey, c_name, 'method' FROM customer
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'class' FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, 'file' FROM region),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
seed AS (SELECT 'q' || (c_custkey // 50 % 10) AS query_id, 'C' || c_custkey AS id FROM customer WHERE c_custkey % 50 = 0)
"""


def _seeds(spark, sf_dir):
    """Every fiftieth customer, in ten queries."""
    c = A.table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0")
    return c.select(F.concat(F.lit("q"), F.expr("c_custkey div 50 % 10").cast("string")).alias("query_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))


@query(f"""WITH RECURSIVE {_GEO}, w AS (SELECT id AS start, id, 0 AS d FROM nd WHERE type = 'function' UNION SELECT start, dst, d + 1 FROM w JOIN e ON src = id WHERE type = 'CALLS' AND d < 2),
r AS (SELECT start, id, min(d)::INT AS dist FROM w GROUP BY ALL)
SELECT start, a.name AS caller, 'CALLS' AS edge, b.name AS callee, dist FROM r JOIN e ON src = id AND type = 'CALLS' JOIN nd a ON a.id = src JOIN nd b ON b.id = dst""".replace("type = 'CALLS' JOIN", "e.type = 'CALLS' JOIN"))
def grf_call_chain(spark, sf_dir):
    nodes = A.geo_nodes(spark, sf_dir)
    return graph.call_chain(A.geo_edges(spark, sf_dir), nodes, nodes.filter("type = 'function'").select("id"), 3)


_BFS = """w AS (SELECT query_id, id, 0 AS d FROM seed UNION SELECT query_id, dst, d + 1 FROM w JOIN u ON src = id WHERE d < 2),
b AS (SELECT query_id, id, min(d)::INT AS dist FROM w GROUP BY ALL),
x AS (SELECT query_id, id, dist, (row_number() OVER (PARTITION BY query_id ORDER BY dist, id) - 1)::INT AS rank FROM b JOIN nd USING (id) WHERE type <> 'file' QUALIFY rank < 50)"""


@query(f"WITH RECURSIVE {_GEO}, {_BFS} SELECT * FROM x")
def grf_bfs_expand(spark, sf_dir):
    ids = A.geo_nodes(spark, sf_dir).filter("type <> 'file'").select("id")
    return graph.expand(_seeds(spark, sf_dir), A.geo_edges(spark, sf_dir), ids)


_DIST = """f AS (SELECT id AS seed, id, 0 AS d FROM seed UNION SELECT seed, dst, d + 1 FROM f JOIN e ON src = id WHERE d < 3),
g AS (SELECT id AS seed, id, 0 AS d FROM seed UNION SELECT seed, src, d + 1 FROM g JOIN e ON dst = id WHERE d < 3),
dd AS (SELECT seed, id, min(d)::INT AS dist FROM (SELECT * FROM f UNION ALL SELECT * FROM g) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_GEO.replace("'C' || c_custkey AS id FROM customer WHERE c_custkey % 50 = 0", "'N' || n_nationkey AS id FROM nation").replace("c_custkey // 50 % 10", "n_nationkey")}, {_DIST} SELECT * FROM dd""")
def grf_distances(spark, sf_dir):
    seeds = A.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("seed"))
    return graph.shortest(seeds, A.geo_edges(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {_GEO.replace("'C' || c_custkey AS id FROM customer WHERE c_custkey % 50 = 0", "'N' || n_nationkey AS id FROM nation").replace("c_custkey // 50 % 10", "n_nationkey")}, {_DIST} SELECT * FROM dd""")
def grf_distance_labels(spark, sf_dir):
    seeds = A.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("seed"))
    return labels.shortest(labels.build(A.geo_edges(spark, sf_dir), 3), seeds)


_RANK = """
ow AS (SELECT src, sum(weight) AS o FROM e GROUP BY src),
l AS (SELECT e.src, dst, weight / o AS p FROM e JOIN ow USING (src)),
nn AS (SELECT count(*)::DOUBLE AS n FROM nd)
"""
#: The same iterations to convergence, as the operator tests it: rk(id, r).
CONVERGED = """
pr AS (SELECT 0 AS i, id, 1 / n AS r, NULL::DOUBLE AS change, n FROM nd CROSS JOIN nn UNION ALL
  SELECT i + 1, id, nr, sum(abs(nr - r)) OVER (), n FROM (
    SELECT b.i, b.id, b.r, 0.85::DOUBLE * (coalesce(f, 0) + m / b.n) + 0.15::DOUBLE / b.n AS nr, b.change, b.n FROM pr b
    CROSS JOIN (SELECT coalesce(sum(r), 0) AS m FROM pr ANTI JOIN ow ON src = id)
    LEFT JOIN (SELECT dst, sum(p * r) AS f FROM l JOIN pr ON id = src GROUP BY dst) ON dst = b.id)
  WHERE i < 100 AND (change IS NULL OR change >= n * 1e-6)),
rk AS (SELECT id, CASE WHEN change < n * 1e-6 THEN r ELSE 1 / n END AS r FROM pr WHERE i = (SELECT max(i) FROM pr))
"""


def _rank_sql(iterations: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, 1 / n AS r FROM nd CROSS JOIN nn)"]
    for i in range(iterations):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT nd.id, 0.85::DOUBLE * (coalesce(f, 0) + m / n) + 0.15::DOUBLE / n AS r FROM nd CROSS JOIN nn "
            f"CROSS JOIN (SELECT coalesce(sum(r), 0) AS m FROM r{i} ANTI JOIN ow ON src = id) "
            f"LEFT JOIN (SELECT dst, sum(p * r) AS f FROM l JOIN r{i} ON id = src GROUP BY dst) ON dst = nd.id)"
        )
    return ", ".join(steps)


@query(f"WITH {_GEO}, {_RANK}, {_rank_sql(5)} SELECT id, round(r, 9) AS rank FROM r5")
def grf_pagerank_fixed(spark, sf_dir):
    found = graph.pagerank(A.geo_nodes(spark, sf_dir), A.geo_edges(spark, sf_dir), iterations=5, tolerance=None)
    return found.select("id", F.round("rank", 9).alias("rank"))


@query(f"WITH RECURSIVE {_GEO}, {_RANK}, {CONVERGED} SELECT id, round(r, 9) AS rank FROM rk")
def grf_pagerank(spark, sf_dir):
    """To convergence: the number of iterations depends on the data."""
    found = graph.pagerank(A.geo_nodes(spark, sf_dir), A.geo_edges(spark, sf_dir))
    return found.select("id", F.round("rank", 9).alias("rank"))


@query(f"""WITH RECURSIVE {_GEO}, {_BFS}, {_DIST.replace('d < 3', 'd < 2')}, {_RANK}, {CONVERGED},
nr AS (SELECT x.query_id, x.id, coalesce(max(1.0::DOUBLE / (dd.dist + 1)), 0) AS near FROM x JOIN seed ON seed.query_id = x.query_id LEFT JOIN dd ON dd.seed = seed.id AND dd.id = x.id GROUP BY ALL)
SELECT query_id, id AS page_id, round(near * (1 + 100 * r), 6) AS score FROM nr JOIN rk USING (id)""")
def grf_proximity(spark, sf_dir):
    nodes, edges, seeds = A.geo_nodes(spark, sf_dir), A.geo_edges(spark, sf_dir), _seeds(spark, sf_dir)
    near = graph.expand(seeds, edges, nodes.filter("type <> 'file'").select("id"))
    dist = graph.shortest(seeds.select(F.col("id").alias("seed")).distinct(), edges, 2)
    ranks = graph.pagerank(nodes, edges)
    found = graph.proximity(near, seeds, dist, ranks, nodes.select(F.col("id").alias("page_id"), F.col("id").alias("symbol_id")))
    return found.select("query_id", "page_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_TRADE}, g AS (SELECT file_path, min(ord) AS first, string_agg(type || ' ' || name, ',' ORDER BY ord) AS symbols FROM s GROUP BY 1)
SELECT file_path, symbols FROM g ORDER BY first LIMIT 20""")
def grf_tree(spark, sf_dir):
    return graph.tree(A.trade_symbols(spark, sf_dir)).select("file_path", F.array_join("symbols", ",").alias("symbols"))


@query(f"""WITH {_GEO}, {_RANK}, y0 AS (SELECT id, 1 / n AS y FROM nd CROSS JOIN nn),
y1 AS (SELECT dst AS id, sum(0.85::DOUBLE * p * y) AS y FROM l JOIN y0 ON id = src GROUP BY dst), y2 AS (SELECT dst AS id, sum(0.85::DOUBLE * p * y) AS y FROM l JOIN y1 ON id = src GROUP BY dst),
y AS (SELECT id, sum(y) AS y FROM (SELECT * FROM y0 UNION ALL SELECT * FROM y1 UNION ALL SELECT * FROM y2) GROUP BY id)
SELECT id, round(y / (SELECT sum(y) FROM y), 9) AS rank FROM y""")
def grf_pagerank_push(spark, sf_dir):
    """Converged: no path is longer than two edges, so SQL can follow all of them."""
    return graph.pagerank_push(A.geo_nodes(spark, sf_dir), A.geo_edges(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


@query(f"WITH {_TRADE} SELECT * FROM e")
def grf_named_edges(spark, sf_dir):
    """The edges, kept by names and expanded again."""
    return names.expand(names.build(A.trade_symbols(spark, sf_dir)))


_TRADE_ND = "nd AS (SELECT DISTINCT id FROM s UNION SELECT DISTINCT 'file::' || file_path FROM s)"


@query(f"WITH {_TRADE}, {_TRADE_ND}, {_RANK}, {_rank_sql(5)} SELECT id, round(r, 9) AS rank FROM r5")
def grf_named_pagerank(spark, sf_dir):
    s = A.trade_symbols(spark, sf_dir)
    return names.pagerank(names.build(s), graph.nodes(s), iterations=5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


@query(f"""WITH RECURSIVE {_TRADE}, sd AS (SELECT 'q' || (k // 50 % 5) AS query_id, id FROM (SELECT ord AS k, id FROM s) WHERE k % 50 = 0),
w AS (SELECT query_id, id, 0 AS d FROM sd UNION SELECT query_id, dst, d + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM e) ON src = id WHERE d < 2)
SELECT query_id, id, min(d)::INT AS dist FROM w GROUP BY ALL""")
def grf_named_distances(spark, sf_dir):
    s = A.trade_symbols(spark, sf_dir)
    seeds = s.filter("ord % 50 = 0").select(F.concat(F.lit("q"), F.expr("ord div 50 % 5").cast("string")).alias("query_id"), F.col("symbol_id").alias("id"))
    return names.distances(names.build(s), seeds, 2)


@query()
def grf_communities(spark, sf_dir):
    """Local moving in an order that SQL can't follow; a test holds its modularity against greedy merges."""
    return communities.communities(A.geo_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_GEO}, r AS (SELECT src AS id, src AS c FROM u UNION SELECT r.id, dst FROM r JOIN u ON src = c) SELECT id, min(c) AS component FROM r GROUP BY id")
def grf_components(spark, sf_dir):
    return communities.components(A.geo_edges(spark, sf_dir))
