import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, names

SCHEMA = "symbol_id string, name string, qualified_name string, type string, file_path string, calls array<string>, base_classes array<string>, parent string, type_hints array<string>, ord long, line_start int, line_end int"


def symbols(spark, n=120, seed=0):
    """Few names, so that routes meet: own names, names and qualified names of one symbol, classes that are parents and callers, repeated ids."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        name = f"n{r.randrange(12)}"
        some = lambda k: [r.choice([f"n{r.randrange(14)}", f"A.n{r.randrange(12)}", "nobody"]) for _ in range(r.randrange(k))]
        rows.append((f"s{i if i % 10 else i // 2}", name, r.choice([name, f"A.{name}", f"B.{name}"]), r.choice(["class", "function", "method"]), f"f{i % 7}", some(5), some(3), r.choice([None, "", f"n{r.randrange(12)}", f"A.n{r.randrange(12)}"]), some(4), i, 1, 2))
    return spark.createDataFrame(rows, SCHEMA)


def triples(df):
    return sorted(map(tuple, df.select("src", "dst", "type", "weight").collect()))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_expanded_names_are_the_edges(spark, seed):
    s = symbols(spark, seed=seed)
    built = names.build(s)
    want = triples(graph.resolve_edges(s))
    assert triples(names.expand(built)) == want
    some = spark.createDataFrame([("s1",), ("s2",), ("s11",)], "id string")
    assert triples(names.edges_from(built, some)) == [e for e in want if e[0] in ("s1", "s2", "s11")]
    assert triples(names.edges_to(built, some)) == [e for e in want if e[1] in ("s1", "s2", "s11")]


def test_traversals_and_ranks_by_names(spark):
    s = symbols(spark, 90, 5)
    built, edges = names.build(s), graph.resolve_edges(s)
    seeds = spark.createDataFrame([("q", "s3"), ("q", "s4"), ("r", "s17"), ("r", "nowhere")], "query_id string, id string")
    for directed in (True, False):
        want = sorted(map(tuple, graph.distances(seeds, edges.select("src", "dst") if directed else graph.undirected(edges), 3).select("query_id", "id", "dist").collect()))
        assert sorted(map(tuple, names.distances(built, seeds, 3, directed).collect())) == want
    nodes = graph.nodes(s)
    for options in ({"iterations": 4, "tolerance": None}, {}):
        want = {x.id: x["rank"] for x in graph.pagerank(nodes, edges, **options).collect()}
        assert {x.id: x["rank"] for x in names.pagerank(built, nodes, **options).collect()} == pytest.approx(want, abs=1e-9)


def test_empty_tables(spark):
    s = symbols(spark, 3).limit(0)
    built = names.build(s)
    assert names.expand(built).collect() == []
    assert names.pagerank(built, graph.nodes(s)).collect() == []


def test_a_hot_name(spark):
    """10^5 callers and 10^4 definitions: 10^9 edges that never stand as rows."""
    none = F.array().cast("array<string>")
    callers = spark.range(100_000).select(F.concat(F.lit("c"), "id").alias("symbol_id"), F.concat(F.lit("caller"), "id").alias("name"), F.array(F.lit("run")).alias("calls"), "id")
    targets = spark.range(10_000).select(F.concat(F.lit("d"), "id").alias("symbol_id"), F.lit("run").alias("name"), none.alias("calls"), (F.col("id") + 100_000).alias("id"))
    rows = callers.unionByName(targets)
    s = rows.select("symbol_id", "name", F.concat(F.lit("m."), "symbol_id").alias("qualified_name"), F.lit("function").alias("type"), F.lit("f").alias("file_path"), "calls", none.alias("base_classes"), F.lit(None).cast("string").alias("parent"), none.alias("type_hints"), F.col("id").alias("ord"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    built = names.build(s)
    assert built.left.count() == 100_000 and built.right.count() == 10_000 and built.exceptions.count() == 0
    seeds = spark.createDataFrame([("q", "c7")], "query_id string, id string")
    assert names.distances(built, seeds, 1).count() == 1 + 10_000 + 1
    ranks = names.pagerank(built, graph.nodes(s), iterations=2, tolerance=None)
    assert ranks.select(F.sum("rank")).first()[0] == pytest.approx(1)
    d = {x.id: x["rank"] for x in ranks.filter("id IN ('d1', 'd77', 'c1')").collect()}
    assert d["d1"] == pytest.approx(d["d77"]) and d["d1"] > d["c1"]


def test_a_hub_of_a_million_neighbours(spark, monkeypatch):
    written = {}

    def counting(df, name, keep=False, real=graph.materialize):
        out = real(df, name, keep)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counting)
    ids = spark.range(1_000_000).select(F.format_string("n%07d", F.col("id")).alias("id"))
    edges = ids.select(F.lit("hub").alias("src"), F.col("id").alias("dst"), F.lit("CALLS").alias("type"), F.lit(1.0).alias("weight"))
    edges = edges.union(spark.createDataFrame([("n0500000", "z", "CALLS", 1.0), ("n0500000", "n0000003", "CALLS", 1.0)], edges.schema))
    symbols_ = ids.union(spark.createDataFrame([("hub",), ("z",)], "id string"))
    seeds = spark.createDataFrame([("q", "n0500000"), ("r", "hub")], "query_id string, id string")
    found = graph.expand(seeds, edges, symbols_, 2)
    got = {}
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.dist, x.id))
    assert got["r"] == [(0, "hub")] + [(1, f"n{i:07d}") for i in range(49)]
    assert got["q"] == [(0, "n0500000"), (1, "hub"), (1, "n0000003"), (1, "z")] + [(2, f"n{i:07d}") for i in range(47) if i != 3]
    assert max(written["near"]) <= 102


def test_bounded_expansion_is_the_whole_one_cut(spark):
    r = random.Random(8)
    edges = spark.createDataFrame([(f"a{r.randrange(60)}", r.choice([f"a{r.randrange(60)}", f"file{r.randrange(6)}"]), "CALLS", 1.0) for _ in range(260)], "src string, dst string, type string, weight double").dropDuplicates(["src", "dst"])
    ids = spark.createDataFrame([(f"a{i}",) for i in range(60)], "id string")
    seeds = spark.createDataFrame([(f"q{i}", f"a{r.randrange(60)}") for i in range(8) for _ in range(3)], "query_id string, id string")
    reached = graph.distances(seeds, graph.undirected(edges), 3).join(ids, "id", "left_semi").collect()
    for most in (2, 7, 50):
        want = []
        for q in {x.query_id for x in reached}:
            want += [(q, i, d, n) for n, (d, i) in enumerate(sorted((x.dist, x.id) for x in reached if x.query_id == q)[:most])]
        assert sorted(map(tuple, graph.expand(seeds, edges, ids, 3, most).collect())) == sorted(want)
