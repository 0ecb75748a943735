"""No step broadcasts a table that grows with the input, however small its files are."""

import pytest

from corvane import storage
from corvane.operators import communities, graph, symbols


@pytest.fixture
def planned(monkeypatch):
    """The plans of all tables that a module writes while it runs, where every counted side is above the bound."""
    plans = []

    def watch(*modules):
        monkeypatch.setattr(storage, "BROADCAST_ROWS", -1, raising=False)  # an empty side too
        for module in modules:

            def written(df, name, *args, f=module.materialize, **kwargs):
                plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
                return f(df, name, *args, **kwargs)

            monkeypatch.setattr(module, "materialize", written)
        return plans

    return watch


def broadcasting(plans):
    return sorted({name for name, plan in plans if "BroadcastHashJoin" in plan})


def test_communities_broadcast_nothing_that_grows(spark, planned):
    plans = planned(communities)
    edges = spark.createDataFrame([(f"x{i}", f"h{i % 3}") for i in range(60)] + [("h0", "h1"), ("h1", "h2")], "src string, dst string")
    found = communities.communities(edges)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert found.count() == 63
    assert broadcasting(plans) == []


def planned_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_steps_broadcast_nothing_that_grows(spark, planned):
    """Ranks, the steps of an expansion, and distances from many seeds."""
    plans = planned(graph)
    nodes = spark.createDataFrame([(f"s{i:02d}",) for i in range(40)] + [("file::a",), ("file::b",)], "id string")
    edges = spark.createDataFrame([(f"s{i:02d}", f"file::{'ab'[i % 2]}", 0.5) for i in range(40)], "src string, dst string, weight double")
    ids = nodes.filter("id LIKE 's%'")
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    assert len(ranks) == 42 and sum(ranks.values()) == pytest.approx(1.0)
    seeds = ids.selectExpr("id AS seed")
    found = graph.shortest(seeds, edges, 2, nodes)
    plans.append(("shortest", planned_of(found)))
    assert found.count() == 80
    near = graph.expand(ids.selectExpr("'q' AS query_id", "id").limit(1), edges, ids, 2, 5)
    assert near.count() == 5
    assert broadcasting([p for p in plans if p[0] in ("links", "ranks", "bfs", "steps", "shortest")]) == []


def test_names_broadcast_nothing_that_grows(spark, planned, tmp_path):
    """Symbols of the names that an ident meets; and of a name that many share, the first by id."""
    plans = planned(symbols) if hasattr(symbols, "materialize") else []
    table = spark.createDataFrame([(f"{i:03d}", f"name{i % 3}", f"m.name{i % 3}") for i in range(90)] + [("x", "rename1", "m.rename1")], "symbol_id string, name string, qualified_name string")
    table.write.parquet(str(tmp_path / "symbols"))
    table = spark.read.parquet(str(tmp_path / "symbols"))  # small files
    idents = spark.createDataFrame([("q", "name1"), ("q", "ame"), ("r", "NAME1"), ("r", "x1")], "query_id string, ident string")
    exact = symbols.lookup(idents, table)
    plans.append(("exact", planned_of(exact)))
    assert {tuple(r) for r in exact.collect()} == {("q", "name1", f"{i:03d}") for i in range(1, 90, 3)}
    found = symbols.lookup_fuzzy(idents, table, limit=31)
    plans.append(("fuzzy", planned_of(found)))
    shared = [f"{i:03d}" for i in range(1, 90, 3)] + ["x"]
    assert {tuple(r) for r in found.filter("ident IN ('name1', 'NAME1')").collect()} == {(q, i, s, n) for q, i in (("q", "name1"), ("r", "NAME1")) for n, s in enumerate(shared, 1)}
    assert {tuple(r) for r in found.filter("ident = 'ame'").collect()} == {("q", "ame", f"{i:03d}", i + 1) for i in range(31)}
    pages = table.selectExpr("concat('p', symbol_id) AS page_id", "symbol_id")
    scores = symbols.page_scores(symbols.exact_else_fuzzy(idents, table), pages)
    plans.append(("scores", planned_of(scores)))
    assert scores.filter("query_id = 'q' AND score >= 1").count() == 30
    assert broadcasting([p for p in plans if p[0] in ("exact", "scores")]) == []
