import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import communities, context, evaluate, fusion, graph, lexical, symbols, vector
from corvane.plans import providers, retrievers
from corvane.sources.store import Index


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "durian"), (4, None), (5, "")], "page_id long, text string")
    queries = spark.createDataFrame([("a", "apple apple banana"), ("b", "nothing"), ("c", "")], "query_id string, query string")
    found = {(q, p): s for q, p, s, *_ in rows(lexical.search(lexical.build(docs), queries).select("query_id", "page_id", "score"))}
    n, avgdl = 5, 6 / 5
    part = lambda tf, df, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert found == pytest.approx({("a", 1): 2 * part(2, 1, 3) + part(1, 2, 3), ("a", 2): part(1, 2, 2)}, abs=1e-8)
    every = lexical.get_scores(lexical.build(docs, method="okapi"), queries)
    assert every.count() == 15 and every.filter("score = 0").count() >= 10


def test_top_k_is_a_total_order(spark):
    hits = spark.createDataFrame([("q", i, 1.0) for i in range(10)], "query_id string, page_id long, score double")
    assert [r[1] for r in sorted(rows(lexical.top_k(hits, 3).select("rank", "page_id")))] == [0, 1, 2]


SYMBOLS = [("1", "Router", "app.Router", "class"), ("2", "route", "route", "import"), ("3", "add_route", "Router.add_route", "method"), ("4", "addXroute", "addXroute", "function"), ("5", "a\\b", "a\\b", "function")]


def test_symbol_lookup(spark):
    s = spark.createDataFrame(SYMBOLS, "symbol_id string, name string, qualified_name string, type string")
    ids = spark.createDataFrame([("q", "route"), ("q", "d_r"), ("q", "ROUTER"), ("q", "a\\b"), ("q", "zzz")], "query_id string, ident string")
    assert {r[1:] for r in rows(symbols.lookup(ids, s))} == {("route", "2"), ("a\\b", "5")}
    found = {(i, x): w for _, i, x, w in rows(symbols.exact_else_fuzzy(ids, s))}
    # an exact hit bars the fuzzy branch, even where the hit has no page; _ is a wildcard; case doesn't matter
    assert found == {("route", "2"): 1.0, ("a\\b", "5"): 1.0, ("d_r", "3"): 0.5, ("d_r", "4"): 0.5, ("ROUTER", "1"): 0.5, ("ROUTER", "3"): 0.5}
    pages = spark.createDataFrame([("p1", "1"), ("p3", "3")], "page_id string, symbol_id string")
    assert {r[1]: r[3] for r in rows(symbols.page_scores(symbols.exact_else_fuzzy(ids, s), pages).select("query_id", "page_id", "symbol_id", "score"))} == {"p1": 0.5, "p3": 1.0}


EDGES = [("a", "b", "CALLS", 1.0), ("b", "c", "CALLS", 1.0), ("c", "a", "CALLS", 1.0), ("x", "file", "DEFINED_IN", 0.5), ("y", "file", "DEFINED_IN", 0.5), ("b", "x", "USES_TYPE", 0.8)]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, type string, weight double")


def test_traversals(spark):
    ids = spark.createDataFrame([(x,) for x in "abcxy"], "id string")
    seeds = spark.createDataFrame([("q", "x"), ("q", "nowhere"), ("r", "a")], "query_id string, id string")
    found = sorted((q, r, i, d) for q, i, d, r in rows(graph.expand(seeds, edges(spark), ids, 2)))
    # the file is passed through but not returned; siblings lie at distance 2
    assert [f[1:] for f in found if f[0] == "q"] == [(0, "x", 0), (1, "b", 1), (2, "a", 2), (3, "c", 2), (4, "y", 2)]
    assert len(rows(graph.expand(seeds, edges(spark), ids, 2, 2))) == 4
    dist = {(s, i): d for s, i, d in rows(graph.shortest(spark.createDataFrame([("x",)], "seed string"), edges(spark), 2))}
    assert dist == {("x", "x"): 0, ("x", "file"): 1, ("x", "b"): 1, ("x", "a"): 2}
    nodes = spark.createDataFrame([(x, x.upper()) for x in "abcxy"], "id string, name string")
    chain = {r[1:4] for r in rows(graph.call_chain(edges(spark), nodes, spark.createDataFrame([("a",)], "id string"), 3))}
    assert chain == {("A", "CALLS", "B"), ("B", "CALLS", "C"), ("C", "CALLS", "A")}
    one = spark.createDataFrame([("b",)], "id string")
    assert rows(graph.callers(edges(spark), ids, one)) == [("b", "a")] and rows(graph.callees(edges(spark), ids, one)) == [("b", "c")]


def test_pagerank_converges_and_sums_to_one(spark):
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "c", "x", "y", "file", "alone")], "id string")
    found = dict(rows(graph.pagerank(nodes, edges(spark))))
    assert sum(found.values()) == pytest.approx(1) and found["alone"] == min(found.values()) and found["file"] > found["x"]
    assert rows(graph.pagerank(nodes.limit(0), edges(spark).limit(0))) == []


def test_pushed_residuals(spark, monkeypatch):
    r = random.Random(3)
    some = [(f"n{r.randrange(200)}", f"n{int(200 * r.random() ** 3)}", "CALLS", r.choice([0.5, 1.0])) for _ in range(500)]
    edges_ = spark.createDataFrame(list({x[:2]: x for x in some}.values()), "src string, dst string, type string, weight double")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(210)], "id string")
    w = np.zeros((210, 210))
    for src, dst, _, weight in rows(edges_):
        w[int(src[1:]), int(dst[1:])] = weight
    out, x = w.sum(1), np.full(210, 1 / 210)
    for _ in range(200):
        x = 0.85 * ((x / np.where(out > 0, out, 1) * (out > 0)) @ w + x[out == 0].sum() / 210) + 0.15 / 210
    want = {f"n{i}": v for i, v in enumerate(x.tolist())}
    sizes = []

    def counting(df, name, keep=False, real=graph.materialize):
        out = real(df, name, keep)
        if name == "flow":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counting)
    found = dict(rows(graph.pagerank_push(nodes, edges_, tolerance=0.05)))
    assert sum(found.values()) == pytest.approx(1) and found == pytest.approx(want, abs=5e-3)
    assert len(sizes) > 5 and sizes[-1] < sizes[0]  # what moves gets less
    monkeypatch.setattr(graph, "BROADCAST_FLOWS", 0)
    assert dict(rows(graph.pagerank_push(nodes, edges_, tolerance=0.5))) == pytest.approx(want, abs=5e-2)
    assert rows(graph.pagerank_push(nodes.limit(0), edges_)) == []


def test_packing_looks_at_few_pages(spark, monkeypatch):
    page = "query_id string, rank int, file_path string, line_start int, line_end int, signature string, docstring string, language string, source_code string, calls array<string>"
    ranked = [("a", i, f"f{i}", 1, 2, None, "d" * (i % 30), "python", "x" * (i * 7 % 90), []) for i in range(300)]
    ranked += [("b", i, None if i % 3 else "g", 1, 2, None, None, None, None if i % 2 else "y", []) for i in range(300)] + [("c", 0, "h", 1, 2, None, None, None, "z" * 5000, ["k"])]
    df = spark.createDataFrame(ranked, page).repartition(4)
    cut = context.pack(df, 150).orderBy("query_id").collect()
    monkeypatch.setattr(context, "LEAST", 0.001)  # nothing is left out before
    assert cut == context.pack(df, 150).orderBy("query_id").collect()
    assert all(x.n_tokens <= 150 for x in cut)
    monkeypatch.undo()
    plan = context.pack(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_nodes_out_of_reach_stay_ranked_with_zero(spark):
    near = spark.createDataFrame([("q", "x", 0, 0), ("q", "y", 2, 1)], "query_id string, id string, dist int, rank int")
    dist = spark.createDataFrame([("x", "x", 0)], "seed string, id string, dist int")
    ranks = spark.createDataFrame([("x", 0.1)], "id string, rank double")
    pages = spark.createDataFrame([("px", "x"), ("py", "y")], "page_id string, symbol_id string")
    found = graph.proximity(near, spark.createDataFrame([("q", "x")], "query_id string, id string"), dist, ranks, pages)
    assert {r[1]: r[2] for r in rows(found)} == {"px": pytest.approx(11.0), "py": 0.0}


def test_communities_of_two_cliques(spark):
    pairs = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)] + [("a0", "b0"), ("z0", "z1")]
    found = dict(rows(communities.communities(spark.createDataFrame(pairs, "src string, dst string"))))
    assert Counter(found.values()) == {"a0": 5, "b0": 5, "z0": 2}


def planted(n, groups, inside, outside, seed):
    r = random.Random(seed)
    return [(f"v{i:03d}", f"v{j:03d}") for i in range(n) for j in range(i) if r.random() < (inside if i % groups == j % groups else outside)]


STAR = [("hub", f"x{i:02d}") for i in range(40)] + [(f"x{i:02d}", f"y{i % 4}") for i in range(40)]


@pytest.mark.parametrize("final_edges,pairs", [(50_000, STAR), (50_000, planted(90, 5, 0.2, 0.03, 2)), (0, planted(120, 6, 0.35, 0.01, 1))])
def test_communities_are_as_good_as_greedy_merges(spark, final_edges, pairs):
    """Within 2 % of the modularity; with no edges left to one task, local moving has to do it alone."""
    edges_ = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:5]], "src string, dst string")
    merged = communities.greedy_merges([(a, b, 1.0) for a, b in sorted({tuple(sorted(p)) for p in pairs})], 2.0 * len(pairs))
    best = communities.modularity(edges_, spark.createDataFrame(list(merged.items()), "id string, community string"))
    found = communities.communities(edges_, final_edges)
    assert communities.modularity(edges_, found) >= 0.98 * best
    got = dict(rows(found))
    assert set(got) == {x for p in pairs for x in p}
    assert all(c == min(i for i in got if got[i] == c) for c in set(got.values()))


def test_communities_of_loops_nulls_and_nothing(spark):
    schema = "src string, dst string"
    assert rows(communities.communities(spark.createDataFrame([], schema))) == []
    found = dict(rows(communities.communities(spark.createDataFrame([("a", "a"), ("b", "c"), (None, "d"), ("e", None)], schema))))
    assert found == {"a": "a", "b": "b", "c": "b"}


def test_vectors_and_embedding(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "page_id long, embedding array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>")
    assert [(r[0], round(r[1], 6)) for r in rows(vector.knn(v, q, 4).orderBy("rank").select("page_id", "score"))] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, -1.0)]
    assert vector.knn(v, q, 4, clamp=True).filter("score < 0").count() == 0

    class Fails:
        dimension = 2

        def __call__(self, texts):
            if "bad" in texts or len(texts) > 2:
                raise RuntimeError
            return [[1.0, float(len(t))] for t in texts]

    assert vector.safe_embed(Fails(), ["a", "bad", "ccc"], 2) == [[1.0, 1.0], [0.0, 0.0], [1.0, 3.0]]
    pages = spark.createDataFrame([(1, "x" * 7000), (2, None)], "page_id long, text string")
    assert dict(rows(vector.embed(pages, Fails()))) == {1: [1.0, 6000.0], 2: [1.0, 0.0]}


def test_fusion(spark):
    schema = "query_id string, page_id string, rank int"
    a, b = spark.createDataFrame([("q", "x", 0), ("q", "y", 1)], schema), spark.createDataFrame([("q", "y", 0)], schema)
    assert rows(fusion.fuse([a, b], 5).orderBy("rank").select("page_id", "score")) == [("y", round(1 / 61 + 1 / 62, 9)), ("x", round(1 / 61, 9))]
    idents = spark.createDataFrame([("q", [])], "query_id string, idents array<string>")
    # without identifiers symbols weigh nothing, so what only they found goes
    assert rows(fusion.fuse_weighted(a.limit(0), b, a, idents, 5).select("page_id", "score").orderBy("score")) == [("y", round(0.4 / 62, 9)), ("x", round(0.4 / 61, 9))]


def test_context_budget(spark):
    schema = "query_id string, rank int, file_path string, line_start int, line_end int, signature string, docstring string, calls array<string>, language string, source_code string"
    page = lambda r, code, doc=None: ("q", r, "f.py", 1, 2, "def f()", doc, ["g", "h"], None, code)
    df = spark.createDataFrame([page(0, "x" * 80, "d" * 300), page(1, "y" * 4000), page(2, "z")], schema)
    text, n, tokens = context.pack(df, 200).select("context", "n_pages", "n_tokens").first()
    assert n == 2 and text.startswith("### [1] f.py:1-2\n**Signature:** `def f()`\n**Docstring:** " + "d" * 200 + "\n```python\nxx") and "**Calls:** g, h" in text.split("\n\n")[1] and "zzz" not in text
    assert tokens <= 200 and context.pack(df, 0).first().n_pages == 3
    assert context.pack(df, 1).select("context", "n_pages").first()[:] == ("", 0)


def test_summary_by_hand(spark):
    data = [("m", [str(i)], [str(i)] if i % 2 else ["no"], float(i)) for i in range(20)]
    r = evaluate.summarize(spark.createDataFrame(data, "method string, found array<string>, relevant array<string>, latency_ms double")).first()
    assert (r.queries, r.recall_5, r.mrr, r.mean_ms, r.p95_ms) == (20, 0.5, 0.5, 9.5, 19.0)


def test_providers(spark):
    prompts = spark.createDataFrame([("a", "one two"), ("b", "fail")], "query_id string, prompt string")

    class Flaky:
        def __call__(self, prompt, system, temperature, max_tokens):
            if prompt == "fail":
                raise RuntimeError("no model")
            return providers.Answer('{"keywords": ["Alpha"], "expected_symbols": ["Beta"]}', 3, 4)

    found = {r.query_id: r for r in providers.ask(prompts, Flaky()).collect()}
    assert found["b"].error and "no model" in found["b"].content and not found["a"].error
    assert providers.usage(providers.ask(prompts, Flaky())).first()[:] == (2, 3, 4, 7)
    q = spark.createDataFrame([("1", "Find it"), ("2", "Find it")], "query_id string, query string")
    expanded = providers.expand(q, Flaky()).collect()
    assert all(sorted(r.keywords) == ["alpha", "find", "it"] and r.idents == ["Beta"] for r in expanded) and len(expanded) == 2
    assert providers.expand(q).first().search == "find Find it"
    assert spark.range(1).select(providers.fill('{{"a": {x}}}', x=F.lit("1"))).first()[0] == '{"a": 1}'


def test_hybrid_fuses_its_three_lists(spark):
    names = ["alpha", "beta", "gamma", "delta"]
    s = [(f"s{i}", n, n, "function", "f.py", i) for i, n in enumerate(names)]
    sym = spark.createDataFrame(s, "symbol_id string, name string, qualified_name string, type string, file_path string, ord long")
    pages = sym.select(F.concat(F.lit("p"), "symbol_id").alias("page_id"), "symbol_id", F.col("name").alias("text"))
    e = spark.createDataFrame([("s0", "s1", "CALLS", 1.0), ("s1", "s2", "CALLS", 1.0)], "src string, dst string, type string, weight double")
    vectors = spark.createDataFrame([(f"ps{i}", [float(i == 3), float(i == 2)]) for i in range(4)], "page_id string, embedding array<float>")
    index = Index(sym, pages, sym.select(F.col("symbol_id").alias("id")), e, spark.createDataFrame([], "id string, rank double"), lexical.build(pages), vectors)
    q = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    qv = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, embedding array<float>")
    found = retrievers.HybridRetriever(index).retrieve(q, 2, qv).orderBy("rank")
    # vectors: ps3, ps2; words: ps0; graph from s3, s2 and the named s0: s0, s2, s3 at 0, s1 at 1
    want = Counter()
    for pages_ in (["ps3", "ps2"], ["ps0"], ["ps0", "ps2", "ps3", "ps1"]):
        for r, p in enumerate(pages_):
            want[p] += 1 / (61 + r)
    best = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:2]
    assert [(r.page_id, r.score) for r in found.collect()] == [(p, round(v, 9)) for p, v in best]


def test_names_by_an_index(spark):
    names = ["Route", "ro", "R", "é_1", "a\\b", "xaby", "x%y", "", None, "add_route", "Zed"]
    s = spark.createDataFrame([(str(i), n, None if i % 3 == 0 else f"pkg.{n}" if n is not None else None, "class") for i, n in enumerate(names)], "symbol_id string, name string, qualified_name string, type string")
    asked = ["r", "RO", "o_t", "_", "__", "%", "", "é", "\\", "a\\", "x%y", "_%_", "zzz", "_____", "k.R", None]
    ids = spark.createDataFrame([(a,) for a in asked], "ident string")
    index = symbols.name_index(s)
    found = sorted(map(tuple, symbols.named(s, ids, index).collect()), key=str)
    every = s.select("name", "qualified_name").distinct().join(ids, symbols.like(F.col("name"), F.col("ident")) | symbols.like(F.col("qualified_name"), F.col("ident")))
    assert found == sorted(map(tuple, every.select("ident", "name", "qualified_name").collect()), key=str) and len(found) > 60
    plan = symbols.named(s, ids.filter("ident LIKE '%r%'"), index)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    assert symbols.named(s.limit(0), ids).count() == 0 and symbols.named(s, ids.limit(0), index).count() == 0


def test_relevant_items_are_listed_as_far_as_they_were_found(spark):
    """The plan of the metrics joins labels to what was found: no row or list grows with a label."""
    import os

    from corvane.plans import queries_text

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    assert queries_text._found(spark, folder).agg(F.max(F.size("relevant"))).first()[0] <= 21


@pytest.mark.parametrize("method", ["lucene", "okapi"])
def test_neither_postings_nor_pairs_are_sent_by_a_search(spark, monkeypatch, method):
    """Blocks of queries, tiles and batches give the rows of a plain sum over all postings."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randrange(1, 30)))) for i in range(300)] + [(900, None), (901, "")], "page_id long, text string").repartition(4)
    queries = spark.createDataFrame([(i, " ".join(r.choices([*words, "unknown"], k=5))) for i in range(30)] + [(90, ""), (91, "unknown")], "query_id long, query string")
    index = lexical.build(docs, method=method)
    terms = lexical.query_terms(queries, index.tokenizer)
    every = index.postings.join(terms, "term").crossJoin(index.corpus).groupBy("query_id", "page_id").agg(F.round(F.sum(lexical.contribution(method) * F.col("times")), 9).alias("score"))
    want = {(x.query_id, x["rank"]): (x.page_id, pytest.approx(x.score, abs=1e-8)) for x in lexical.top_k(every.filter("score > 0"), 7).collect()}
    for block, tile in ((100_000, 1_000_000), (25, 40)):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
        monkeypatch.setattr(lexical, "TILE_SCORES", tile)
        found = lexical.search(index, queries, 7)
        assert {(x.query_id, x["rank"]): (x.page_id, x.score) for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan
    if method == "okapi":
        scores = {(x.query_id, x.page_id): x.score for x in lexical.get_scores(index, queries).collect()}
        assert len(scores) == 32 * 302 and all(scores[x.query_id, x.page_id] == pytest.approx(x.score, abs=1e-8) for x in every.collect())
