"""The three retrieval strategies, for all queries at once.

Each takes queries (query_id, query) and returns (query_id, page_id, rank,
score, source); pages are joined only to what is left at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import ann, fusion, graph, lexical, symbols, vector
from corvane.sources.store import Index
from corvane.storage import beside, materialize

from . import providers


@dataclass(frozen=True)
class Settings:
    top_k: int = 10
    graph_depth: int = 2
    seeds: int = 10
    bm25_factor: int = 5


class Retriever(Protocol):
    name: str

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


def _symbol_ids(index: Index) -> DataFrame:
    return index.symbols.select(F.col("symbol_id").alias("id"))


class VectorRetriever:
    """Nearest vectors: exact ones, or by an approximate index (``ann.build`` of the index's embeddings) where one is given."""

    name = "vector"

    def __init__(self, index: Index, embedder: vector.Embedder, clamp: bool = True, approximate: ann.Index | None = None) -> None:
        self.index, self.embedder, self.clamp, self.approximate = index, embedder, clamp, approximate

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        return vector.embed(queries, self.embedder, "query_id", "query")

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        if self.approximate is None:
            return vector.knn(self.index.embeddings, self.embed_queries(queries), k, self.clamp)
        hits = ann.search(self.approximate, self.embed_queries(queries), k)
        return hits.withColumn("score", F.greatest(F.lit(0.0), "score")) if self.clamp else hits


class VectorlessRetriever:
    """Symbols, BM25 and the graph, fused with weights."""

    name = "vectorless"

    def __init__(self, index: Index, settings: Settings = Settings(), provider: providers.Provider | None = None) -> None:  # noqa: B008
        self.index, self.settings, self.provider = index, settings, provider

    def lists(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(expanded queries, bm25, symbol and graph lists)."""
        s, x = self.settings, self.index
        expanded = materialize(providers.expand(queries, self.provider), "expanded")
        idents = expanded.select("query_id", F.explode(F.array_distinct("idents")).alias("ident"))
        hits = symbols.exact_else_fuzzy(idents, x.symbols, index=x.names)
        by_page = materialize(symbols.page_scores(hits, x.pages), "symbol-hits")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "page_id")
        by_page = by_page.withColumn("rank", F.row_number().over(order) - 1)
        bm25 = lexical.search(x.lexical, expanded.select("query_id", F.col("search").alias("query")), k * s.bm25_factor)
        seeds = materialize(by_page.filter(F.col("rank") < s.seeds).select("query_id", F.col("symbol_id").alias("id")), "seeds")
        near = graph.expand(seeds, x.edges, _symbol_ids(x), s.graph_depth, graph.MAX_NODES)
        dist = graph.shortest(seeds.select(F.col("id").alias("seed")).distinct(), x.edges, s.graph_depth, x.nodes)
        scores = graph.proximity(near, seeds, dist, x.pagerank, x.pages)
        ranked = scores.withColumn("rank", F.row_number().over(order) - 1)
        return expanded, bm25, by_page, ranked

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        expanded, bm25, by_symbol, by_graph = self.lists(queries, k)
        return fusion.fuse_weighted(bm25, by_symbol, by_graph, expanded, k).withColumn("source", F.lit(self.name))


class HybridRetriever:
    """Vectors, BM25 and the graph around vector hits and named symbols, fused evenly."""

    name = "hybrid"

    def __init__(self, index: Index, embedder: vector.Embedder | None = None, settings: Settings = Settings(), provider: providers.Provider | None = None) -> None:  # noqa: B008
        self.index, self.embedder, self.settings, self.provider = index, embedder, settings, provider

    def retrieve(self, queries: DataFrame, k: int = 10, vectors: DataFrame | None = None) -> DataFrame:
        """``vectors`` are ready query embeddings (query_id, embedding), else the embedder makes them."""
        s, x = self.settings, self.index
        vectors = vectors if vectors is not None else vector.embed(queries, self.embedder, "query_id", "query")
        by_vector = materialize(vector.knn(x.embeddings, vectors, k, True), "vector-hits")
        expanded = materialize(providers.expand(queries, self.provider), "expanded")
        idents = expanded.select("query_id", F.explode(F.array_distinct("idents")).alias("ident"))
        first = x.pages.select("page_id", F.col("symbol_id").alias("id")).join(beside(by_vector), "page_id").select("query_id", "id", F.col("rank").alias("o"))
        named = symbols.lookup(idents, x.symbols).select("query_id", F.col("symbol_id").alias("id"), F.lit(1 << 20).alias("o"))
        seeds = first.unionByName(named).groupBy("query_id", "id").agg(F.min("o").alias("o"))
        order = Window.partitionBy("query_id").orderBy("o", "id")
        seeds = seeds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= s.seeds).select("query_id", "id")
        near = materialize(graph.expand(seeds, x.edges, _symbol_ids(x), s.graph_depth, graph.HYBRID_MAX_NODES), "near")
        paged = x.pages.select("page_id", F.col("symbol_id").alias("id")).join(beside(near), "id")
        by_graph = paged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "page_id")) - 1)
        bm25 = lexical.search(x.lexical, expanded.select("query_id", F.col("search").alias("query")), k)
        return fusion.fuse([bm25, by_vector, by_graph], k).withColumn("source", F.lit(self.name))


def file_paths(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, file_path, first_rank): distinct files of a result in the order of their best page."""
    rows = hits.select("query_id", "page_id", "rank").join(pages.select("page_id", "file_path"), "page_id")
    return rows.groupBy("query_id", "file_path").agg(F.min("rank").alias("first_rank"))


def with_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    return hits.select("query_id", "page_id", "rank", "score").join(pages, "page_id")
