"""From a source folder to a saved index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import graph, lexical, pages, vector
from corvane.operators.symbols import name_index
from corvane.sources import extract, repository
from corvane.sources.store import Index
from corvane.storage import materialize


def index_of(symbols: DataFrame, files: DataFrame | None = None, embedder: vector.Embedder | None = None, method: str = "lucene") -> Index:
    symbols = materialize(pages.last_of(symbols, "symbol_id"), "symbols")
    page_table = materialize(pages.build(symbols, files), "pages")
    nodes = materialize(graph.nodes(symbols), "nodes")
    edges = materialize(graph.resolve_edges(symbols), "edges")
    text = page_table.select("page_id", pages.searchable_text().alias("text"))
    return Index(
        symbols, page_table, nodes, edges, graph.pagerank(nodes, edges), lexical.build(text, method=method),
        vector.embed(text, embedder) if embedder is not None else None, name_index(symbols),
    )


def ingest(spark: SparkSession, root: str, embedder: vector.Embedder | None = None, absolute: bool = False, method: str = "lucene") -> tuple[Index, DataFrame]:
    """(index, parse errors) of a repository folder."""
    files, symbols, errors = extract.ingest(materialize(repository.scan(spark, root, absolute), "files"))
    return index_of(symbols, files, embedder, method), errors


def summary(index: Index) -> DataFrame:
    """Rows by kind for the report after ingestion."""
    return graph.stats(index.nodes, index.edges).unionByName(index.pages.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("pages").alias("name"), "n"))
