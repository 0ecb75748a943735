"""Reciprocal rank fusion over any number of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import top_k

K = 60
#: Weights of the lists bm25, symbol and graph, with and without identifiers in the query.
WITH_IDENTIFIERS, WITHOUT_IDENTIFIERS = (0.2, 0.5, 0.5), (0.6, 0.0, 0.4)


def reciprocal_rank(lists: list[tuple[DataFrame, Column | float]], k: int = K) -> DataFrame:
    """(query_id, page_id, score) from lists with a rank from 0, each with a weight (a number, or a column of the list)."""
    parts = [hits.select("query_id", "page_id", ((F.lit(w) if not isinstance(w, Column) else w) / (F.col("rank") + (k + 1))).alias("part")) for hits, w in lists]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("query_id", "page_id").agg(F.round(F.sum("part"), 9).alias("score"))


def candidates(lists: list[DataFrame]) -> DataFrame:
    """(query_id, page_id) of all pages that any list has, once each."""
    return reduce(DataFrame.union, [hits.select("query_id", "page_id") for hits in lists]).distinct()


def fuse(lists: list[DataFrame], top: int, k: int = K) -> DataFrame:
    """The best pages of equally weighted lists."""
    return top_k(reciprocal_rank([(hits, 1.0) for hits in lists], k), top)


def fuse_weighted(bm25: DataFrame, symbol: DataFrame, graph: DataFrame, queries: DataFrame, top: int, k: int = K) -> DataFrame:
    """Weights depend on whether a query (columns query_id, idents) names identifiers; zero scores go."""
    some = queries.select("query_id", (F.size("idents") > 0).alias("some"))
    lists = []
    for hits, yes, no in zip((bm25, symbol, graph), WITH_IDENTIFIERS, WITHOUT_IDENTIFIERS, strict=True):
        lists.append((hits.select("query_id", "page_id", "rank").join(some, "query_id"), F.when(F.col("some"), yes).otherwise(no)))
    return top_k(reciprocal_rank(lists, k).filter("score > 0"), top)
