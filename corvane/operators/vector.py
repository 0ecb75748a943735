"""Exact nearest neighbours by cosine as blocked products, set-wise over queries, and pluggable embedders."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions import vectors as V

from .best import TILE_QUERIES, Best
from .lexical import top_k

DIMENSION, BATCH, TEXT_CHARS = 768, 100, 6000
#: Query vectors are broadcast up to so many (8 bytes a dimension each); beyond, they come in blocks of this size.
QUERY_BLOCK = 4096
#: Vectors of one product with TILE_QUERIES queries (8 MB of scores), whatever the block and the batch.
TILE_VECTORS = 2048


class Embedder(Protocol):
    """Texts to vectors. An instance is sent to the executors, so it opens connections only when called."""

    dimension: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic vectors without a model: each word adds one, or takes one, at the place that its MD5 names.

    The first 15 hex digits name the place, the sixteenth the sign (8 and above: plus).
    """

    def __init__(self, dimension: int = DIMENSION) -> None:
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = hashlib.md5(word.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()
                out[i, int(h[:15], 16) % self.dimension] += 1.0 if h[15] >= "8" else -1.0
        return out.tolist()


class HttpEmbedder:
    """Vectors from a service: POST {"model", "input": [texts]}, answered by {"embeddings": [vectors]}."""

    def __init__(self, url: str, model: str, dimension: int = DIMENSION, timeout: float = 180.0) -> None:
        self.url, self.model, self.dimension, self.timeout = url, model, dimension, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return post_json(self.url, {"model": self.model, "input": texts}, self.timeout)["embeddings"]


def post_json(url: str, payload: dict, timeout: float) -> dict:
    """The JSON that a service answers; any status but success is an error."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def safe_embed(embed: Callable[[list[str]], list[list[float]]], texts: list[str], dimension: int) -> list[list[float]]:
    """Vectors for all texts: a batch that fails is halved, a text that fails alone gets a zero vector."""
    if not texts:
        return []
    try:
        found = embed(texts)
        if len(found) != len(texts):
            raise ValueError("the embedder returned another number of vectors")
        return found
    except Exception:  # noqa: BLE001 - a provider may fail in any way
        if len(texts) == 1:
            return [[0.0] * dimension]
        half = len(texts) // 2
        return safe_embed(embed, texts[:half], dimension) + safe_embed(embed, texts[half:], dimension)


def embed(pages: DataFrame, embedder: Embedder, key: str = "page_id", text: str = "text", batch: int = BATCH) -> DataFrame:
    """(key, embedding) of the first 6000 characters of each text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "embedding": safe_embed(embedder, [t or "" for t in part["__text"]], embedder.dimension)})

    kind = dict(pages.dtypes)[key]
    return pages.select(key, F.substring(F.col(text), 1, TEXT_CHARS).alias("__text")).mapInPandas(work, f"`{key}` {kind}, embedding array<float>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of ``dims`` components as rows, over their lengths plus a small constant; null components make NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), dims)
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + V.EPSILON)


def query_blocks(queries: DataFrame, size: int | None = None, by: str | None = None) -> Iterator[tuple]:
    """Ids and unit vectors of the queries, and their values of ``by``, at most about ``size`` at a time; those without a vector are left out."""
    rows = queries.select("query_id", "embedding", *([by] if by else [])).filter("size(embedding) > 0")
    count = rows.count()
    parts = -(-count // (size or QUERY_BLOCK))
    for i in range(parts):
        block = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        table = block.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        vectors = table.column("embedding").chunk(0)
        dims = set(pc.list_value_length(vectors).to_pylist())
        if len(dims) > 1:
            raise ValueError("the queries' vectors differ in length")
        yield table.column("query_id").to_pylist(), matrix(vectors, dims.pop()), *([table.column(by).to_pylist()] if by else [])


def _places(values: list) -> dict:
    """The places of each value, without nulls."""
    found: dict = {}
    for i, v in enumerate(values):
        if v is not None:
            found.setdefault(v, []).append(i)
    return {v: np.array(at) for v, at in found.items()}


def _compare(best: Best, q: np.ndarray, who: np.ndarray, x: np.ndarray, ids: list, clamp: bool, round_to: int) -> None:
    """Offers the cosines of the queries ``who`` and the vectors ``x``, by tiles of a bounded size."""
    for i in range(0, len(x), TILE_VECTORS):
        part, own = x[i : i + TILE_VECTORS].T, ids[i : i + TILE_VECTORS]
        for j in range(0, len(who), TILE_QUERIES):
            some = who[j : j + TILE_QUERIES]
            scores = q[some] @ part
            np.round(scores, round_to, out=scores)
            best.offer(some, np.maximum(scores, 0.0, out=scores) if clamp else scores, own)


def result_kinds(vectors: DataFrame, queries: DataFrame, key: str) -> tuple[str, list[pa.DataType]]:
    """The rows that tasks return, for Spark and for Arrow."""
    left, right = queries.schema["query_id"].dataType, vectors.schema[key].dataType
    return f"query_id {left.simpleString()}, page_id {right.simpleString()}, score double", [to_arrow_type(left), to_arrow_type(right), pa.float64()]


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, clamp: bool = False, key: str = "page_id", round_to: int = 9, by: str | None = None) -> DataFrame:
    """(query_id, page_id, score, rank, source): the k best cosines of each query against all vectors, or those with its value of ``by``.

    vectors: key, embedding. queries: query_id, embedding. The queries are the
    small, stated side: they are sent in blocks of a fixed size. A task
    multiplies its batches of vectors with a block as matrices and keeps the k
    best of each query, so no pair is ever a row: what tasks pass on is k rows a
    query each, and the k best of these are the result. Vectors without
    components, or of another length than the queries, are no neighbours. A
    null in ``by`` is the value of no other row.
    """
    schema, kinds = result_kinds(vectors, queries, key)
    spark, found = vectors.sparkSession, None
    for names, q, *values in query_blocks(queries, by=by):
        asking = _places(values[0]) if by else {0: np.arange(len(names))}
        shared = spark.sparkContext.broadcast((names, q, asking))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, asking = shared.value
            best = Best(len(names), k)
            for batch in batches:
                ids, x = batch.column(0).to_pylist(), matrix(batch.column(1), q.shape[1])
                if by is None:
                    _compare(best, q, asking[0], x, ids, clamp, round_to)
                    continue
                for value, at in _places(batch.column(2).to_pylist()).items():
                    if value in asking:
                        _compare(best, q, asking[value], x[at], [ids[i] for i in at.tolist()], clamp, round_to)
            yield from best.rows(names, kinds)

        same = vectors.select(F.col(key).alias("page_id"), "embedding", *([by] if by else [])).filter(F.size("embedding") == q.shape[1])
        rows = top_k(same.mapInArrow(work, schema).withColumn("score", F.round("score", round_to)), k)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], f"{schema}, rank int")
    return found.withColumn("source", F.lit("vector"))


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "page_id", round_to: int = 9) -> DataFrame:
    """(query_id, page_id, score, rank, source): the k best of the pairs (query_id, page_id) in ``candidates``, by the exact cosine."""
    v = vectors.select(F.col(key).alias("page_id"), V.normalize(F.col("embedding")).alias("v"))
    q = queries.select("query_id", V.normalize(F.col("embedding")).alias("q"))
    if q.count() <= QUERY_BLOCK:
        q = F.broadcast(q)
    rows = candidates.select("query_id", "page_id").distinct().join(v, "page_id").join(q, "query_id")
    rows = rows.select("query_id", "page_id", F.round(V.dot(F.col("v"), F.col("q")), round_to).alias("score"))
    return top_k(rows.filter("score IS NOT NULL"), k).withColumn("source", F.lit("vector"))


def get_scores(vectors: DataFrame, queries: DataFrame, k: int = 100, clamp: bool = True, key: str = "page_id") -> DataFrame:
    """(query_id, page_id, score) of the k best pages, for fusion."""
    return knn(vectors, queries, k, clamp, key).select("query_id", "page_id", "score")


#: The two ways that similarities are given: cut off at 0, or as they are. Both compare a query with all vectors.
BACKENDS = {"clamped": True, "plain": False}


def backend(name: str | None = None) -> bool:
    """Whether a backend of this name clamps; the first one where none is named, the other where the name is unknown."""
    return True if name is None else BACKENDS.get(name, False)
