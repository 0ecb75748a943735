"""Approximate nearest neighbours: cells, inverted lists of quantised vectors, and an exact re-rank.

A model is fitted on a bounded sample: centroids of cells by spherical k-means,
and codebooks that quantise what is left of a vector beside its centroid, a
byte for each group of dimensions. An index holds every vector: its cell's list
has its id and its code, in blocks of a bounded size. A query looks into the
cells nearest to it; a task adds up table entries for the codes of its blocks
and keeps the best of each query; the best of all tasks are compared exactly.

How many cells a query looks into is calibrated on the sample: as many as hold
the share ``recall`` of the sample's own true neighbours. Vectors that are not
clustered need most cells, and say so by this number.

Defined results
* vectors without components or of another length than the model's are not in
  the index; zero vectors are in it, with the cosine 0 to all queries;
* repeated ids are vectors of their own in the lists; their exact scores are
  those of all vectors of that id, so an id may appear as often as it is indexed;
* fewer vectors than asked for give all that the cells hold; an empty table
  gives an empty index and empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import materialize

from .lexical import top_k
from .vector import Best, matrix, query_blocks, rerank, result_kinds

#: Vectors of the sample, cells at most, ids in a block of a list, and dimensions that share a byte.
SAMPLE, MOST_CELLS, LIST_BLOCK, GROUP = 32_768, 1024, 4096, 4
ROUNDS, CODES, SEED = 12, 256, 20240229
#: Sample vectors that the number of probes is calibrated with, and the share of their neighbours to be found.
CALIBRATION, RECALL = 512, 0.99
#: Candidates of a query that are compared exactly, times k.
RERANK = 20
#: Candidates (about 20 bytes each) are broadcast up to this number, counted first.
BROADCAST_PAIRS = 500_000


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray  # cells x dims
    codebooks: np.ndarray  # groups x codes x dims of a group
    probes: int

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T).argmax(1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = _grouped(x - self.centroids[cell], len(self.codebooks))
        return np.stack([_nearest(rest[g], self.codebooks[g]) for g in range(len(self.codebooks))], axis=1).astype(np.uint8)


@dataclass(frozen=True)
class Index:
    """lists(cell, members: ids and codes), vectors(page_id, embedding)."""

    model: Model | None
    lists: DataFrame
    vectors: DataFrame


def _grouped(x: np.ndarray, groups: int) -> np.ndarray:
    """groups x rows x dims of a group, the last ones filled up with zeros."""
    width = -(-x.shape[1] // groups)
    padded = np.zeros((len(x), groups * width))
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), groups, width).transpose(1, 0, 2)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centers * centers).sum(1) / 2
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = (x[i : i + 8192] @ centers.T - half).argmax(1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    centers = x[rng.permutation(len(x))[:k]].copy()
    if len(centers) < k:
        centers = np.concatenate([centers, np.zeros((k - len(centers), x.shape[1]))])
    for _ in range(ROUNDS):
        if spherical:
            own = np.concatenate([(x[i : i + 8192] @ centers.T).argmax(1) for i in range(0, len(x), 8192)])
        else:
            own = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if spherical:
            centers /= np.maximum(np.sqrt((centers * centers).sum(1, keepdims=True)), 1e-12)
    return centers


def fit(x: np.ndarray, cells: int, groups: int, recall: float = RECALL, k: int = 10) -> Model:
    """A model of unit vectors (the sample)."""
    rng = np.random.default_rng(SEED)
    centroids = _kmeans(x, cells, rng, True)
    own = np.concatenate([(x[i : i + 8192] @ centroids.T).argmax(1) for i in range(0, len(x), 8192)])
    rest = _grouped(x - centroids[own], groups)
    codebooks = np.stack([_kmeans(r, CODES, rng, False) for r in rest])
    # in which place of a query's cells its true neighbours lie
    asked = x[:CALIBRATION]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :].repeat(len(asked), 0), axis=1)
    at = np.take_along_axis(place, own[near], axis=1) if near.size else np.zeros(1, dtype=np.int64)
    probes = int(np.quantile(at, recall, method="higher")) + 1
    return Model(centroids, codebooks, probes)


def build(vectors: DataFrame, key: str = "page_id", cells: int | None = None, groups: int | None = None, recall: float = RECALL) -> Index:
    """The index of ``vectors`` (key, embedding). The sample is the vectors of the smallest hashes of their ids."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("page_id"), "embedding").filter("size(embedding) > 0")
    kind = vectors.schema[key].dataType.simpleString()
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).toArrow().combine_chunks()
    if not sample.num_rows:
        return Index(None, spark.createDataFrame([], f"cell int, members array<struct<id:{kind},code:binary>>"), rows)
    column = sample.column("embedding").chunk(0)
    lengths = np.diff(column.offsets.to_numpy())
    dims = int(np.bincount(lengths).argmax())
    x = matrix(column.filter(pa.array(lengths == dims)), dims)
    x = x[np.isfinite(x).all(1)]
    cells = cells or int(min(MOST_CELLS, max(1, round(count**0.5)), len(x)))
    model = fit(x, cells, groups or -(-dims // GROUP), recall)
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = matrix(batch.column(1), model.dims)
            good = np.isfinite(x).all(1)
            x = x[good]
            cell = model.cells(x)
            codes = model.codes(x, cell)
            ids = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), ids, pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "code"])

    placed = materialize(rows.filter(F.size("embedding") == dims).mapInArrow(work, f"cell int, id {kind}, code binary"), "codes")
    # lists of a cell are cut by a hash of the ids: no block grows with its cell
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"))  # one row a cell, MOST_CELLS or ``cells`` at most
    cut = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id", "code"), F.col("blocks")))
    lists = cut.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "code")).alias("members")).select("cell", "members")
    return Index(model, materialize(lists, "lists"), rows)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None, round_to: int = 9) -> DataFrame:
    """(query_id, page_id, score, rank, source): about the k best cosines of each query; the scores are exact."""
    spark = queries.sparkSession
    schema, kinds = result_kinds(index.vectors, queries, "page_id")
    found, model, most = None, index.model, candidates or RERANK * k
    for names, q in query_blocks(queries) if model is not None else ():
        if q.shape[1] != model.dims:
            raise ValueError(f"queries have {q.shape[1]} dimensions, the index has {model.dims}")
        near = np.argsort(-(q @ model.centroids.T), axis=1, kind="stable")[:, : probes or model.probes]
        asking = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}
        shared = spark.sparkContext.broadcast((model, names, q, asking))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, names, q, asking = shared.value
            best, groups = Best(len(names), most), len(model.codebooks)
            parts = _grouped(q, groups)
            for batch in batches:
                for cell, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    who = asking[cell]
                    members = members.values
                    codes = np.frombuffer(b"".join(members.field("code").to_pylist()), dtype=np.uint8).reshape(-1, groups)
                    scores = np.repeat((q[who] @ model.centroids[cell])[:, None], len(codes), axis=1)
                    for g in range(groups):
                        scores += (parts[g][who] @ model.codebooks[g].T)[:, codes[:, g]]
                    best.offer(who, scores, members.field("id").to_pylist())
            yield from best.rows(names, kinds)

        rows = index.lists.filter(F.col("cell").isin(list(asking))).mapInArrow(work, schema)
        rows = top_k(rows, most).select("query_id", "page_id")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], f"{schema}, rank int, source string")
    found = materialize(found, "candidates")
    if found.count() <= BROADCAST_PAIRS:
        found = F.broadcast(found)
    return rerank(found, index.vectors, queries, k, round_to=round_to)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact results' pairs (query_id, page_id) that are found."""
    true = exact.select("query_id", "page_id").distinct()
    hit = true.join(found.select("query_id", "page_id").distinct(), ["query_id", "page_id"], "left_semi").count()
    return hit / max(1, true.count())
