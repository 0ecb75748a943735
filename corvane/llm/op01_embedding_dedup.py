"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of at least t have a squared distance of at most
2 - 2t. They are turned by a fixed random rotation and split into blocks of
dimensions. Of two vectors in range, some block has a squared distance of at
most its share of the budget (block dimensions over all dimensions): if every
block were above, the sum would be. So each block is range-joined under its
share, and the union of what is found is verified by the cosine in double
precision. A pair is counted in the first block whose share it keeps, so it
counts once and no list of pairs is ever shuffled.

A task gets vectors of a few labels (or two slices of one large label), once
for all blocks. For each block it sorts them by the block's first coordinate,
which lets it compare a vector only with those that are near in it, tests the
block's distance for these, and verifies. It passes on link counts and a
spanning forest. A vector is sent to as many tasks as its label has slices.

Equal vectors of a label are one class from the start: a thousand copies cost
as much as one vector.

Defined results
* null, empty and zero vectors and those with null or non-finite components
  link with nothing, nor does a null label; they are returned as their own components;
* vectors of different lengths never link;
* repeated rows of an id are vectors like any other; a null id is returned and
  counts as a link of others, its component is the smallest id that it reaches;
* an empty table gives an empty result;
* ``n_links``, ``component_id`` and ``kept`` replace input columns of these names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import materialize

from . import common
from .components import Forest, components

THRESHOLD = 0.93
BLOCKS = 8
#: Vectors of a label in one task; larger labels are cut into slices, and each pair of slices is a task. Slices have
#: this size up to MANY of them, then they grow up to LARGE, so that fewer copies are sent.
SLICE, MANY, LARGE = 2048, 16, 32768
#: Vectors for each partition of the tasks, and partitions at most.
PART_VECTORS, MOST_PARTS = 2048, 20_000
#: Pairs whose block distance is worked out at a time.
PAIRS = 1 << 20
SEED = 20240229


@lru_cache(maxsize=8)
def rotation(n: int) -> np.ndarray:
    """A fixed random rotation of n dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def block_bounds(n: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    cuts = np.linspace(0, n, min(blocks, n) + 1).round().astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _range_join(raw: np.ndarray, side: np.ndarray, threshold: float, blocks: int):
    """Index pairs that link, each once. side: 0 and 1 pair up; 2 pairs with itself."""
    n, dims = raw.shape
    x = _unit(raw)
    y = x @ rotation(dims)
    bounds = block_bounds(dims, blocks)
    budget = 2 - 2 * threshold + 1e-9  # above what rounding can add
    shares = np.array([budget * (hi - lo) / dims for lo, hi in bounds])
    edges = np.array([lo for lo, _ in bounds])
    within = bool((side == 2).all())
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for block, (lo, hi) in enumerate(bounds):
        l, r = left[np.argsort(y[left, lo], kind="stable")], right[np.argsort(y[right, lo], kind="stable")]
        zl, zr, first, other = y[l, lo:hi].astype(np.float32), y[r, lo:hi].astype(np.float32), y[l, lo], y[r, lo]
        # single precision lets a little more through; what counts is worked out below
        slack = np.float32(shares[block] / 4 + 1e-5)
        hl, hr = (zl * zl).sum(1) / 2 - slack, (zr * zr).sum(1) / 2 - slack
        radius = np.sqrt(shares[block])
        begin = np.arange(len(l)) if within else np.searchsorted(other, first - radius, side="left")
        until = np.searchsorted(other, first + radius, side="right")  # partners stand in [begin, until)
        i = 0
        while i < len(l):
            j = min(len(l), i + max(1, PAIRS // max(1, int(until[i] - begin[i]))))
            start, end = int(begin[i]), int(until[j - 1])
            a, b = np.nonzero(zl[i:j] @ zr[start:end].T >= hl[i:j, None] + hr[None, start:end])
            if within:
                a, b = a[b > a], b[b > a]
            a, b = l[a + i], r[b + start]
            for k in range(0, len(a), PAIRS // 8):
                p, q = a[k : k + PAIRS // 8], b[k : k + PAIRS // 8]
                linked = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[linked], q[linked]
                if len(p):  # the first block whose share a pair keeps has it
                    kept = np.add.reduceat((y[p] - y[q]) ** 2, edges, axis=1) <= shares + 1e-9
                    mine = kept.argmax(1) == block
                    if mine.any():
                        yield p[mine], q[mine]
            i = j


def _work(threshold: float, blocks: int):
    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(["label", "dims"], sort=False):
            if len(part) < 2:
                continue
            raw = np.stack(part["v"].to_numpy()).astype(np.float64)
            node, size, side = part["node"].to_numpy(), part["size"].to_numpy(), part["side"].to_numpy()
            count, forest, edges = np.zeros(len(part), dtype=np.int64), Forest(), []
            for p, q in _range_join(raw, side, threshold, blocks):
                np.add.at(count, p, size[q])
                np.add.at(count, q, size[p])
                edges += [(node[a], node[b]) for a, b in zip(p.tolist(), q.tolist(), strict=True) if forest.join(a, b)]
            some = np.flatnonzero(count)
            out.append(pd.DataFrame({"node": node[some], "n": count[some], "a": None, "b": None}))
            if edges:
                a, b = zip(*edges, strict=True)
                out.append(pd.DataFrame({"node": None, "n": None, "a": a, "b": b}))
        out = [o for o in out if len(o)]
        found = pd.concat(out) if out else pd.DataFrame({"node": [], "n": [], "a": [], "b": []})
        return found.astype({"n": "Int64", "node": object, "a": object, "b": object})

    return work


def near_duplicates(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    common.check_columns(vectors, vec, embedding, label)
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"  # half the bytes, turned into doubles where they are used
    v = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec).alias("vec_id"), v.alias("v"), F.col(label).cast("string").alias("label"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # a node for each distinct vector of a label
    keyed = rows.withColumn("key", F.when(F.col("usable"), F.md5(F.concat_ws("|", "label", F.array_join(F.transform("v", lambda c: (c + F.lit(0.0)).cast("string")), ",")))))
    keyed = materialize(keyed.select("vec_id", "usable", "key", "label", F.when(F.col("usable"), F.col("v")).alias("v")), "vectors")
    classes = keyed.filter("usable").groupBy("key").agg(F.count("*").alias("size"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("node", F.col("key")), "classes")
    counts = classes.groupBy("label").agg(F.count("*").alias("in_label"))
    slices = F.least(F.ceil(F.col("in_label") / SLICE), F.greatest(F.lit(MANY), F.ceil(F.col("in_label") / LARGE)))
    tasks = classes.join(counts, "label").withColumn("slices", slices.cast("int"))
    total = counts.agg(F.coalesce(F.sum("in_label"), F.lit(0)).alias("n")).first()["n"]
    shared = max(1, 2 * total // SLICE)  # small labels share tasks
    mine = F.when(F.col("slices") > 1, F.pmod(F.xxhash64("key"), F.col("slices"))).otherwise(F.lit(0)).cast("int")
    bucket = F.when(F.col("slices") > 1, F.concat(F.lit("="), F.col("label"))).otherwise(F.pmod(F.xxhash64("label"), F.lit(shared)).cast("string"))
    tasks = tasks.withColumn("mine", mine).withColumn("bucket", bucket)
    # a row goes to every pair of slices that holds its own; equal slices pair within themselves
    pair = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda o: F.struct(
            F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j"),
            F.when(o == F.col("mine"), F.lit(2)).when(o > F.col("mine"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )
    tasks = tasks.select("bucket", "label", F.size("v").alias("dims"), "node", "size", "v", F.explode(pair).alias("p"))
    tasks = tasks.select(F.concat_ws(":", "bucket", "p.i").alias("left"), F.col("p.j").cast("string").alias("right"), "label", "dims", "node", "size", "v", F.col("p.side").alias("side"))
    # few bytes make much work: the number of partitions is set, or they would be joined for their small size
    tasks = tasks.repartition(min(MOST_PARTS, max(1, total // PART_VECTORS)), "left", "right")
    found = tasks.groupBy("left", "right").applyInPandas(_work(threshold, blocks), "node string, n long, a string, b string")
    found = materialize(found, "embedding-links")
    links = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.filter("a IS NOT NULL").select("a", "b"))
    nodes = classes.select("key", "node", "size", "first").join(links, "node", "left").join(parts, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("component", "node"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    nodes = nodes.join(least, "root").select("key", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "key").join(nodes, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs, with the cosine from sums in double precision.
OP1_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings),
ok AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS ai, b.vec_id AS bi FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {THRESHOLD}),
reach AS (SELECT r AS s, r AS t FROM v UNION SELECT s, b FROM reach JOIN links ON a = t),
comp AS (SELECT s, min(vec_id) AS component_id FROM reach JOIN v ON r = t GROUP BY s),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON s = r LEFT JOIN n ON a = r
"""

QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLE_SQL = {"op1_embedding_dedup": OP1_SQL}
