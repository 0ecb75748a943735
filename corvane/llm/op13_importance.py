"""Target-distribution importance resampling: draw the documents that look most like a target text.

Features are all runs of 1 to ``max_n`` words, hashed into buckets by crc32. Each
task feeds its texts to a DuckDB of its own, in slices of bounded size: SQL
splits and unnests the words, lays the windows, and groups the buckets, with
zlib's CRC as a registered function. The bucket counts of every document and
the sums of every task are spilled to Parquet in the shared folder; Spark
merges the sums, a bucket's gain is the logarithm of how much more often the
target has it, and a document's weight is the sum of the gains of its features.
A fixed pseudo-random number per id (Gumbel) makes the draw a sample without
replacement that reruns repeat.

A window's CRC is put together from those of its words: appending n bytes to a
text is a linear step on its CRC, so each word is hashed once and no joined
text is made for its windows.

Ranks come from one range sort and the partitions' offsets, so no task holds
all scores.

Defined results
* words are runs of digits, letters and all that is not ASCII, A-Z lower-cased;
  a null or empty text has none: no features, weight 0, never drawn;
* whole texts are counted, however long: a long one is worked through in slices
  that look ahead by ``max_n`` - 1 words;
* a null id stands in the hash as nothing (``42:``), and is the smallest in ties;
* repeated rows are documents of their own; equal ids and scores are ranked in
  any order, with distinct ranks; ``draw`` returns all rows of a drawn id and text;
* an empty target or table gives no error: T or S is 0;
* other columns stay out, whatever their names; ``draw`` returns them as they are.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import arrow_rows, materialize

from . import common

BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text in one DuckDB statement, about; rows of an Arrow batch; DuckDB's memory.
SLICE_BYTES, BATCH_ROWS, DUCKDB_MEMORY = 1024 * 1024, 128, "400MB"
#: All that is no word, as a class of a regular expression.
OUTSIDE = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same before A-Z are lower-cased.
RAW_OUTSIDE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Drawn documents (16 bytes each) are broadcast up to this number, counted first.
BROADCAST_ROWS = 1_000_000

COUNTS = "total boolean, doc_id long, text_hash long, row long, n_words long, buckets array<int>, counts array<long>"
SCORES = "doc_id long, text_hash long, row long, n_words long, n_features long, weight long, score long"


@functools.cache
def _steps() -> np.ndarray:
    """What one zero byte does to a CRC, by its lowest byte (the table of the polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


@functools.lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """The linear step of ``n`` appended bytes on a CRC, as four tables by byte."""
    if n == 0:
        return np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)], dtype=np.uint32)
    if n == 1:
        c = _shift(0)
        return _steps()[c & 255] ^ (c >> 8)
    half = _shift(n // 2)
    c = _apply(half, half)
    return _apply(_shift(1), c) if n % 2 else c


def appended(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs of texts joined by a space: of the left ones, of the right ones, and the right ones' lengths in bytes."""
    out = np.empty(len(left), dtype=np.uint32)
    lengths, place = np.unique(n, return_inverse=True)
    if len(lengths) <= 64:
        tables = np.stack([_shift(int(k)) for k in lengths]).reshape(-1)
        c = _apply(_shift(1), left) ^ np.uint32(zlib.crc32(b" "))
        at = place.astype(np.int64) * 1024
        out = tables[at + (c & 255)] ^ tables[at + 256 + ((c >> 8) & 255)] ^ tables[at + 512 + ((c >> 16) & 255)] ^ tables[at + 768 + (c >> 24)]
        return out ^ right
    for k, length in enumerate(lengths):
        own = place == k
        c = _apply(_shift(1), left[own]) ^ np.uint32(zlib.crc32(b" "))
        out[own] = _apply(_shift(int(length)), c) ^ right[own]
    return out


def _zlib_crc(words: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(w.encode()) for w in words.to_numpy(zero_copy_only=False)], pa.uint32())


def _append_crc(left: pa.Array, right: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array(appended(left.to_numpy(zero_copy_only=False), right.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)))


def _statement(buckets: int, max_n: int) -> str:
    """Bucket counts of the rows of ``t``: rid, own (the text), ahead (what follows it, for windows that reach over)."""
    split = f"regexp_extract_all(translate({{}}, '{common.UPPER}', '{common.LOWER}'), '[^{OUTSIDE}]+')"
    shifted = ", ".join(f"unnest(ws[{k}:]) AS w{k}" for k in range(1, max_n + 1))
    words = ", ".join(f"coalesce(w{k}, '') AS w{k}" for k in range(1, max_n + 1))
    crcs = [", ".join(f"zlib_crc(w{k}) AS c{k}, octet_length(encode(w{k}))::UINTEGER AS n{k}" for k in range(1, max_n + 1))]
    steps, before = [], "h"
    for k in range(2, max_n + 1):
        steps.append(f"s{k} AS (SELECT *, append_crc(g{k - 1}, c{k}, n{k}) AS g{k} FROM {'c' if k == 2 else f's{k - 1}'})")
        before = f"s{k}"
    if max_n == 1:
        before = "c"
    grams = ", ".join(f"CASE WHEN n{k} > 0 THEN (g{k} % {buckets})::INTEGER END" for k in range(1, max_n + 1))
    return f"""
    WITH l AS (SELECT rid, {split.format('own')} AS mine, {split.format('ahead')}[:{max_n - 1}] AS next FROM t),
    u AS (SELECT rid, unnest(range(1, len(mine) + len(next) + 1)) AS i, len(mine) AS n, {shifted} FROM (SELECT *, mine || next AS ws FROM l)),
    w AS (SELECT rid, {words} FROM u WHERE i <= n),
    h AS (SELECT rid, {crcs[0]} FROM w),
    c AS (SELECT *, c1 AS g1 FROM h){''.join(', ' + s for s in steps)},
    b AS (SELECT rid, unnest([{grams}]) AS bucket FROM {before})
    SELECT rid, bucket, count(*)::BIGINT AS n FROM b WHERE bucket IS NOT NULL GROUP BY ALL ORDER BY ALL
    """


def _slices(text: str, size: int, look: int) -> Iterator[tuple[str, str]]:
    """(text, what follows it) of at most about ``size`` characters, cut between words."""
    if len(text) <= size:
        yield text, ""
        return
    gap, word = re.compile(f"[{RAW_OUTSIDE}]"), re.compile(f"[^{RAW_OUTSIDE}]+")
    place = 0
    while place < len(text):
        found = gap.search(text, place + size) if place + size < len(text) else None
        end = found.start() if found else len(text)
        ahead, until = end, end
        for _ in range(look):
            found = word.search(text, until)
            if not found:
                break
            until = found.end()
        yield text[place:end], text[ahead:until]
        place = end


class _Counter:
    """A task's DuckDB."""

    def __init__(self, buckets: int, max_n: int) -> None:
        import duckdb

        # nothing is spilled to the machine's own disk: slices are small
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self.duck.create_function("zlib_crc", _zlib_crc, ["VARCHAR"], "UINTEGER", type="arrow")
        if max_n > 1:
            self.duck.create_function("append_crc", _append_crc, ["UINTEGER", "UINTEGER", "UINTEGER"], "UINTEGER", type="arrow")
        self.sql, self.buckets, self.look = _statement(buckets, max_n), buckets, max_n - 1

    def run(self, rids: list[int], own: list[str], ahead: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.duck.register("t", pa.table({"rid": pa.array(rids, pa.int32()), "own": pa.array(own, pa.string()), "ahead": pa.array(ahead, pa.string())}))
        out = self.duck.sql(self.sql).to_arrow_table()
        self.duck.unregister("t")
        return tuple(out.column(c).to_numpy() for c in ("rid", "bucket", "n"))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, bucket, count), sorted by both; each pair once."""
        parts, rids, own, ahead, size = [], [], [], [], 0
        cut = False
        for i, text in enumerate(texts):
            for k, (a, b) in enumerate(_slices(text, SLICE_BYTES, self.look)):
                cut |= k > 0
                rids.append(i), own.append(a), ahead.append(b)
                size += len(a)
                if size >= SLICE_BYTES:
                    parts.append(self.run(rids, own, ahead))
                    rids, own, ahead, size = [], [], [], 0
        if rids:
            parts.append(self.run(rids, own, ahead))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        rid, bucket, n = (np.concatenate([p[c] for p in parts]).astype(np.int64) for c in range(3))
        if cut:  # slices of one text are put together
            keys, place = np.unique(rid * self.buckets + bucket, return_inverse=True)
            n = np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64)
            rid, bucket = keys // self.buckets, keys % self.buckets
        return rid, bucket, n


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _count(buckets: int, max_n: int):
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, sums = _Counter(buckets, max_n), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rid, bucket, n = counter.counts(texts)
            np.add.at(sums, bucket, n)
            offsets = np.searchsorted(rid, np.arange(len(texts) + 1))
            lists = _lists(bucket, offsets, pa.int32()), _lists(n, offsets, pa.int64())
            features = np.concatenate([[0], np.cumsum(n)])
            # w words have w + (w-1) + ... windows: the number of words follows from that of the features
            n_words = _words_of(features[offsets[1:]] - features[offsets[:-1]], max_n)
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(texts)), batch.column("doc_id"), batch.column("text_hash"), batch.column("row"), pa.array(n_words, pa.int64()), *lists], names=names)
        held = np.flatnonzero(sums)
        if len(held):
            lists = _lists(held, np.array([0, len(held)]), pa.int32()), _lists(sums[held], np.array([0, len(held)]), pa.int64())
            none = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([True]), none, none, none, none, *lists], names=names)

    return work


def _words_of(features: np.ndarray, max_n: int) -> np.ndarray:
    """How many words have so many windows of 1 to ``max_n`` words."""
    few = np.array([sum(max(0, w - k) for k in range(max_n)) for w in range(max_n + 1)])
    many = (features + max_n * (max_n - 1) // 2) // max_n
    return np.where(features <= few[-1], np.searchsorted(few, features), many)


def bucket_counts(texts: DataFrame, doc: str | None, text: str, buckets: int, max_n: int, name: str) -> DataFrame:
    """Bucket counts of every row, and those of every task (``total``), as written (columns of COUNTS)."""
    doc_id = F.lit(None).cast("long") if doc is None else F.col(doc).cast("long")
    rows = texts.select(doc_id.alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    with arrow_rows(texts.sparkSession, BATCH_ROWS):
        return materialize(rows.mapInArrow(_count(buckets, max_n), COUNTS), name)


def _sums(counted: DataFrame, buckets: int) -> np.ndarray:
    """The merged counts: one number a bucket comes to the driver."""
    rows = counted.filter("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("z")).groupBy("z.buckets").agg(F.sum("z.counts").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["buckets"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_s + n) / ((float(s) + 1) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(by_bucket: np.ndarray, seed: int):
    names = [c.split()[0] for c in SCORES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = batch.column("counts"), batch.column("buckets")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            n = counts.flatten().to_numpy()
            sums = [np.concatenate([[0], np.cumsum(v)])[offsets] for v in (n, n * by_bucket[lists.flatten().to_numpy()])]
            n_features, weight = (np.diff(s) for s in sums)
            score = weight + np.array([noise(seed, i) for i in batch.column("doc_id").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), *(pa.array(v, pa.int64()) for v in (n_features, weight, score))], names=names)

    return work


def importance(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N,
               min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, text_hash, n_words, n_features, weight, score and rank (null: not drawn)."""
    common.check_columns(docs, doc, text)
    common.check_columns(target, target_text)
    if max_n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("max_n and buckets must be positive, percent from 0 to 100")
    counted = bucket_counts(docs, doc, text, buckets, max_n, "bucket-counts")
    wanted = bucket_counts(target, None, target_text, buckets, max_n, "target-counts")
    by_bucket = gains(_sums(counted, buckets), _sums(wanted, buckets))
    with arrow_rows(docs.sparkSession, 2000):
        scored = materialize(counted.filter("NOT total").drop("total").mapInArrow(_score(by_bucket, seed), SCORES), "scores")
    drawn = scored.filter(F.col("n_words") >= min_words).count() * percent // 100
    # one range sort; a row's rank is its place in its partition behind the partitions before
    order = [F.col("n_words") < min_words, F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = materialize(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):  # one row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    offset = docs.sparkSession.createDataFrame(offsets, "part long, before long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(offset), "part")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    chosen = (F.col("n_words") >= min_words) & (rank <= drawn)
    return ranked.select("doc_id", "text_hash", "n_words", "n_features", "weight", "score", F.when(chosen, rank).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, as they are."""
    chosen = importance(docs, target, doc, text, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    chosen = materialize(chosen, "drawn")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    same = F.col(doc).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__hash"))
    return docs.join(chosen, same, "left_semi")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return importance(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance": op13_importance}
ORACLE_SQL: dict = {}
