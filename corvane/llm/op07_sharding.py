"""Sharding by extendible hashing (DataFrame operations only).

The directory is indexed by the leading bits of a 60-bit key hash. A bucket
that exceeds the byte limit splits on its next bit; the others keep their
depth. The splits are found without a loop over the documents: bytes are
summed once per fine cell (one prefix of ``step`` bits more than the expected
depth), the small cell table is rolled up over all its prefixes, and a cell
belongs to the shortest prefix that fits. Only cells that are still too large
are looked at again, with more bits.

Defined results
* null keys hash like a value of their own; null texts have no bytes;
* a single document over the limit is a shard of its own;
* rows that share a key go on splitting by a hash of the whole row, and rows
  that are equal in every column are dealt out by count, as many as fit;
* an empty table gives an empty result;
* ``shard_id``, ``shard_depth``, ``shard_bytes`` and ``shard_docs`` replace
  input columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import materialize

from . import common

#: Production size of a shard: 64 MiB of text.
LIMIT_BYTES = 64 * 1024 * 1024
HASH_BITS = 60
OUTPUT = ("shard_id", "shard_depth", "shard_bytes", "shard_docs")


def _name(prefix: str, depth: str) -> Column:
    """The bits of a prefix as text; the root is ``*``."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN '*' ELSE lpad(bin({prefix}), {depth}, '0') END")


def directory(cells: DataFrame, bits: int, least: int, limit: int) -> DataFrame:
    """For each cell of ``bits`` bits the shortest prefix of ``least`` bits or more that fits.

    cells: ``__group``, ``__cell``, ``__b``, ``__n``. Cells for which none fits are left out.
    """
    rolled = cells.select("__group", "__cell", "__b", "__n", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("__depth"))
    rolled = rolled.withColumn("__prefix", F.expr(f"shiftright(__cell, {bits} - __depth)"))
    sums = rolled.groupBy("__group", "__depth", "__prefix").agg(F.sum("__b").alias("shard_bytes"), F.sum("__n").alias("shard_docs"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    chosen = rolled.select("__group", "__cell", "__depth", "__prefix").join(fits, ["__group", "__depth", "__prefix"])
    best = chosen.groupBy("__group", "__cell").agg(F.min(F.struct("__depth", "__prefix", "shard_bytes", "shard_docs")).alias("__s"))
    return best.select(
        "__group", "__cell",
        F.concat(F.col("__group"), _name("__s.__prefix", "__s.__depth")).alias("shard_id"),
        F.col("__s.__depth").cast("int").alias("shard_depth"),
        F.col("__s.shard_bytes").alias("shard_bytes"),
        F.col("__s.shard_docs").alias("shard_docs"),
    )


def _split(rows: DataFrame, hashed: str, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Shards of ``rows`` by the 60-bit column ``hashed``; what no prefix of it can split."""
    total = rows.agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return [], None
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1.0, (total["b"] or 0) / limit)))) + 4)
    least, done = 0, []
    while True:
        cells = (
            rows.withColumn("__cell", F.expr(f"shiftright({hashed}, {HASH_BITS - bits})"))
            .groupBy("__group", "__cell").agg(F.sum("__bytes").alias("__b"), F.count("*").alias("__n"))
        )
        cells = materialize(cells, "shard-cells")
        keyed = rows.withColumn("__cell", F.expr(f"shiftright({hashed}, {HASH_BITS - bits})"))
        done.append(keyed.join(directory(cells, bits, least, limit), ["__group", "__cell"]).drop("__cell"))
        large = cells.filter((F.col("__b") > limit) & (F.col("__n") > 1)).select("__group", "__cell")
        if large.isEmpty():
            return done, None
        rows = keyed.join(large, ["__group", "__cell"], "left_semi").drop("__cell")
        if bits == HASH_BITS:
            return done, rows
        least, bits = bits + 1, min(HASH_BITS, bits + 16)


def shard(docs: DataFrame, key: str = "doc_id", payload: str | Column = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` with the shard of each row; every shard holds ``limit_bytes`` of payload at most."""
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    common.check_columns(docs, key)
    docs = docs.drop(*OUTPUT)
    size = F.octet_length(F.col(payload)) if isinstance(payload, str) else payload
    columns = docs.columns
    rows = (
        docs.withColumn("__bytes", F.coalesce(size.cast("long"), F.lit(0).cast("long")))
        .withColumn("__hash", common.hash60(F.col(key)))
        .withColumn("__group", F.lit(""))
    )
    parts, rest = _split(rows, "__hash", limit_bytes)
    if rest is not None:  # equal keys: go on by the whole row
        rest = rest.withColumn("__group", F.concat(F.col("__group"), F.lpad(F.bin("__hash"), HASH_BITS, "0"), F.lit("-")))
        rest = rest.withColumn("__row", common.hash60(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))))
        more, same = _split(rest, "__row", limit_bytes)
        parts += [p.drop("__row") for p in more]
        if same is not None:  # equal rows: count them and deal them out
            per = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest("__bytes", F.lit(1)))).cast("long")
            dealt = same.groupBy(*[F.col(f"`{c}`") for c in same.columns]).agg(F.count("*").alias("__n"))
            last = F.ceil(F.col("__n") / F.col("__per")).cast("long") - 1
            dealt = dealt.withColumn("__per", per).withColumn("__slot", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            held = F.least(F.col("__per"), F.col("__n") - F.col("__slot") * F.col("__per"))
            dealt = dealt.withColumn("__held", held).repartition("__row", "__slot")  # no task makes more rows than a few shards hold
            parts.append(
                dealt.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__held"))))
                .withColumn("shard_id", F.concat(F.col("__group"), F.lpad(F.bin("__row"), HASH_BITS, "0"), F.lit("-"), F.col("__slot").cast("string")))
                .withColumn("shard_depth", F.lit(2 * HASH_BITS))
                .withColumn("shard_bytes", F.col("__held") * F.col("__bytes")).withColumn("shard_docs", F.col("__held"))
                .drop("__row", "__n", "__per", "__i", "__slot", "__held")
            )
    if not parts:
        parts = [
            rows.withColumn("shard_id", F.lit("*")).withColumn("shard_depth", F.lit(0))
            .withColumn("shard_bytes", F.col("__bytes")).withColumn("shard_docs", F.lit(1).cast("long"))
        ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(f"`{c}`") for c in columns], *OUTPUT)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return shard(docs, "doc_id", F.col("n_bytes"))


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes,
         ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN 'null' ELSE '=' || doc_id::VARCHAR END), 1, 15))::BIGINT AS h
  FROM documents),
p AS (SELECT doc_id, n_bytes, depth, h >> ({HASH_BITS} - depth) AS prefix FROM d, unnest(range(0, 41)) AS u(depth)),
s AS (SELECT depth, prefix, sum(coalesce(n_bytes, 0))::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
f AS (SELECT p.doc_id, p.n_bytes, p.depth, p.prefix, shard_bytes, shard_docs,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS r
      FROM p JOIN s USING (depth, prefix) WHERE shard_bytes <= {LIMIT_BYTES} OR shard_docs = 1)
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard_id,
       depth::INT AS shard_depth, shard_bytes, shard_docs
FROM f WHERE r = 1
"""

#: A limit that splits the small tables too.
SMALL_LIMIT_BYTES = 64 * 1024


def shard_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards of 64 KiB: buckets split at every size of the input."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return shard(docs, "doc_id", F.col("n_bytes"), limit_bytes=SMALL_LIMIT_BYTES)


QUERIES = {"op7_sharding": op7_sharding, "shard_64k": shard_64k}
ORACLE_SQL = {"op7_sharding": OP7_SQL, "shard_64k": OP7_SQL.replace(f"<= {LIMIT_BYTES}", f"<= {SMALL_LIMIT_BYTES}")}
