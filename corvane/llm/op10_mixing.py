"""Mixing sources to target weights (DataFrame operations only).

Each source gets a budget of words: its weight's part of ``share`` times all
words, at most ``cap`` times its own words, the excess going to the others by
weight. Rows get a hash-random key, of their id and their text; a source's
rows are cut into key ranges (the leading hex digits of the key). Sums per
range give each range its offset, so that the range in which the budget ends
is known, and a running sum in that range alone gives the key at which it
ends. A budget of two epochs and a half means two copies of every row and one
more of those whose key lies before that. No task ever holds a whole source,
and rows are not shuffled: a row is compared with its source's key.

Defined results
* a null text has no words; an empty table gives an empty result; whole texts are counted, however long;
* a null source is a source of its own, last in code-point order;
* rows of equal ids are ordered by their texts' hashes; rows that are equal in
  id and text too share the words of the budget's end in any order, so that
  reruns agree;
* a source without words has the target 0;
* ``size``, ``source_size``, ``target`` and ``taken`` replace input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.storage import materialize

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Hex digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3
#: Sources (about 200 bytes each) are broadcast up to this number, counted first.
BROADCAST_SOURCES = 500_000
OUTPUT = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Budgets per source. sizes: one row a source with ``__source`` and ``source_size``.

    Filling up to caps by weight has a closed form: in the order of cap over
    weight, all sources before some place are capped and the rest share what
    is left by weight. The windows run over one row a source.
    """
    if not weights or min(weights) <= 0 or share > cap:
        raise ValueError("weights must be positive, and the share at most the cap")
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    n = len(weights)
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    s = sizes.withColumn("__w", picked).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("__all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("__left", F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__w_left", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / F.col("__w_left"))
        .withColumn("__open", F.col("__cap") > F.col("__level") * F.col("__w"))
    )
    # the first source whose cap is above its share fixes the level of all that follow
    first = F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level")))).over(every)
    s = s.withColumn("__first", first["__level"])
    level_w = F.col("__first") * F.col("__w")
    target = F.when(F.col("__first").isNull() | (F.col("__cap") <= level_w), F.col("__cap")).otherwise(level_w)
    return s.select("__source", "source_size", target.alias("target"))


def sized(docs: DataFrame, key: str, source: str, size: Column, text: str | None) -> DataFrame:
    """``docs`` with size, and ``__name`` (null sources are joined like others) and ``__key``; ``size`` is no column of ``docs``."""
    content = F.md5(F.coalesce(F.col(text), F.lit(""))) if text else F.lit("")
    name = F.col(source).cast("string")
    return docs.withColumns({
        "size": F.coalesce(size.cast("long"), F.lit(0).cast("long")),
        "__name": F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), name)),
        "__key": F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), content)),
    })


def cuts(rows: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """Per source of ``rows`` (__name, __key, size): source_size, target, __epochs, and the key at which the rest of the
    budget ends, with the words that are left there. One row a source, written."""
    ranges = rows.groupBy("__name", F.substring("__key", 1, RANGE_DIGITS).alias("__range")).agg(F.sum("size").alias("__sum"))
    ranges = materialize(ranges, "mix-ranges")
    per_source = ranges.groupBy("__name").agg(F.sum("__sum").alias("source_size"))
    named = per_source.select(F.when(F.col("__name") != "n", F.substring("__name", 2, 1 << 30)).alias("__source"), "source_size")
    budgets = targets(named, weights, share, cap).withColumn("__name", F.coalesce(F.concat(F.lit("s"), "__source"), F.lit("n"))).drop("__source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = budgets.withColumn("__epochs", epochs)
    budgets = materialize(budgets.withColumn("__rest", F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long")), "mix-budgets")
    up_to = Window.partitionBy("__name").orderBy("__range")
    ends = ranges.withColumn("__to", F.sum("__sum").over(up_to)).join(budgets.select("__name", "__rest"), "__name").filter(F.col("__to") > F.col("__rest"))
    ends = ends.groupBy("__name").agg(F.min(F.struct("__range", (F.col("__to") - F.col("__sum")).alias("__offset"), "__rest")).alias("__e")).select("__name", "__e.*")
    last = rows.withColumn("__range", F.substring("__key", 1, RANGE_DIGITS)).join(ends, ["__name", "__range"])
    # equal keys are equal rows: one place, held by their number
    last = last.groupBy("__name", "__range", "__key", "__offset", "__rest").agg(F.sum("size").alias("__words"))
    run = F.col("__offset") + F.sum("__words").over(Window.partitionBy("__name", "__range").orderBy("__key"))
    last = last.withColumn("__run", run).filter(F.col("__run") > F.col("__rest"))
    last = last.groupBy("__name").agg(F.min(F.struct("__key", (F.col("__rest") - F.col("__run") + F.col("__words")).alias("__left"))).alias("__c"))
    found = budgets.join(last, "__name", "left")
    # where no part of an epoch is left, it ends before every key; where it takes all rows, after every key
    end = F.when(F.col("__rest") <= 0, F.lit("")).otherwise(F.coalesce("__c.__key", F.lit("~")))
    return materialize(found.select("__name", "source_size", "target", "__epochs", end.alias("__end"), F.coalesce("__c.__left", F.lit(0).cast("long")).alias("__left")), "mix-cuts")


def _with_cuts(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found, "__name")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, text: str | None = "text", weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    The row at which the budget ends gives the words up to it. ``text``: the column that rows of equal ids differ in.
    """
    common.check_columns(docs, key, source)
    size = F.regexp_count(F.col("text"), F.lit(common.WORD)) if size is None else size
    rows = sized(docs.drop(*(c for c in OUTPUT if c != "size")), key, source, size, text)
    rows = _with_cuts(rows, cuts(rows.select("__name", "__key", "size"), weights, share, cap))
    nothing = F.lit(0).cast("long")
    before = rows.filter(F.col("__key") != F.col("__end")).withColumn("__room", F.when(F.col("__key") < F.col("__end"), F.col("size")).otherwise(nothing))
    # the rows of one key are equal: the first of them are taken whole
    place = F.row_number().over(Window.partitionBy("__name", "__key").orderBy(F.lit(1))) - 1
    end = rows.filter(F.col("__key") == F.col("__end"))
    end = end.withColumn("__room", F.greatest(nothing, F.least(F.col("size"), F.col("__left") - place * F.col("size"))))
    out = before.unionByName(end).withColumn("taken", (F.col("__epochs") * F.col("size") + F.col("__room")).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in OUTPUT], *OUTPUT)


def copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """The mix itself: whole rows of ``docs``, repeated as often as they are taken, in the columns of ``docs``.

    The row at which the budget ends is taken where at least half of it lies
    before that. Rows without words are repeated like those of the keys around
    them, and stay once in a source that has no words at all. Rows are equal
    here if their ids, sources and texts are.
    """
    common.check_columns(docs, key, source, text)
    own = docs.withColumnsRenamed({c: f"__in_{c}" for c in OUTPUT if c in docs.columns})
    words = F.regexp_count(F.col(text), F.lit(common.WORD))
    narrow = sized(own.select(key, source, text), key, source, words, text).select(F.col(key).alias("__id"), "__name", "__key", "size")
    narrow = materialize(narrow, "mix-sizes")
    found = cuts(narrow, weights, share, cap)
    # what is taken at the end's key: the first of its equal rows
    end = narrow.join(found.select("__name", F.col("__end").alias("__key"), "__left"), ["__name", "__key"])
    end = end.groupBy("__name", "__key", "__left", "size").agg(F.count("*").alias("__n"), F.first("__id").alias("__id"))
    size = F.greatest("size", F.lit(1))
    end = materialize(end.withColumn("__more", F.least("__n", F.floor((F.col("__left") * 2 + size) / (size * 2)))).filter("__more > 0"), "mix-end")
    rows = _with_cuts(sized(own, key, source, F.lit(0), text).drop("size"), found)
    times = F.when(F.col("source_size") > 0, F.col("__epochs") + (F.col("__key") < F.col("__end")).cast("int")).otherwise(F.lit(1)).cast("int")
    rows = rows.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.expr("sequence(1, __times)")))
    columns = [F.col(f"`__in_{c}`").alias(c) if c in OUTPUT else F.col(f"`{c}`") for c in docs.columns]
    few = own.join(F.broadcast(end.select(F.col("__id").alias("__end_id")).distinct()) if end.count() <= BROADCAST_SOURCES else end.select(F.col("__id").alias("__end_id")).distinct(), F.col(key).eqNullSafe(F.col("__end_id")), "left_semi")
    few = sized(few, key, source, F.lit(0), text).drop("size").join(end.select("__name", "__key", "__more"), ["__name", "__key"]).dropDuplicates(["__name", "__key"])
    few = few.withColumn("__copy", F.explode(F.expr("sequence(1L, __more)")))
    return rows.select(*columns).union(few.select(*columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count("text", F.lit(common.WORD)).alias("words"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    docs = materialize(docs, "sizes")  # texts are read once
    return mix(docs, size=F.col("words"), text="digest").select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(md5(coalesce(text, '')))) AS key, coalesce(len(regexp_extract_all(text, '{common.WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ()) AS total FROM w),
o AS (SELECT *,
        (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
      FROM c),
l AS (SELECT min({{'r': cap / w, 'level': level}}) FILTER (WHERE cap > level * w) AS first FROM o),
t AS (SELECT source, source_size,
        CASE WHEN (SELECT first FROM l) IS NULL OR cap <= (SELECT first.level FROM l) * w THEN cap ELSE (SELECT first.level FROM l) * w END AS target
      FROM o),
r AS (SELECT doc_id, source, size,
        (sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
      FROM d),
j AS (SELECT doc_id, size, source_size, target, before,
        CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS e
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       e * size + greatest(0, least(size, round(target - e * source_size)::BIGINT - before)) AS taken
FROM j
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL = {"op10_mixing": OP10_SQL}
