"""Packing ranked pages into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

BUDGET = 4000
SEPARATOR = "\n\n"
#: Tokens of a page with a head and a source at least: the head's marks, a place, a colon and two lines are twelve
#: characters, the source's fences, language and line ends ten more.
LEAST = 22 // T.CHARS_PER_TOKEN


def _some(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def _head(place: Column) -> Column:
    return F.concat(F.lit("### ["), place.cast("string"), F.lit("] "), F.col("file_path"), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))


def _optional(docstring: int, calls: int, with_calls: bool) -> list[Column]:
    """Signature, docstring and calls; a null part drops out of concat_ws."""
    lines = [
        F.when(_some("signature"), F.concat(F.lit("**Signature:** `"), "signature", F.lit("`"))),
        F.when(_some("docstring"), F.concat(F.lit("**Docstring:** "), F.substring("docstring", 1, docstring))),
    ]
    if with_calls:
        lines.append(F.when(F.size(F.coalesce("calls", F.array())) > 0, F.concat(F.lit("**Calls:** "), F.array_join(F.slice("calls", 1, calls), ", "))))
    return lines


def full_page(place: Column, with_calls: bool = False) -> Column:
    """A page with its whole source; calls are listed only where a graph is at hand."""
    language = F.when(_some("language"), F.col("language")).otherwise(F.lit("python"))
    code = F.concat(F.lit("```"), language, F.lit("\n"), "source_code", F.lit("\n```"))
    return F.concat_ws("\n", _head(place), *_optional(200, 10, with_calls), code)


def short_page(place: Column) -> Column:
    return F.concat_ws("\n", _head(place), *_optional(150, 5, True))


def pack(ranked: DataFrame, budget: int | None = None, with_calls: bool = False) -> DataFrame:
    """(query_id, context, n_pages, n_tokens). ranked: query_id, rank from 0, and the page's columns.

    Whole pages while they fit; the first that doesn't fit is tried in short
    form, and nothing follows it. The blank lines between pages don't count.
    A budget of 0 or None means the usual one.

    A page with a head and a source has ``LEAST`` tokens or more, so a context can't reach beyond the first
    ``limit // LEAST`` of them and one more. All later ones are left out before a text is made or a row is moved: each task passes on that many
    rows a query at most, and the running sum of a query of any length is over so many. (Pages without a file,
    lines or source may have no tokens; they stay.)
    """
    limit = budget or BUDGET
    place = F.col("rank") + 1
    headed = F.col("file_path").isNotNull() & F.col("line_start").isNotNull() & F.col("line_end").isNotNull() & F.col("source_code").isNotNull()
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    ranked = ranked.filter(headed).withColumn("__at", first).filter(F.col("__at") <= limit // LEAST + 1).drop("__at").unionByName(ranked.filter(~headed))
    rows = ranked.select("query_id", "rank", full_page(place, with_calls).alias("full"), short_page(place).alias("short"))
    rows = rows.withColumns({"n_full": T.token_estimate(F.col("full")).cast("long"), "n_short": T.token_estimate(F.col("short")).cast("long")})
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("sum", F.sum("n_full").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = F.min(F.when(F.col("sum") > limit, F.col("rank"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("over", over)
    fits = F.col("over").isNull() | (F.col("rank") < F.col("over"))
    short = (F.col("rank") == F.col("over")) & (F.col("sum") - F.col("n_full") + F.col("n_short") <= limit)
    kept = rows.withColumn("part", F.when(fits, F.col("full")).when(short, F.col("short"))).withColumn("n", F.when(fits, F.col("n_full")).when(short, F.col("n_short")))
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("rank", "part")))), lambda p: p["part"])
    return kept.groupBy("query_id").agg(
        F.array_join(parts, SEPARATOR).alias("context"), F.count("part").cast("int").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_tokens")
    )
