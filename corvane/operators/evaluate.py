"""Summaries of retrieval runs and the ablation of several retrievers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import metrics as M
from corvane.storage import materialize


BUCKETS = 1024


def nearest_rank(df: DataFrame, value: str, by: list[str], share: float = 0.95) -> DataFrame:
    """(by, p95): the value at place floor(share * n) from 0, the last at most; no interpolation, nulls first.

    A histogram of each group, of BUCKETS equal steps between its least and
    largest value, tells the step that holds the place; only the rows of that
    step are sorted.
    """
    rows = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(value).alias("__v"))
    rows = rows.withColumn("__key", F.to_json(F.struct(*[f"__k{i}" for i in range(len(by))])))
    range_ = rows.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    rows = rows.join(range_, "__key")
    step = F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BUCKETS)
    rows = rows.withColumn("__step", F.when(F.col("__v").isNull(), F.lit(-1)).when(F.col("__hi") > F.col("__lo"), F.least(step, F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int"))
    steps = rows.groupBy("__key", "__n", "__step").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__key").orderBy("__step")) - F.col("__c")
    at = F.least(F.floor(F.lit(share) * F.col("__n")), F.col("__n") - 1)
    steps = steps.withColumn("__place", at - before).filter((F.col("__place") >= 0) & (F.col("__place") < F.col("__c")))
    rows = rows.drop("__n").join(steps.select("__key", "__step", "__place"), ["__key", "__step"])
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__key").orderBy("__v")) - 1).filter(F.col("__r") == F.col("__place"))
    return rows.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(by)], F.col("__v").alias("p95"))


def summarize(results: DataFrame) -> DataFrame:
    """(method, queries, recall_5, recall_10, mrr, mean_ms, p95_ms). results: method, found, relevant, latency_ms; total where relevant has only what was found."""
    total = F.col("total") if "total" in results.columns else None
    rows = results.select(
        "method", "latency_ms", M.recall_at_k(F.col("found"), F.col("relevant"), 5, total).alias("r5"), M.recall_at_k(F.col("found"), F.col("relevant"), 10, total).alias("r10"), M.mrr(F.col("found"), F.col("relevant")).alias("m")
    )
    means = rows.groupBy("method").agg(
        F.count("*").alias("queries"), F.round(F.avg("r5"), 4).alias("recall_5"), F.round(F.avg("r10"), 4).alias("recall_10"), F.round(F.avg("m"), 4).alias("mrr"), F.round(F.avg("latency_ms"), 2).alias("mean_ms")
    )
    tail = nearest_rank(rows, "latency_ms", ["method"]).select("method", F.round("p95", 2).alias("p95_ms"))
    return means.join(tail, "method")


def interleaved(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, found): file path and symbol name of each page in the order of the ranks."""
    rows = hits.select("query_id", "page_id", "rank").join(pages.select("page_id", "file_path", "symbol_name"), "page_id")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "file_path", "symbol_name")))
    return rows.groupBy("query_id").agg(F.flatten(F.transform(ordered, lambda p: F.array(p["file_path"], p["symbol_name"]))).alias("found"))


class Ablation:
    """Runs several retrievers over the same benchmark queries."""

    def __init__(self, pages: DataFrame) -> None:
        self.pages = pages
        self.methods: dict[str, Callable[[DataFrame, int], DataFrame]] = {}

    def add_method(self, name: str, retrieve: Callable[[DataFrame, int], DataFrame]) -> None:
        self.methods[name] = retrieve

    def run(self, benchmarks: DataFrame, k: int = 10) -> DataFrame:
        """(method, queries, recall_5, ...). benchmarks: query_id, query, relevant_files, relevant_symbols.

        All queries of a method run as one job; its time is shared out evenly.
        """
        relevant = benchmarks.select("query_id", F.concat("relevant_files", "relevant_symbols").alias("relevant"))
        every = None
        for name, retrieve in self.methods.items():
            began = time.perf_counter()
            hits = retrieve(benchmarks.select("query_id", "query"), k)
            hits = materialize(hits.select("query_id", "page_id", "rank"), f"hits-{name}")
            took = (time.perf_counter() - began) * 1000 / max(1, benchmarks.count())
            rows = relevant.join(interleaved(hits, self.pages), "query_id", "left")
            rows = rows.select(F.lit(name).alias("method"), F.coalesce("found", F.array().cast("array<string>")).alias("found"), "relevant", F.lit(took).alias("latency_ms"))
            every = rows if every is None else every.unionByName(rows)
        if every is None:
            raise ValueError("no method was added")
        return summarize(every)

    @staticmethod
    def table(summary: DataFrame) -> str:
        """The summary as lines of text, methods in order."""
        rows = summary.orderBy("method").collect()
        cells = [list(summary.columns), *[[str(v) for v in r] for r in rows]]
        widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
        return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in cells)
