"""Language-model access behind a small interface, prompts, and offline stand-ins."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.vector import post_json
from corvane.storage import materialize

ANSWER = "query_id string, content string, prompt_tokens int, completion_tokens int, latency_ms double, error boolean"

SYSTEM = {
    "general": "You explain source code. Use only the code you are given, name the files and functions you rely on, and say so when it does not suffice.",
    "architecture": "You explain how a code base is built. Describe its parts and how data and control pass between them, only as far as the code you are given shows it.",
    "dependency": "You trace dependencies in source code. State who calls whom, with file and line, and mark whatever the code you are given does not settle.",
    "debugging": "You look for the cause of a fault in source code. Weigh edge cases and error handling in the code you are given, and cite the lines that matter.",
}
EXPANSION = 'Turn this question about a code base into search terms: {query}\nAnswer with JSON only: {{"keywords": [...], "expected_symbols": [...], "expected_files": [...]}}'
JUDGE = (
    "Question:\n{question}\n\nReference answer:\n{truth}\n\nAnswer to judge:\n{answer}\n\n"
    'Rate the answer from 1 to 5. JSON only: {{"correctness": n, "completeness": n, "hallucination": n, "specificity": n, "reasoning": "..."}}'
)
EXPANDED = "keywords array<string>, expected_symbols array<string>, expected_files array<string>"
JUDGED = "correctness int, completeness int, hallucination int, specificity int, reasoning string"


@dataclass
class Answer:
    content: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Provider(Protocol):
    """Sent to the executors; opens its connection when first called there."""

    def __call__(self, prompt: str, system: str, temperature: float, max_tokens: int) -> Answer: ...


class Offline:
    """Answers with the first lines of the prompt; for tests and for use without a model."""

    def __call__(self, prompt: str, system: str, temperature: float = 0.0, max_tokens: int = 2048) -> Answer:
        content = "\n".join(prompt.splitlines()[:5])[: max_tokens * T.CHARS_PER_TOKEN]
        return Answer(content, len(prompt) // T.CHARS_PER_TOKEN, len(content) // T.CHARS_PER_TOKEN)


class HttpChat:
    """Answers from a service: POST {"model", "messages", "options"}, answered by {"message": {"content"}, counts}."""

    def __init__(self, url: str, model: str, timeout: float = 180.0) -> None:
        self.url, self.model, self.timeout = url, model, timeout

    def __call__(self, prompt: str, system: str, temperature: float = 0.0, max_tokens: int = 2048) -> Answer:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        options = {"temperature": temperature, "num_predict": max_tokens}
        found = post_json(self.url, {"model": self.model, "messages": messages, "options": options, "stream": False}, self.timeout)
        return Answer(found.get("message", {}).get("content", ""), found.get("prompt_eval_count", 0), found.get("eval_count", 0))


def ask(prompts: DataFrame, provider: Provider, system: str = SYSTEM["general"], temperature: float = 0.0, max_tokens: int = 2048) -> DataFrame:
    """ANSWER rows for prompts (query_id, prompt). A call that fails gives its message as content, not an error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query, prompt in zip(batch["query_id"], batch["prompt"], strict=True):
                began = time.perf_counter()
                try:
                    found, failed = provider(prompt, system, temperature, max_tokens), False
                except Exception as fault:  # noqa: BLE001 - a provider may fail in any way
                    found, failed = Answer(f"Error: {fault}"), True
                rows.append({"query_id": str(query)} | asdict(found) | {"latency_ms": (time.perf_counter() - began) * 1000, "error": failed})
            yield pd.DataFrame(rows)

    return prompts.select("query_id", "prompt").mapInPandas(work, ANSWER)


#: A cache's columns: the key of a prompt and what was answered to it.
CACHED = "key string, content string, prompt_tokens int, completion_tokens int"


def prompt_key(prompt: Column, system: str, temperature: float, max_tokens: int, name: str) -> Column:
    """What an answer depends on, as one hash."""
    return F.sha2(F.concat_ws("\x00", F.lit(name), F.lit(system), F.lit(repr(float(temperature))), F.lit(str(max_tokens)), prompt), 256)


def ask_cached(prompts: DataFrame, provider: Provider, cache: str, name: str = "", system: str = SYSTEM["general"], temperature: float = 0.0, max_tokens: int = 2048) -> DataFrame:
    """As ``ask``, with a table of answers that outlives the run: ``cache`` is a folder that all executors share.

    Equal prompts are sent once, those that the table has not at all. New answers are
    appended in one commit, after all calls; failures are not kept, so the next run
    sends them again. ``name`` tells providers and models apart. Answers from the
    table have a latency of 0. Two runs at a time may both send a prompt: the smaller answer counts.
    """
    spark = prompts.sparkSession
    keyed = materialize(prompts.select("query_id", "prompt", prompt_key(F.coalesce("prompt", F.lit("")), system, temperature, max_tokens, name).alias("key")), "prompts")

    def known() -> DataFrame:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], CACHED)
        rows = spark.read.schema(CACHED).parquet(cache)
        return rows.groupBy("key").agg(F.min(F.struct("content", "prompt_tokens", "completion_tokens")).alias("a")).select("key", "a.*")

    # the earlier answers to these prompts alone are looked at again
    had = materialize(known().join(keyed.select("key").distinct(), "key", "left_semi"), "known")
    missing = keyed.groupBy("key").agg(F.min("prompt").alias("prompt")).join(had.select("key"), "key", "left_anti")
    fresh = ask(missing.select(F.col("key").alias("query_id"), "prompt"), provider, system, temperature, max_tokens)
    fresh = materialize(fresh.withColumnRenamed("query_id", "key"), "answers")  # the calls are made here, once
    good = fresh.filter("NOT error").select("key", "content", "prompt_tokens", "completion_tokens")
    if not good.isEmpty():
        good.write.mode("append").parquet(cache)
    old = had.withColumns({"latency_ms": F.lit(0.0), "error": F.lit(False)})
    answers = old.unionByName(fresh.select(*old.columns))
    names = [c.split()[0] for c in ANSWER.split(", ")]
    return keyed.select(F.col("query_id").cast("string").alias("query_id"), "key").join(answers, "key").select(*names)


def usage(answers: DataFrame) -> DataFrame:
    """One row: calls, prompt_tokens, completion_tokens, total_tokens."""
    return answers.agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens")
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def prompt(context: Column, query: Column, call_graph: Column | None = None) -> Column:
    parts = [F.lit("## Code\n"), context]
    if call_graph is not None:
        parts += [F.lit("\n## Calls\n"), call_graph]
    return F.concat_ws("\n", *parts, F.lit("\n---\n\n## Question"), query)


def fill(template: str, **values: Column) -> Column:
    """A template with named fields as a Column; doubled braces are braces."""
    out, plain = [], ""
    for piece in re.findall(r"\{\{|\}\}|\{\w+\}|[^{}]+", template):
        if piece[0] == "{" and piece[-1] == "}":
            out += [F.lit(plain), values[piece[1:-1]]]
            plain = ""
        else:
            plain += piece[0] if piece in ("{{", "}}") else piece
    return F.concat(*out, F.lit(plain))


def expand_offline(queries: DataFrame) -> DataFrame:
    """query_id, query, keywords, idents, files, search: by patterns, without a model."""
    q = F.col("query")
    return queries.select("query_id", "query", T.keywords(q).alias("keywords"), T.identifiers(q).alias("idents"), F.array().cast("array<string>").alias("files"), T.search_string(q).alias("search"))


def expand(queries: DataFrame, provider: Provider | None = None, cache: str | None = None, name: str = "") -> DataFrame:
    """As ``expand_offline``, by a model where one is given; what it doesn't answer in JSON is expanded by patterns.

    Equal queries are sent once; with ``cache`` (see ``ask_cached``) those of earlier runs not again.
    """
    offline = expand_offline(queries)
    if provider is None:
        return offline
    asked = queries.select(F.col("query").alias("query_id")).distinct().withColumn("prompt", fill(EXPANSION, query=F.col("query_id")))
    answers = ask(asked, provider) if cache is None else ask_cached(asked, provider, cache, name)
    answers = answers.select(F.col("query_id").alias("query"), F.when(~F.col("error"), T.parse_json(F.col("content"), EXPANDED)).alias("a"))
    none = F.array().cast("array<string>")
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    rows = offline.join(answers, "query", "left")
    given = F.array_distinct(F.concat(F.transform(F.coalesce("a.keywords", none), F.lower), words))
    rows = rows.withColumns({
        "keywords": F.when(F.col("a").isNotNull(), given).otherwise(F.col("keywords")),
        "idents": F.when(F.col("a").isNotNull(), F.coalesce("a.expected_symbols", none)).otherwise(F.col("idents")),
        "files": F.coalesce("a.expected_files", none),
    })
    return rows.select("query_id", "query", "keywords", "idents", "files", F.concat_ws(" ", "keywords", "idents").alias("search"))


def judge(rows: DataFrame, provider: Provider) -> DataFrame:
    """(query_id, correctness, ...) for rows of query_id, question, truth, answer."""
    asked = rows.select("query_id", fill(JUDGE, question=F.col("question"), truth=F.col("truth"), answer=F.col("answer")).alias("prompt"))
    return ask(asked, provider).select("query_id", T.parse_json(F.col("content"), JUDGED).alias("j")).select("query_id", "j.*")


__all__ = ["ANSWER", "Answer", "Offline", "Provider", "SYSTEM", "ask", "ask_cached", "expand", "expand_offline", "fill", "json", "judge", "prompt", "usage"]
