"""Command line: ingest, query, stats, tree, benchmark."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.operators import context, evaluate, graph
from corvane.operators.vector import HashingEmbedder, HttpEmbedder
from corvane.plans import ingest, providers, retrievers
from corvane.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("--index-dir", default="corvane-index")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("path")
    a.add_argument("--name")
    a.add_argument("--no-vectors", action="store_true")
    a.add_argument("--embed-url", help="a service that makes vectors; hashed words without one")
    a.add_argument("--embed-model", default="")
    a = sub.add_parser("query")
    a.add_argument("text")
    a.add_argument("--repo")
    a.add_argument("--strategy", choices=("hybrid", "vectorless", "vector"), default="hybrid")
    a.add_argument("--top-k", type=int, default=10)
    a.add_argument("--llm", action="store_true")
    a.add_argument("--llm-url", help="a service that answers; the first lines of the prompt without one")
    a.add_argument("--llm-model", default="")
    a.add_argument("--answer-cache", help="a folder of answers that later runs take instead of asking again")
    a = sub.add_parser("stats")
    a.add_argument("--repo")
    a = sub.add_parser("tree")
    a.add_argument("--repo")
    a.add_argument("--depth", type=int, default=20)
    a = sub.add_parser("benchmark")
    a.add_argument("queries")
    a.add_argument("--repo")
    a.add_argument("--top-k", type=int, default=5)
    return p


def _index(spark: SparkSession, args) -> store.Index:
    found = store.repositories(spark, args.index_dir)
    name = args.repo or (found[0] if found else None)
    if name not in found:
        raise SystemExit(f"no index of {name or 'any repository'} below {args.index_dir}")
    return store.load(spark, args.index_dir, name)


def retriever(index: store.Index, strategy: str):
    if strategy == "vectorless" or (strategy == "hybrid" and index.embeddings is None):
        return retrievers.VectorlessRetriever(index)
    if index.embeddings is None:
        raise SystemExit("the index has no vectors")
    embedder = HashingEmbedder(len(index.embeddings.first()["embedding"]) if not index.embeddings.isEmpty() else 1)
    return retrievers.VectorRetriever(index, embedder) if strategy == "vector" else retrievers.HybridRetriever(index, embedder)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    if args.command == "ingest":
        embedder = HttpEmbedder(args.embed_url, args.embed_model) if args.embed_url else HashingEmbedder()
        index, errors = ingest.ingest(spark, args.path, None if args.no_vectors else embedder)
        store.save(index, args.index_dir, args.name or args.path.rstrip("/").rsplit("/", 1)[-1])
        errors.show(truncate=False)
        ingest.summary(index).orderBy("kind", "name").show(100, False)
        return
    index = _index(spark, args)
    if args.command == "stats":
        graph.stats(index.nodes, index.edges).filter("name <> 'unknown'").orderBy("kind", "name").show(100, False)
    elif args.command == "tree":
        graph.tree(index.symbols, args.depth).show(args.depth, False)
    elif args.command == "query":
        queries = spark.createDataFrame([("q", args.text)], "query_id string, query string")
        hits = retrievers.with_pages(retriever(index, args.strategy).retrieve(queries, args.top_k), index.pages)
        hits.orderBy("rank").select("rank", "score", "symbol_type", "qualified_name", "file_path", "line_start").show(args.top_k, False)
        if args.llm:
            packed = context.pack(hits, with_calls=True).join(queries, "query_id")
            prompts = packed.select("query_id", providers.prompt(F.col("context"), F.col("query")).alias("prompt"))
            provider = providers.HttpChat(args.llm_url, args.llm_model) if args.llm_url else providers.Offline()
            if args.answer_cache:
                answers = providers.ask_cached(prompts, provider, args.answer_cache, f"{args.llm_url} {args.llm_model}")
            else:
                answers = providers.ask(prompts, provider)
            answers.select("content").show(1, False)
    else:
        runs = evaluate.Ablation(index.pages)
        for name in ("vector", "hybrid"):
            if index.embeddings is not None:
                runs.add_method(name, retriever(index, name).retrieve)
        if not runs.methods:
            runs.add_method("vectorless", retriever(index, "vectorless").retrieve)
        print(runs.table(runs.run(store.benchmarks(spark, args.queries), args.top_k)))


if __name__ == "__main__":
    main()
