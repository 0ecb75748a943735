"""Saved indexes: committed versions of Parquet tables below <root>/<repository>/."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import pages as page_ops
from corvane.operators.lexical import LexicalIndex
from corvane.operators.symbols import NameIndex


@dataclass
class Index:
    """All tables of one repository; embeddings and the index of names may be missing."""

    symbols: DataFrame
    pages: DataFrame
    nodes: DataFrame
    edges: DataFrame
    pagerank: DataFrame
    lexical: LexicalIndex
    embeddings: DataFrame | None = None
    names: NameIndex | None = None


_PLAIN = ("symbols", "pages", "nodes", "edges", "pagerank", "embeddings")
_LEXICAL = ("postings", "pages", "corpus")
#: Manifests: one small file a version, named by its number.
VERSIONS = "_versions"


class SaveConflict(RuntimeError):
    """Another save committed the same version first."""


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    p, fs = _hadoop(spark, f"{root.rstrip('/')}/{name}/{VERSIONS}")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if re.fullmatch(r"[0-9]+\.json", s.getPath().getName()))


def save(index: Index, root: str, name: str) -> int:
    """Commit ``index`` as the next version and return its number.

    All tables go to a folder of their own. Then a manifest is written beside the others and
    renamed to the version's number: until that one step readers see the version before, whole, and a save that
    is broken off leaves a folder that nothing refers to (``vacuum`` removes it). Of two saves at a time one fails.
    Postings are clustered by term and names by gram, so that a query reads few row groups.
    """
    base, spark = f"{root.rstrip('/')}/{name}", index.symbols.sparkSession
    number, folder = max(versions(spark, root, name), default=0) + 1, f"data-{uuid.uuid4().hex}"
    for table in _PLAIN:
        df = getattr(index, table)
        if df is not None:
            df.write.parquet(f"{base}/{folder}/{table}")
    for table in _LEXICAL:
        df = getattr(index.lexical, table)
        df = df.repartitionByRange("term", "page_id").sortWithinPartitions("term") if table == "postings" else df
        df.write.parquet(f"{base}/{folder}/lexical_{table}")
    index.lexical.tokens.write.parquet(f"{base}/{folder}/lexical_tokens")
    if index.names is not None:
        save_names(index.names, f"{base}/{folder}/names")
    manifest = {"folder": folder, "tables": [t for t in _PLAIN if getattr(index, t) is not None], "names": index.names is not None, "tokens": True, "method": index.lexical.method, "tokenizer": index.lexical.tokenizer}
    draft, fs = _hadoop(spark, f"{base}/{VERSIONS}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(json.dumps(manifest).encode("utf-8"))
    out.close()
    final, _ = _hadoop(spark, f"{base}/{VERSIONS}/{number:020d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise SaveConflict(f"version {number} of {name} was committed meanwhile")
    return number


def save_names(names: NameIndex, path: str) -> None:
    """The tables of an index of names, clustered by gram; one row a run of letters in ``counts``."""
    names.grams.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    names.counts.write.parquet(f"{path}/counts")


def load_names(spark: SparkSession, path: str) -> NameIndex:
    return NameIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("grams", "counts")])


def _manifest(spark: SparkSession, base: str, number: int) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(f"{base}/{VERSIONS}/{number:020d}.json").first()[0])


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> Index:
    """A saved index, pinned to its last version or to ``version``: later saves don't change what it reads.

    Pages that were not saved are made from the symbols (files without symbols then have none).
    """
    base, found = f"{root.rstrip('/')}/{name}", versions(spark, root, name)
    if not found or version is not None and version not in found:
        raise ValueError(f"no index of {name} below {root}" + (f" with version {version}" if found else ""))
    manifest = _manifest(spark, base, version or found[-1])
    folder = f"{base}/{manifest['folder']}"
    read = {t: spark.read.parquet(f"{folder}/{t}") if t in manifest["tables"] else None for t in _PLAIN}
    if read["pages"] is None:
        read["pages"] = page_ops.build(read["symbols"])
    lexical = LexicalIndex(*[spark.read.parquet(f"{folder}/lexical_{t}") for t in _LEXICAL], method=manifest["method"], tokenizer=manifest["tokenizer"], tokens=None)
    tokens = spark.read.parquet(f"{folder}/lexical_tokens") if manifest.get("tokens") else _tokens(lexical)
    lexical = replace(lexical, tokens=tokens)
    names = load_names(spark, f"{folder}/names") if manifest.get("names") else None
    return Index(lexical=lexical, names=names, **read)


def _tokens(index: LexicalIndex) -> DataFrame:
    """The terms of each page, from the postings of a version that was saved without them."""
    held = index.postings.groupBy("page_id").agg(F.flatten(F.collect_list(F.expr("array_repeat(term, tf)"))).alias("t"))
    return index.pages.join(held, "page_id", "left").select("page_id", "dl", F.coalesce("t", F.array().cast("array<string>")).alias("t"))


def vacuum(spark: SparkSession, root: str, name: str, keep: int = 1) -> list[str]:
    """Remove all but the last ``keep`` versions, and folders of saves that were broken off; not while one is running. Returns the folders removed."""
    base = f"{root.rstrip('/')}/{name}"
    found = versions(spark, root, name)
    last = found[-max(1, keep) :]
    needed = {_manifest(spark, base, n)["folder"] for n in last}
    for number in found:
        if number not in last:
            p, fs = _hadoop(spark, f"{base}/{VERSIONS}/{number:020d}.json")
            fs.delete(p, False)
    p, fs = _hadoop(spark, base)
    gone = []
    for s in fs.listStatus(p) if fs.exists(p) else []:
        folder = s.getPath().getName()
        if folder.startswith("data-") and folder not in needed:
            fs.delete(s.getPath(), True)
            gone.append(folder)
    return gone


def repositories(spark: SparkSession, root: str) -> list[str]:
    """Names of the saved indexes; folders without a committed version are none."""
    p, fs = _hadoop(spark, root)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and versions(spark, root, s.getPath().getName()))


def benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark queries from a JSON array, with a fixed schema."""
    schema = "query_id string, query string, category string, relevant_files array<string>, relevant_symbols array<string>, ground_truth_answer string, repository string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("ground_truth_answer", "repository")})


__all__ = [f.name for f in fields(Index)] + ["Index", "benchmarks", "load", "repositories", "save", "vacuum", "versions"]
