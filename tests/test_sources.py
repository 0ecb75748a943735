import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.operators import graph, pages, symbols
from corvane.operators.vector import HashingEmbedder
from corvane.plans import ingest
from corvane.sources import extract, javascript, repository, store

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="module")
def ingested(spark):
    return ingest.ingest(spark, ROOT, HashingEmbedder(32))


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_scan_prunes_and_filters(spark, tmp_path):
    (tmp_path / "big.py").write_bytes(b"x = 1\n" * 200_000)
    (tmp_path / "ok.py").write_bytes(b"a = '\xff'\r\nb = 2\r")
    found = {r["file_path"]: r for r in rows(repository.scan(spark, str(tmp_path)))}
    assert set(found) == {"ok.py"} and found["ok.py"]["source_code"] == "a = '�'\nb = 2\n" and found["ok.py"]["line_count"] == 3
    names = {r["file_path"] for r in rows(repository.scan(spark, ROOT))}
    assert "app/models.py" in names and "web/index.js" in names and "pkg.egg-info/z.py" in names
    assert not names & {"rebuild/x.py", "venv/y.py", "native/lib.rs", "ui/view.tsx"}
    with pytest.raises(ValueError):
        repository.scan(spark, str(tmp_path / "missing"))


def python_symbols(spark, text):
    """The raw rows of one file in their order."""
    files = spark.createDataFrame([("f.py", "python", text)], "file_path string, language string, source_code string")
    return rows(extract.raw_symbols(files).orderBy("seq"))


def test_python_symbols(spark):
    found = python_symbols(spark, open(f"{ROOT}/app/models.py").read())
    by = {(r["kind"], r.get("parent"), r["name"]): r for r in found}
    model = by[("class", None, "Model")]
    assert model["base_classes"] == ["Base"] and model["docstring"] == "A model." and (model["line_start"], model["line_end"]) == (7, 15)
    assert by[("class", None, "Other")]["base_classes"] == ["pkg.Base"]
    size = by[("function", "Model", "size")]
    assert size["decorators"] == ["property"] and size["calls"] == ["count", "helper"] and size["returns"] == "int" and size["line_start"] == 11
    assert by[("function", "Other", "size")]["docstring"] == "Single quoted."
    assert [r["name"] for r in found if r["kind"] == "import"] == ["os", "numpy as np", ".base"]
    assert by[("import", None, ".base")]["names"] == ["Base", "other"]
    assert [r["name"] for r in found if r["kind"] == "variable"] == ["LIMIT", "__version__", "x"]
    assert not any(r["name"] == "Inner" for r in found)


def test_python_functions(spark):
    found = {r["name"]: r for r in python_symbols(spark, open(f"{ROOT}/app/service.py").read())}
    serve = found["serve"]
    assert serve["parameters"] == ["model: Optional[Model]", "*args", "limit: int = 5", "**kw: Dict[str, Limit]"]
    assert serve["type_hints"] == ["Model", "Limit"] and serve["calls"] == ["nested_call", "Model", "stop", "run", "inner"] and serve["returns"] == "Model"
    assert serve["source_code"].startswith("async def serve") and "inner" not in found and found["app.models"]["names"] == ["*"]
    assert [r["name"] for r in python_symbols(spark, open(f"{ROOT}/app/guarded.py").read())] == []


def test_javascript_symbols():
    found = javascript.symbols(open(f"{ROOT}/web/index.js").read())
    assert [(r["kind"], r["name"]) for r in found] == [("function", "start"), ("function", "go"), ("class", "View"), ("import", 'import { render } from "./render";')]
    assert found[0]["calls"] == ["draw"] or found[0]["calls"] == ["View", "draw"]
    assert found[1]["calls"] == ["start"] and found[2]["base_classes"] == ["Base"]


def test_ingested_index(ingested):
    index, errors = ingested
    assert [r["file_path"] for r in rows(errors)] == ["app/broken.py"]
    symbols = {r["qualified_name"]: r for r in rows(index.symbols)}
    assert symbols["Model.size"]["type"] == "method" and symbols["Model.size"]["signature"] == "def size(self) -> int" and symbols["Model"]["signature"] == "class Model(Base)"
    assert symbols["app.models"]["source_code"] == "import app.models (*)" and symbols["LIMIT"]["source_code"] == "LIMIT = 1000 * 1000 * 1000"
    found = rows(index.pages)
    assert {"app/consts.py", "app/guarded.py", "app/broken.py"} <= {r["file_path"] for r in found if r["symbol_type"] == "file"}
    assert all(len(r["page_id"]) == 16 for r in found) and len({r["page_id"] for r in found}) == len(found)
    edges = {(r["src"], r["dst"]): r["type"] for r in rows(index.edges)}
    assert len(edges) == index.edges.count()
    ids = {q: r["symbol_id"] for q, r in symbols.items()}
    # called and a parameter's type: the later phase wins
    assert edges[(ids["serve"], ids["Model"])] == graph.USES_TYPE and edges[(ids["plain"], ids["serve"])] == graph.CALLS
    assert edges[(ids["Model"], ids["Model.size"])] == graph.CONTAINS and edges[(ids["Model"], "file::app/models.py")] == graph.DEFINED_IN
    assert abs(sum(r["rank"] for r in rows(index.pagerank)) - 1) < 1e-6


def test_store_round_trip_and_cli(spark, ingested, tmp_path, capsys):
    index, _ = ingested
    store.save(index, str(tmp_path), "app")
    os.makedirs(tmp_path / "vector_store")
    assert store.repositories(spark, str(tmp_path)) == ["app"]
    again = store.load(spark, str(tmp_path), "app")
    assert again.pages.count() == index.pages.count() and again.lexical.method == "lucene"
    assert rows(again.symbols.filter("qualified_name = 'serve'"))[0]["type_hints"] == ["Model", "Limit"]
    for argv in (["stats"], ["tree"], ["query", "Where does serve call Model", "--llm"], ["query", "Model size", "--strategy", "vectorless"], ["query", "Model size", "--strategy", "vector"]):
        cli.main(["--index-dir", str(tmp_path), *argv], spark)
    out = capsys.readouterr().out
    assert "app/models.py" in out and "CALLS" in out
    queries = tmp_path / "b.json"
    queries.write_text('[{"query_id": "a", "query": "serve Model", "category": "x", "relevant_files": ["app/service.py"], "relevant_symbols": ["serve"]}]')
    cli.main(["--index-dir", str(tmp_path), "benchmark", str(queries)], spark)
    assert "hybrid" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--index-dir", str(tmp_path), "stats", "--repo", "no"], spark)


def test_pages_rebuilt_from_symbols_lack_files(ingested):
    index, _ = ingested
    assert pages.build(index.symbols).filter("symbol_type = 'file'").count() == 0


def test_faulty_lines_are_set_aside(spark):
    text = "def a():\n    print 'old'\n    return b()\n\nclass C(\n\ndef d(x: T): pass\n"
    found = {r["name"]: r for r in python_symbols(spark, text)}
    assert found["a"]["calls"] == ["b"] and found["a"]["source_code"] == "def a():\n    print 'old'\n    return b()"
    assert found["d"]["type_hints"] == ["T"] and found["SyntaxError"]["kind"] == "error" and found["SyntaxError"]["line_start"] == 2
    with pytest.raises(SyntaxError):
        extract.parse("print 'old'\n" * (extract.MAX_FAULTS + 10))


def test_a_file_that_is_nested_too_deeply_is_an_error(spark):
    files = spark.createDataFrame([("a.py", "python", "(" * 5000), ("b.py", "python", "x = 1")], "file_path string, language string, source_code string")
    raw = extract.raw_symbols(files).collect()
    assert {(r.file_path, r.kind) for r in raw} == {("a.py", "error"), ("b.py", "variable")}


def test_the_language_of_a_file():
    assert repository.LANGUAGES[".c"] == "c" and repository.LANGUAGES[".cc"] == "cpp" and list(repository.LANGUAGES)[3] == ".jsx"


def test_a_save_that_is_broken_off_leaves_the_old_version(spark, ingested, tmp_path):
    index, _ = ingested
    root = str(tmp_path)
    assert store.save(index, root, "app") == 1
    pinned = store.load(spark, root, "app")
    n = pinned.symbols.count()
    broken = dataclasses.replace(index, symbols=index.symbols.limit(1), edges=index.edges.withColumn("weight", F.raise_error(F.lit("the disk is full"))))
    with pytest.raises(Exception, match="the disk is full"):
        store.save(broken, root, "app")
    assert store.versions(spark, root, "app") == [1] and store.load(spark, root, "app").symbols.count() == n
    smaller = dataclasses.replace(index, symbols=index.symbols.limit(1), embeddings=None)
    assert store.save(smaller, root, "app") == 2
    assert store.load(spark, root, "app").symbols.count() == 1 and store.load(spark, root, "app").embeddings is None
    # who has read version 1 goes on with it
    assert pinned.symbols.count() == n and store.load(spark, root, "app", 1).symbols.count() == n
    assert len(store.vacuum(spark, root, "app", keep=2)) == 1  # what the broken save left
    assert len(store.vacuum(spark, root, "app")) == 1 and store.versions(spark, root, "app") == [2]
    assert store.load(spark, root, "app").symbols.count() == 1
    with pytest.raises(ValueError):
        store.load(spark, root, "app", 1)


def test_two_saves_at_a_time(spark, ingested, tmp_path, monkeypatch):
    index, _ = ingested
    store.save(index, str(tmp_path), "app")
    monkeypatch.setattr(store, "versions", lambda *_: [])  # the other one hadn't committed when this one began
    with pytest.raises(store.SaveConflict):
        store.save(index, str(tmp_path), "app")


def test_saved_names_are_what_look_ups_read(spark, ingested, tmp_path):
    index, _ = ingested
    store.save(index, str(tmp_path), "r")
    back = store.load(spark, str(tmp_path), "r")
    assert sorted(map(tuple, back.names.grams.collect())) == sorted(map(tuple, index.names.grams.select(back.names.grams.columns).collect()))
    ids = spark.createDataFrame([("q", "mod"), ("q", "siz_"), ("q", "s")], "query_id string, ident string")
    want = sorted(map(tuple, symbols.lookup_fuzzy(ids, index.symbols).collect()))
    assert want and sorted(map(tuple, symbols.lookup_fuzzy(ids, back.symbols, index=back.names).collect())) == want
    store.save(dataclasses.replace(index, names=None), str(tmp_path), "r")
    assert store.load(spark, str(tmp_path), "r").names is None


def test_symbols_of_whole_modules(spark):
    """Definitions, their lines, parents, bases, and the calls within them, against a walk of each module's tree."""
    import argparse
    import ast
    import dataclasses as dc
    import json.decoder
    import textwrap

    texts = {m.__name__: open(m.__file__, encoding="utf-8").read() for m in (argparse, dc, json.decoder, textwrap)}
    files = spark.createDataFrame([(k, "python", v) for k, v in texts.items()] + [("empty.py", "python", ""), ("none.txt", None, "x")], "file_path string, language string, source_code string")
    found = rows(extract.raw_symbols(files))
    defs = (ast.FunctionDef, ast.AsyncFunctionDef)
    want = {}
    for path, text in texts.items():
        for node in ast.parse(text).body:
            for n, parent in [(node, None)] + [(m, node.name) for m in (node.body if isinstance(node, ast.ClassDef) else []) if isinstance(m, defs)]:
                if isinstance(n, (*defs, ast.ClassDef)):
                    inner = [] if isinstance(n, ast.ClassDef) else [x.func for part in (n.args, n.returns, *n.body) if part for x in ast.walk(part) if isinstance(x, ast.Call)]
                    calls = {f.attr if isinstance(f, ast.Attribute) else f.id for f in inner if isinstance(f, ast.Attribute | ast.Name)}
                    want[(path, n.name, parent, n.lineno)] = (n.end_lineno, frozenset(calls), len(n.decorator_list), ast.get_source_segment(text, n))
    got = {(r["file_path"], r["name"], r["parent"], r["line_start"]): (r["line_end"], frozenset(r["calls"]), len(r["decorators"]), r["source_code"]) for r in found if r["kind"] in ("function", "class")}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert len(want) > 200 and all(len(r["calls"]) == len(set(r["calls"])) for r in found)
    seqs = [(r["file_path"], r["seq"]) for r in found]
    assert len(seqs) == len(set(seqs)) and not any(r["file_path"] in ("empty.py", "none.txt") for r in found)
    by = {(r["file_path"], r["name"], r["parent"]): r for r in found}
    assert by[("argparse", "HelpFormatter", None)]["docstring"].startswith("Formatter for generating usage messages") and by[("textwrap", "fill", None)]["parameters"] == ["text", "width=70", "**kwargs"]


@pytest.mark.parametrize("language", ["python", "typescript"])
def test_files_of_one_partition_are_read_by_many_tasks(spark, language):
    text = "def f():\n    return g()\n" if language == "python" else "function f() {\n  return g();\n}\n"
    files = spark.range(0, 400, numPartitions=1).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"), F.lit(language).alias("language"), F.lit(text).alias("source_code"))
    flat = extract.nodes(extract.dealt(files)) if language == "python" else extract.raw_symbols(files)
    tasks = flat.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) < 400
    assert extract.raw_symbols(files).filter("name = 'f'").count() == 400
