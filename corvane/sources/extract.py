"""Files to symbols: Python by the flat nodes of its syntax tree, JavaScript by a small scanner.

A task only reads a Python file into rows (definitions, their parts, calls);
which node belongs to which symbol, and what a symbol holds, is worked out by
a window and an aggregate over these rows.

One row a symbol, in the order functions, classes with their methods, imports,
variables. Only what stands directly in a module counts; calls within nested
code count for what encloses it. A file with faulty lines gives the symbols of
the others, and one row in ``errors()`` for the first fault.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.storage import materialize

from . import javascript

# Annotations that name no type of the code at hand.
PLAIN_TYPES = frozenset(("Optional", "Union", "List", "Dict", "Set", "Tuple", "str", "int", "float", "bool", "Any"))
PREVIEW = 100
RAW = (
    "file_path string, language string, seq int, kind string, name string, parent string, line_start int, line_end int, source_code string, docstring string, "
    "parameters array<string>, returns string, calls array<string>, base_classes array<string>, decorators array<string>, type_hints array<string>, names array<string>"
)


class _Source:
    """Text of nodes by lines and UTF-8 columns."""

    def __init__(self, text: str) -> None:
        self.lines = [line.encode("utf-8", "replace") for line in text.split("\n")]

    def cut(self, line: int, column: int, end_line: int, end_column: int) -> str:
        rows = self.lines[line - 1 : end_line]
        rows[-1] = rows[-1][:end_column]
        rows[0] = rows[0][column:]
        return b"\n".join(rows).decode("utf-8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.cut(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)


def _callee(node: ast.expr) -> str | None:
    """The name that is called: what stands after the last dot. Calls of other expressions have none."""
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else None


#: Faulty lines of one file that are set aside at most; with more, the file has no symbols.
MAX_FAULTS = 200


def parse(text: str) -> tuple[ast.Module, list[SyntaxError]]:
    """The tree of a file and its faults.

    A line that doesn't parse is replaced by ``pass`` in the tree (the source
    keeps it), the line before it where that doesn't help, and so on: the rest
    of the file has its symbols all the same.
    """
    lines, faults, gone = text.split("\n"), [], set()
    while True:
        try:
            return ast.parse("\n".join(lines)), faults
        except SyntaxError as fault:
            at = min(len(lines), fault.lineno or 1) - 1
            while at >= 0 and (at in gone or not lines[at].strip()):
                at -= 1
            if at < 0 or len(faults) >= MAX_FAULTS:
                raise faults[0] if faults else fault from None
            faults.append(fault)
            gone.add(at)
            lines[at] = lines[at][: len(lines[at]) - len(lines[at].lstrip())] + "pass"


class _Nodes:
    """The nodes of a file that symbols are made of, in the order of the tree: a row holds the rows up to ``last``."""

    def __init__(self, text: str) -> None:
        self.rows: list[tuple] = []
        tree, faults = parse(text)
        self.source = _Source(text)
        for node in tree.body:
            self.statement(node)
        if faults:
            self.rows.append(_fault(faults[0], len(self.rows)))

    def add(self, kind: str, name: str | None = None, node: ast.AST | None = None, text: str | None = None) -> None:
        n = len(self.rows)
        self.rows.append((n, n, kind, name, node and node.lineno, node and node.end_lineno, text))

    def written(self, kind: str, node: ast.AST | None) -> None:
        if node is not None:
            self.add(kind, text=self.source.of(node))

    def statement(self, node: ast.stmt) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            self.definition(node)
        elif isinstance(node, ast.Import):
            self.add("import", node.names[0].name, node)
            if node.names[0].asname:
                self.add("as", node.names[0].asname)
        elif isinstance(node, ast.ImportFrom):
            self.add("from", "." * node.level + (node.module or ""), node)
            for name in node.names:
                self.add("member", name.name)
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name):
                self.add("variable", target.id, node)
                self.written("value", node.value)

    def definition(self, node) -> None:
        at = len(self.rows)
        self.add("class" if isinstance(node, ast.ClassDef) else "function", node.name, node, self.source.of(node))
        for d in node.decorator_list:
            self.written("decorator", d)
        first = node.body[0]
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            self.written("docstring", first.value)
        if isinstance(node, ast.ClassDef):
            for b in node.bases:
                if isinstance(b, ast.Name | ast.Attribute):
                    self.written("base", b)
            for child in node.body:
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                    self.definition(child)
        else:
            self.parameters(node.args)
            self.written("returns", node.returns)
            for part in (node.args, node.returns, *node.body, *getattr(node, "type_params", ())):
                self.calls(part)
        self.rows[at] = (at, len(self.rows) - 1, *self.rows[at][2:])

    def parameters(self, args: ast.arguments) -> None:
        plain = args.posonlyargs + args.args
        every = [(a, d, "") for a, d in zip(plain, [None] * (len(plain) - len(args.defaults)) + list(args.defaults), strict=True)]
        every += [(args.vararg, None, "*")] if args.vararg else []
        every += [(a, d, "") for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
        every += [(args.kwarg, None, "**")] if args.kwarg else []
        for arg, default, stars in every:
            last = default or arg
            self.add("parameter", text=stars + self.source.cut(arg.lineno, arg.col_offset, last.end_lineno, last.end_col_offset))
            self.written("annotation", arg.annotation)

    def calls(self, node: ast.AST | None) -> None:
        if isinstance(node, ast.Call) and (name := _callee(node.func)):
            self.add("call", name)
        for child in ast.iter_child_nodes(node) if node is not None else ():
            self.calls(child)


NODE = "file_path string, language string, n int, last int, kind string, name string, line_start int, line_end int, text string"


def _fault(fault: Exception, n: int = 0) -> tuple:
    line = getattr(fault, "lineno", None) or 1
    return (n, n, "error", type(fault).__name__, line, line, str(fault))


def _flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in NODE.split(", ")]
    for batch in batches:
        rows = []
        for path, language, text in zip(batch["file_path"], batch["language"], batch["source_code"], strict=True):
            try:
                found = _Nodes(text).rows
            except (SyntaxError, ValueError, RecursionError, MemoryError) as fault:  # the last two: too deeply nested
                found = [_fault(fault)]
            rows += [(path, language, *row) for row in found]
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({"line_start": "Int32", "line_end": "Int32"})


def nodes(files: DataFrame) -> DataFrame:
    """The flat nodes of Python files; a path stands for one file."""
    return files.select("file_path", "language", "source_code").mapInPandas(_flat, NODE)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _unquoted(raw: Column) -> Column:
    """A docstring without its quotes."""
    body = F.regexp_replace(raw, "^[\"']+|[\"']+$", "")
    for quotes in ('"""', "'''"):
        body = F.when(raw.startswith(quotes) & raw.endswith(quotes), raw.substr(F.lit(4), F.length(raw) - 6)).otherwise(body)
    return _strip(body)


def python_symbols(flat: DataFrame) -> DataFrame:
    """Raw symbols of flat nodes: one shuffle by file, then each node goes to the definition around it.

    A window gives every node the last symbol and the last class that began
    before it; it belongs to these where it lies within them. What a symbol
    holds is then one aggregate of its nodes, in their order.
    """
    c = F.col
    place = F.struct("n", "last", "name", "kind")
    before = Window.partitionBy("file_path").orderBy("n")
    symbol = c("kind").isin("function", "class", "import", "from", "variable", "error")
    near = flat.withColumn("owner", F.last(F.when(symbol, place), ignorenulls=True).over(before)).withColumn("class", F.last(F.when(c("kind") == "class", place), ignorenulls=True).over(before))
    inside = symbol | (c("n") <= c("owner.last")) | c("owner.kind").isin("import", "from", "variable")

    def one(kind: str, column: str) -> Column:
        return F.max(F.when(c("kind") == kind, c(column)))

    def every(kind: str, column: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(c("kind") == kind, F.struct("n", c(column).alias("x")))))
        return F.transform(listed, lambda x: x["x"])

    def own(column: str) -> Column:
        return F.max(F.when(symbol, c(column)))

    held = near.filter(inside).withColumn("of", c("owner.n")).groupBy("file_path", "language", "of").agg(
        own("kind").alias("kind"), own("name").alias("name"), own("line_start").alias("line_start"), own("line_end").alias("line_end"), own("text").alias("text"),
        F.max(F.when((c("kind") == "function") & (c("n") <= c("class.last")), c("class.name"))).alias("parent"), one("docstring", "text").alias("docstring"), one("value", "text").alias("value"),
        one("as", "name").alias("as"), every("parameter", "text").alias("parameters"), one("returns", "text").alias("returns"), every("call", "name").alias("calls"), every("base", "text").alias("base_classes"),
        every("decorator", "text").alias("decorators"), every("annotation", "text").alias("annotations"), every("member", "name").alias("names"),
    )
    private = (c("kind") == "variable") & c("name").startswith("_") & ~c("name").startswith("__")
    future = (c("kind") == "from") & (c("name") == "__future__")
    words = F.flatten(F.transform("annotations", lambda t: F.regexp_extract_all(t, F.lit(r"(?U)[a-zA-Z_]\w*"), F.lit(0))))
    block = F.when(c("kind") == "error", 4).when(c("kind") == "variable", 3).when(c("kind").isin("import", "from"), 2).when((c("kind") == "class") | c("parent").isNotNull(), 1).otherwise(0)
    return held.filter(~private & ~future).select(
        "file_path", "language", (block * F.lit(100_000_000) + c("of")).cast("int").alias("seq"), F.when(c("kind") == "from", F.lit("import")).otherwise(c("kind")).alias("kind"),
        F.when(c("as").isNotNull(), F.concat("name", F.lit(" as "), "as")).otherwise(c("name")).alias("name"), "parent", "line_start", "line_end",
        F.when(c("kind") == "variable", F.substring("value", 1, PREVIEW)).otherwise(c("text")).alias("source_code"), _unquoted(c("docstring")).alias("docstring"), "parameters", "returns",
        F.array_distinct("calls").alias("calls"), "base_classes", "decorators", F.filter(words, lambda w: ~w.isin(*sorted(PLAIN_TYPES))).alias("type_hints"), "names",
    )


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RAW.split(", ")]
    for batch in batches:
        rows = []
        for path, language, text in zip(batch["file_path"], batch["language"], batch["source_code"], strict=True):
            try:
                found = javascript.symbols(text)
            except (ValueError, RecursionError) as fault:
                found = [dict(zip(("kind", "name", "line_start", "line_end", "source_code"), _fault(fault)[2:], strict=True))]
            rows += [{"file_path": path, "language": language, "seq": i} | f for i, f in enumerate(found)]
        if rows:
            table = pd.DataFrame(rows, columns=columns)
            for c in ("parameters", "calls", "base_classes", "decorators", "type_hints", "names"):
                table[c] = table[c].map(lambda v: v if isinstance(v, list) else [])
            yield table.astype(object).where(table.notna(), None)


#: Tasks a core that files are dealt to before they are read.
TASKS_A_CORE = 4


def dealt(files: DataFrame) -> DataFrame:
    """Files on all cores, by a hash of their paths: what they come from may be small and one task's work (a table of names, a list of paths), and reading them is not."""
    return files.repartition(TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism, "file_path")


def raw_symbols(files: DataFrame) -> DataFrame:
    """Raw rows of all files: Python's by their nodes, the others' by the scanner. A path stands for one file."""
    files = dealt(files.select("file_path", "language", "source_code"))
    python = F.coalesce(F.col("language") == "python", F.lit(False))
    others = files.filter(~python).mapInPandas(_scan, RAW)
    return python_symbols(nodes(files.filter(python))).unionByName(others)


def errors(raw: DataFrame) -> DataFrame:
    return raw.filter("kind = 'error'").select("file_path", F.col("name").alias("error"), F.col("source_code").alias("message"))


def _ord(place: Column) -> Column:
    """The order of files by their paths, then of symbols within them, as a text that sorts so: nothing is numbered."""
    return F.concat("file_path", F.lit("\0"), place)


def to_symbols(raw: DataFrame) -> DataFrame:
    """symbols from raw rows: qualified names, types, signatures, ids and the order of all."""
    c = F.col
    some = lambda n: F.size(n) > 0
    kind = F.when((c("kind") == "function") & c("parent").isNotNull(), F.lit("method")).otherwise(c("kind"))
    qualified = F.when(c("parent").isNotNull(), F.concat_ws(".", "parent", "name")).otherwise(c("name"))
    definition = F.concat(F.lit("def "), "name", F.lit("("), F.array_join("parameters", ", "), F.lit(")"), F.when(c("returns").isNotNull(), F.concat(F.lit(" -> "), "returns")).otherwise(F.lit("")))
    of_class = F.concat(F.lit("class "), "name", F.when(some("base_classes"), F.concat(F.lit("("), F.array_join("base_classes", ", "), F.lit(")"))).otherwise(F.lit("")))
    code = (
        F.when(c("kind") == "import", F.concat(F.lit("import "), "name", F.when(some("names"), F.concat(F.lit(" ("), F.array_join("names", ", "), F.lit(")"))).otherwise(F.lit(""))))
        .when(c("kind") == "variable", F.concat("name", F.lit(" = "), F.coalesce("source_code", F.lit("..."))))
        .otherwise(c("source_code"))
    )
    end = F.when(c("kind").isin("import", "variable"), c("line_start")).otherwise(c("line_end"))
    return raw.filter("kind <> 'error'").select(
        T.symbol_id(c("file_path"), qualified, c("line_start")).alias("symbol_id"), "name", qualified.alias("qualified_name"), kind.alias("type"), "file_path", "line_start", end.alias("line_end"),
        code.alias("source_code"), "docstring", F.when(c("kind") == "function", definition).when(c("kind") == "class", of_class).alias("signature"), "parent", "calls", "base_classes",
        "decorators", "type_hints", "language", _ord(F.lpad(c("seq").cast("string"), 9, "0")).alias("ord"),
    )


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with ord, symbols, errors); sources are parsed once."""
    raw = materialize(raw_symbols(files), "raw-symbols")
    return files.withColumn("ord", _ord(F.lit(""))), to_symbols(raw), errors(raw)
