"""Scanning a source repository into a files table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is scanned, how large a file may be, what is passed over, and the languages by extension.
EXTENSIONS = (".py", ".js", ".ts", ".go", ".java", ".cpp", ".rs")
MAX_BYTES = 1_000_000
IGNORED = ("__pycache__", ".git", "node_modules", ".tox", ".eggs", "*.pyc", "*.egg-info", "dist", "build", ".venv", "venv")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".go": "go",
    ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".rs": "rust",
}
#: Languages with an extractor; files in others are scanned over.
PARSED = ("python", "javascript", "typescript")


def extension(path: Column) -> Column:
    """The part from the last dot of the file's name; a leading dot makes none."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    """The language of a file by its extension in any case, null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(extension(path)))


def pruned(directories: Column) -> Column:
    """True where a directory on the way equals an ignored name or ends with it, taken literally."""
    one = lambda d: F.lit(False)
    for p in IGNORED:
        one = (lambda before, p: lambda d: before(d) | (d == p) | d.endswith(p))(one, p)
    return F.exists(directories, one)


def wanted(path: Column) -> Column:
    """Which files below the root are read; ``path`` is relative to it."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    out = extension(path).isin(*EXTENSIONS) & ~pruned(F.slice(parts, 1, F.size(parts) - 1))
    for p in IGNORED:
        if "*" in p:
            out = out & ~name.endswith(p.lstrip("*"))
    return out


def scan(spark: SparkSession, root: str, absolute: bool = False) -> DataFrame:
    """files: file_path (below the root, or absolute), language, source_code, line_count.

    Sizes are filtered in the listing, so that large files are never opened.
    """
    local = root.removeprefix("file://")
    if "://" not in root and not os.path.isdir(local):
        raise ValueError(f"not a directory: {root}")
    top = root.rstrip("/") if "://" in root else f"file:{os.path.realpath(local)}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= MAX_BYTES)
    below = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(top.replace("file:///", "file:/")) + 2, 1 << 30)
    rows = raw.withColumn("rel", below).filter(wanted(F.col("rel")))
    rows = rows.select("rel", "path", language(F.col("rel")).alias("language"), "content")
    rows = rows.filter(F.col("language").isin(*PARSED))

    @F.pandas_udf("string")
    def text(content):
        """UTF-8 with replacement characters for faults, and line feeds only."""
        return content.map(lambda b: bytes(b).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))

    rows = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("full"), "rel", "language", text("content").alias("source_code"))
    return rows.select(
        (F.col("full") if absolute else F.col("rel")).alias("file_path"), "language", "source_code",
        (F.length("source_code") - F.length(F.replace("source_code", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line_count"),
    )

