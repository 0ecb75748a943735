"""Retrieval pages from symbols and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

VARIABLE_LENGTH, FILE_CHARS = 20, 2000
COLUMNS = ("page_id", "symbol_id", "symbol_name", "qualified_name", "symbol_type", "file_path", "source_code", "docstring", "signature", "line_start", "line_end", "token_count", "language", "calls", "ord")


def worthy() -> Column:
    """Functions, methods and classes, and variables with more than a few letters; never imports."""
    return F.col("type").isin("function", "method", "class") | ((F.col("type") == "variable") & (F.length("source_code") > VARIABLE_LENGTH))


def last_of(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The last row of each key, by a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def from_symbols(symbols: DataFrame) -> DataFrame:
    rows = symbols.filter(worthy()).select(
        F.col("symbol_id").alias("page_id"), "symbol_id", F.col("name").alias("symbol_name"), "qualified_name", F.col("type").alias("symbol_type"),
        "file_path", "source_code", "docstring", "signature", "line_start", "line_end", T.token_estimate(F.col("source_code")).alias("token_count"), "language", "calls", "ord",
    )
    return last_of(rows, "page_id")


def from_files(files: DataFrame, pages: DataFrame) -> DataFrame:
    """A page for each file without one: its first 2000 characters, counted by its whole text."""
    alone = files.join(pages.select("file_path").distinct(), "file_path", "left_anti")
    name = T.basename(F.col("file_path"))
    return alone.select(
        T.file_page_id(F.col("file_path")).alias("page_id"), F.concat(F.lit("file::"), "file_path").alias("symbol_id"), name.alias("symbol_name"), name.alias("qualified_name"),
        F.lit("file").alias("symbol_type"), "file_path", F.substring("source_code", 1, FILE_CHARS).alias("source_code"), F.lit(None).cast("string").alias("docstring"),
        F.lit(None).cast("string").alias("signature"), F.lit(1).alias("line_start"), F.col("line_count").cast("int").alias("line_end"),
        T.token_estimate(F.col("source_code")).alias("token_count"), "language", F.array().cast("array<string>").alias("calls"), "ord",
    )


def build(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    own = from_symbols(symbols)
    return own if files is None else last_of(own.unionByName(from_files(files, own)), "page_id")


def by_id(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The pages of a set of page ids (column page_id)."""
    return pages.join(ids.select("page_id").distinct(), "page_id", "left_semi")


def by_symbol(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The pages of a set of symbols (column symbol_id)."""
    return pages.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi")


def searchable_text(prefix: str = "") -> Column:
    """Name, qualified name, docstring, signature, source and path by lines; empty optional parts are left out."""
    c = lambda n: F.col(prefix + n)
    return F.concat_ws("\n", c("symbol_name"), c("qualified_name"), F.nullif(c("docstring"), F.lit("")), F.nullif(c("signature"), F.lit("")), c("source_code"), c("file_path"))
