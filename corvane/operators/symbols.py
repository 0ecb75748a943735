"""Symbol lookup by name: exact, fuzzy, exact else fuzzy, and word search.

symbols: symbol_id, name, qualified_name, type, file_path and more columns.
names to look up: query_id, ident.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.storage import beside, materialize

FUZZY_LIMIT, FUZZY_USED = 20, 5
EXACT_WEIGHT, FUZZY_WEIGHT = 1.0, 0.5


def like(column: Column, part: Column) -> Column:
    """ASCII case-insensitive LIKE %part%; ``_`` and ``%`` in the part are wildcards, a backslash is a backslash."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.call_function("like", lower(column), F.concat(F.lit("%"), F.replace(lower(part), F.lit("\\"), F.lit("\\\\")), F.lit("%")))


def names(symbols: DataFrame) -> DataFrame:
    """(key, symbol_id): each symbol under its name and its qualified name."""
    return symbols.select(F.col("name").alias("key"), "symbol_id").union(symbols.select(F.col("qualified_name").alias("key"), "symbol_id")).distinct()


def lookup(idents: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, ident, symbol_id) where a name or a qualified name equals the ident: equi-joins, not one on OR."""
    keys = symbols.select(F.explode(F.array("name", "qualified_name")).alias("ident"), "symbol_id")
    asked = idents.select("query_id", "ident").distinct()
    return keys.join(beside(asked), "ident").select("query_id", "ident", "symbol_id").distinct()


def _lower(c: Column | str) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _grams(text: Column) -> Column:
    """Distinct runs of one to three letters."""

    def runs(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, size))
        return F.filter(every, lambda g: F.length(g) == size)

    return F.array_distinct(F.flatten(F.array(runs(1), runs(2), runs(3))))


@dataclass
class NameIndex:
    """Distinct names by the runs of one to three letters that they hold.

    grams: gram, name, qualified_name. counts: gram, n (names under it). It
    is saved with the other tables of a repository; lookups read it and build
    nothing.
    """

    grams: DataFrame
    counts: DataFrame


def name_index(symbols: DataFrame) -> NameIndex:
    """The index of all names. A symbol without a name is left out; a null qualified name holds nothing."""
    pairs = symbols.select("name", "qualified_name").distinct().filter("name IS NOT NULL OR qualified_name IS NOT NULL")
    grams = pairs.select(F.explode(_grams(_lower(F.concat_ws("\n", "name", "qualified_name")))).alias("gram"), "name", "qualified_name")
    return NameIndex(grams, grams.groupBy("gram").agg(F.count("*").alias("n")))


def named(symbols: DataFrame, idents: DataFrame, index: NameIndex | None = None) -> DataFrame:
    """(ident, name, qualified_name) of the distinct names that hold an ident (column ident, distinct).

    An ident is looked up under the rarest gram of its literal parts (a run
    of three letters where it has one, down to a single letter), and what
    stands there is tested. An ident of wildcards alone asks for a length:
    such idents are one for each length when they meet the names.
    """
    index = index or name_index(symbols)
    holds = like(F.col("name"), F.col("ident")) | like(F.col("qualified_name"), F.col("ident"))
    literal = F.split(_lower(F.col("ident")), "[_%]")
    asked = idents.select("ident", F.array_distinct(F.flatten(F.transform(literal, _grams))).alias("grams"))
    under = asked.select("ident", F.explode("grams").alias("gram")).join(index.counts, "gram", "left")
    under = under.groupBy("ident").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
    found = index.grams.join(under, "gram").filter(holds)
    wild = asked.filter(F.size("grams") == 0).select("ident", (F.length("ident") - F.length(F.replace("ident", F.lit("_"), F.lit("")))).alias("least"))
    longest = F.greatest(F.coalesce(F.length("name"), F.lit(-1)), F.coalesce(F.length("qualified_name"), F.lit(-1)))
    pairs = symbols.select("name", "qualified_name").distinct().withColumn("longest", longest)
    rest = pairs.join(wild.select("least").distinct(), F.col("longest") >= F.col("least")).join(wild, "least")
    return found.select("ident", "name", "qualified_name").unionByName(rest.select("ident", "name", "qualified_name"))


def _first_of_names(symbols: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(name, qualified_name, symbol_id) of the names in ``pairs``: of the symbols that share both, the ``most`` with the smallest ids."""
    both = ["name", "qualified_name"]
    rows = symbols.select(*both, "symbol_id").join(beside(pairs.select(*both).distinct()), both, "left_semi")
    order = Window.partitionBy(*both).orderBy("symbol_id")
    return rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most).drop("at")


def lookup_fuzzy(idents: DataFrame, symbols: DataFrame, limit: int = FUZZY_LIMIT, index: NameIndex | None = None) -> DataFrame:
    """(query_id, ident, symbol_id, place): names that hold the ident, shorter ones first, ties by id.

    Idents are looked up once each, whatever number of queries ask for them.
    Names are looked at once each, too: a name that thousands of symbols share
    is matched once, and the first ``limit`` of its symbols are joined back by
    equality: of those that share both names, no others can count.
    """
    hits = materialize(named(symbols, idents.select("ident").distinct(), index), "named")
    ids = _first_of_names(symbols, hits, limit).join(beside(hits), ["name", "qualified_name"])
    order = Window.partitionBy("ident").orderBy(F.length("name"), "symbol_id")
    best = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("ident", "symbol_id", "place")
    return idents.select("query_id", "ident").distinct().join(best, "ident").select("query_id", "ident", "symbol_id", "place")


def exact_else_fuzzy(idents: DataFrame, symbols: DataFrame, used: int = FUZZY_USED, index: NameIndex | None = None) -> DataFrame:
    """(query_id, ident, symbol_id, weight): exact hits, and the first fuzzy ones of idents without any exact hit."""
    exact = materialize(lookup(idents, symbols), "exact")
    missing = idents.join(beside(exact.select("query_id", "ident").distinct()), ["query_id", "ident"], "left_anti")
    fuzzy = lookup_fuzzy(missing, symbols, index=index).filter(F.col("place") <= used)
    return exact.withColumn("weight", F.lit(EXACT_WEIGHT)).unionByName(fuzzy.drop("place").withColumn("weight", F.lit(FUZZY_WEIGHT)))


def page_scores(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, page_id, symbol_id, score): weights summed per page; symbols without a page go."""
    rows = pages.select("page_id", "symbol_id").join(beside(materialize(hits, "hits")), "symbol_id")
    return rows.groupBy("query_id", "page_id").agg(F.first("symbol_id").alias("symbol_id"), F.sum("weight").alias("score"))


def search(queries: DataFrame, symbols: DataFrame, k: int = 10, index: NameIndex | None = None) -> DataFrame:
    """(query_id, symbol_id, match_count, rank) of symbols whose names hold a word (three letters or more) of the query."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split("query", r"\s+"), lambda w: F.length(w) > 2))).alias("ident"))
    hits = named(symbols, words.select("ident").distinct(), index)
    asked = materialize(hits.join(words, "ident").select("query_id", "name", "qualified_name").distinct(), "named")
    ids = _first_of_names(symbols, asked, k).join(beside(asked), ["name", "qualified_name"])
    order = Window.partitionBy("query_id").orderBy(F.length("name"), "symbol_id")
    ranked = ids.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
    return ranked.select("query_id", "symbol_id", F.lit(1).alias("match_count"), "rank")


def by_type(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.filter(F.col("type") == kind)


def in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.filter(F.col("file_path") == path)


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter((F.col("name") == name) | (F.col("qualified_name") == name))


def by_id(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """The symbols of a set of ids (column symbol_id): one join, not one lookup an id."""
    return symbols.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi")


def index_rows(symbols: DataFrame) -> DataFrame:
    """The nine columns that a symbol is looked up by or shown with."""
    return symbols.select("symbol_id", "name", "qualified_name", "type", "file_path", "line_start", "line_end", "signature", "docstring")
