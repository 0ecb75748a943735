"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of two tokens in four languages of prose."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_id").alias("page_id"), F.col("doc_id").alias("symbol_id"), F.col("source").alias("symbol_name"), F.concat_ws(".", "source", "lang").alias("qualified_name"),
        F.lit("function").alias("symbol_type"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("source_code"),
        none.alias("docstring"), none.alias("signature"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.col("lang").alias("language"), F.array().cast("array<string>").alias("calls"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols: few names, many symbols each."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"),
        F.when(F.col("p_size") % 5 == 0, "import").when(F.col("p_size") % 5 == 1, "variable").when(F.col("p_size") % 5 == 2, "class").otherwise("function").alias("type"),
        F.col("p_brand").alias("file_path"), F.col("p_type").alias("language"), F.concat_ws(" ", "p_name", F.lit("="), "p_type", F.col("p_size").cast("string")).alias("source_code"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("docstring"), F.when(F.col("p_size") % 4 == 0, F.lit(None)).otherwise(F.concat_ws(" ", F.lit("def"), "p_name")).alias("signature"),
        F.lit(1).alias("line_start"), F.col("p_size").alias("line_end"), F.array().cast("array<string>").alias("calls"), F.col("p_partkey").alias("ord"),
    )


def identifier_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): names with camel and snake parts."""
    p = table(spark, sf_dir, "part")
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    parts = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(camel, F.lit("_"), "p_type", F.lit(" = self."), F.col("p_name"), F.lit("(x, if)")).alias("text"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat("n_name", F.lit(" the HTTPServer getURLOf")).alias("text"))
    return parts.unionByName(nations)


def idents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, ident): exact names, parts of names in another case, wildcards and unknown ones."""
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    exact = n.select(F.concat(F.lit("e:"), "p_name").alias("query_id"), F.col("p_name").alias("ident"))
    part = n.select(F.concat(F.lit("f:"), "p_name").alias("query_id"), F.upper(F.substring_index("p_name", " ", -1)).alias("ident"))
    wild = n.select(F.concat(F.lit("w:"), "p_name").alias("query_id"), F.concat(F.substring("p_name", 1, 2), F.lit("_"), F.substring("p_name", 4, 3)).alias("ident"))
    return exact.unionByName(part).unionByName(wild).unionByName(n.select(F.concat(F.lit("e:"), "p_name").alias("query_id"), F.lit("nothing here").alias("ident")))


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier and customer to nation, nation to region."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select(key("S", "s_suppkey").alias("src"), key("N", "s_nationkey").alias("dst"), F.lit("CALLS").alias("type"), F.lit(1.0).alias("weight"))
    c = table(spark, sf_dir, "customer").select(key("C", "c_custkey").alias("src"), key("N", "c_nationkey").alias("dst"), F.lit("DEFINED_IN").alias("type"), F.lit(0.5).alias("weight"))
    n = table(spark, sf_dir, "nation").select(key("N", "n_nationkey").alias("src"), key("R", "n_regionkey").alias("dst"), F.lit("CALLS").alias("type"), F.lit(0.8).alias("weight"))
    return s.unionByName(c).unionByName(n)


def geo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("supplier", "S", "s_suppkey", "s_name", "function"), ("customer", "C", "c_custkey", "c_name", "method"), ("nation", "N", "n_nationkey", "n_name", "class"), ("region", "R", "r_regionkey", "r_name", "file")]
    rows = [table(spark, sf_dir, t).select(key(p, k).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("type"), F.lit(t).alias("file_path")) for t, p, k, n, kind in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def trade_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose calls, bases, parents and type hints are names of others: several edges for one pair."""
    p = table(spark, sf_dir, "part")
    other = lambda n: F.concat(F.lit("f"), ((F.col("p_partkey") * n + 1) % 97).cast("string"))
    none = F.array().cast("array<string>")
    return p.select(
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("symbol_id"), F.concat(F.lit("f"), F.expr("p_partkey div 4").cast("string")).alias("name"),
        F.concat("p_brand", F.lit(".f"), F.expr("p_partkey div 4").cast("string")).alias("qualified_name"), F.when(F.col("p_size") % 5 == 0, F.lit("class")).otherwise(F.lit("function")).alias("type"),
        F.col("p_brand").alias("file_path"), F.array(other(3), other(5)).alias("calls"), F.when(F.col("p_size") % 5 == 0, F.array(other(7))).otherwise(none).alias("base_classes"),
        F.when(F.col("p_size") % 7 == 0, other(11)).alias("parent"), F.when(F.col("p_size") % 2 == 0, F.array(other(3))).otherwise(none).alias("type_hints"), F.col("p_partkey").alias("ord"),
        F.lit(1).alias("line_start"), F.lit(2).alias("line_end"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, predicted, truth): each turn and the next one's text, which repeats it with other spaces every third time."""
    a = table(spark, sf_dir, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    rows = a.select("conv_id", "turn", F.col("text").alias("predicted")).join(b, ["conv_id", "turn"])
    return rows.withColumn("truth", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("  "), F.replace("predicted", F.lit(" "), F.lit("   ")))).otherwise(F.col("truth")))
