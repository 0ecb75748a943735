"""Set operations, keep-last, ranking, scanning, saving and loading as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import fusion, graph, lexical, pages
from corvane.sources import adapters as A
from corvane.sources import repository, store
from corvane.storage import materialize, new_path

from .queries_lexical import WORDS
from .queries_retrieval import _INDEX, DIMENSION, saved_index

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


_GEO = "e AS (SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"


@query(f"WITH {_GEO} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def set_neighbourhood(spark, sf_dir):
    """Successors and predecessors of every node as one set."""
    return graph.undirected(A.geo_edges(spark, sf_dir))


@query("SELECT o_custkey AS query_id, o_orderkey AS page_id FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 150000")
def set_union(spark, sf_dir):
    """The candidates of two lists, once each."""
    rows = A.table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "query_id", "o_orderkey": "page_id"})
    return fusion.candidates([rows.filter("o_orderstatus = 'F'"), rows.filter("o_totalprice > 150000")])


@query("SELECT l_orderkey AS id, l_partkey AS part, l_linenumber AS ord FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1")
def win_keep_last(spark, sf_dir):
    """The last row of each key wins; equal places are settled by the part."""
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("ord"))
    order = rows.withColumn("place", F.struct("ord", "part"))
    return pages.last_of(order, "id", order="place").select("id", "part", "ord")


@query("""
SELECT o_custkey AS query_id, o_orderkey AS page_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1)::INT AS rank FROM orders QUALIFY rank < 3""")
def win_rank(spark, sf_dir):
    """The best three a group."""
    rows = A.table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "query_id", "o_orderkey": "page_id", "o_totalprice": "score"})
    return lexical.top_k(rows, 3).select("query_id", "page_id", "rank")


@query("SELECT source || '/' || lang || '/' || doc_id AS file_path, source AS symbol_name, length(text)::INT AS n FROM documents")
def snk_round_trip(spark, sf_dir):
    """Pages written to the shared folder and read back."""
    return materialize(A.pages(spark, sf_dir), "pages").select("file_path", "symbol_name", F.length("source_code").alias("n"))


# --- an index over the parts' names, saved once and loaded by each query


@query(f"WITH {_INDEX} SELECT id::VARCHAR AS symbol_id, name, qn AS qualified_name, type, file_path, code AS source_code, doc AS docstring, sig AS signature FROM sym")
def snk_symbols(spark, sf_dir):
    return saved_index(spark, sf_dir).symbols.select("symbol_id", "name", "qualified_name", "type", "file_path", "source_code", "docstring", "signature")


@query(f"WITH {_INDEX} SELECT doc_id::VARCHAR AS page_id, md5(text) AS digest FROM documents2")
def snk_pages(spark, sf_dir):
    return saved_index(spark, sf_dir).pages.select("page_id", F.md5(pages.searchable_text()).alias("digest"))


@query(f"WITH {_INDEX} SELECT 'node' AS kind, id AS a, '' AS b, 0.0::DOUBLE AS weight FROM nd UNION ALL SELECT 'edge', src, dst, weight FROM e")
def snk_graph(spark, sf_dir):
    index: store.Index = saved_index(spark, sf_dir)
    nodes = index.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("weight"))
    return nodes.unionByName(index.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight"))


@query(f"""WITH {_INDEX}, t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS t FROM documents2), p AS (SELECT t, doc_id, count(*) AS tf FROM t GROUP BY 1, 2)
SELECT t AS term, doc_id::VARCHAR AS page_id, tf::INT AS tf, (count(*) OVER (PARTITION BY t))::BIGINT AS df FROM p""")
def snk_postings(spark, sf_dir):
    return saved_index(spark, sf_dir).lexical.postings.select("term", "page_id", "tf", "df")


@query(f"WITH {_INDEX} SELECT doc_id::VARCHAR AS page_id, {DIMENSION}::INT AS dimension, false AS zero FROM documents2")
def snk_vectors(spark, sf_dir):
    """Every page has its vector; the hashed words in it are compared in a test."""
    found = saved_index(spark, sf_dir).embeddings
    return found.select("page_id", F.size("embedding").alias("dimension"), (~F.exists("embedding", lambda x: x != 0)).alias("zero"))


def _folder(spark, sf_dir) -> str:
    """A source file a nation, in folders of which some are passed over; a dozen small files, written by the driver."""
    root = new_path(spark, "sources")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        k = r["n_nationkey"]
        folder, ending = ("app", "node_modules", "rebuild", "web")[k % 4], (".py", ".js", ".rs", ".tsx", ".ts")[k % 5]
        out = fs.create(hadoop.Path(f"{root}/{folder}/n{k}{ending}"))
        out.write(f"x = '{r['n_name']}'\r\n".encode() * (k + 1))
        out.close()
    return root


@query("""
WITH f AS (SELECT n_nationkey AS k, ['app', 'node_modules', 'rebuild', 'web'][n_nationkey % 4 + 1] AS d, ['.py', '.js', '.rs', '.tsx', '.ts'][n_nationkey % 5 + 1] AS x, n_name FROM nation)
SELECT d || '/n' || k || x AS file_path, CASE x WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'typescript' END AS language, (k + 2)::INT AS line_count,
  md5(repeat('x = ''' || n_name || '''' || chr(10), k + 1)) AS digest FROM f WHERE d IN ('app', 'web') AND x IN ('.py', '.js', '.ts')""")
def src_scan(spark, sf_dir):
    files: DataFrame = repository.scan(spark, _folder(spark, sf_dir))
    return files.select("file_path", "language", "line_count", F.md5("source_code").alias("digest"))


@query("""
WITH f AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS n FROM pages), x AS (SELECT page_id, ['.py', '.js', '.ts', '.jsx', '.tsx', '.go', '.java', '.cpp', '.cc', '.c', '.rs', '.txt'][page_id % 12 + 1] AS x FROM f)
SELECT page_id, CASE x WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.cc' THEN 'cpp' WHEN '.rs' THEN 'rust' WHEN '.txt' THEN NULL ELSE x[2:] END AS language FROM x""")
def src_language(spark, sf_dir):
    """A file name for each page, in capitals every other time."""
    endings = F.array(*[F.lit(x) for x in (*repository.LANGUAGES, ".txt")])
    ending = F.element_at(endings, (F.col("page_id") % 12 + 1).cast("int"))
    path = F.concat(F.lit("src/a.b/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, F.upper(ending)).otherwise(ending))
    return A.table(spark, sf_dir, "pages").select("page_id", repository.language(path).alias("language"))


@query(f"""WITH {_INDEX}, t AS (SELECT DISTINCT name, qn, lower(concat_ws(chr(10), name, qn)) AS t FROM sym),
g AS (SELECT DISTINCT name, qn, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, greatest(length(t) - k, 0) + 2), lambda i: t[i:i + k - 1])))) AS gram, t FROM t)
SELECT gram, name, qn AS qualified_name, (count(*) OVER (PARTITION BY gram))::BIGINT AS n FROM g WHERE gram <> ''""")
def snk_names(spark, sf_dir):
    """The saved index of names, with the number of names under each run of letters."""
    names = saved_index(spark, sf_dir).names
    return names.grams.join(names.counts, "gram")
