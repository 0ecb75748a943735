"""Scalar functions and metrics as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import metrics as M
from corvane.functions import text as T
from corvane.operators import evaluate
from corvane.sources import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
_SPLIT = T.SPLIT.replace("'", "''")
_ID_TEXT = """
 SELECT 'p' || p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || '_' || p_type || ' = self.' || p_name || '(x, if)' AS text FROM part
 UNION ALL SELECT 'n' || n_nationkey, n_name || ' the HTTPServer getURLOf' FROM nation"""


_WORDS = f"list_filter(string_split_regex(text, '{_SPLIT}'), lambda x: x <> '' AND lower(x) NOT IN ({_STOP}))"
_SMALL = f"lambda y: len(y) > 1 AND y NOT IN ({_STOP})"
_MARK = r"regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\1' || chr(1) || '\2', 'g'), '([A-Z])([A-Z][a-z])', '\1' || chr(1) || '\2', 'g')"
#: Code tokens of the words in ``ws``.
_PARTS = f"""flatten(list_transform(ws, lambda x: list_concat(
   CASE WHEN len(x) > 1 THEN [lower(x)] ELSE [] END,
   CASE WHEN contains({_MARK}, chr(1)) THEN list_filter(list_transform(string_split({_MARK}, chr(1)), lambda y: lower(y)), {_SMALL}) ELSE [] END,
   CASE WHEN contains(x, '_') THEN list_filter(list_transform(string_split_regex(x, '_+'), lambda y: lower(y)), {_SMALL}) ELSE [] END)))"""


@query(f"""
WITH t AS ({_ID_TEXT}),
w AS (SELECT id, {_WORDS} AS ws FROM t),
k AS (SELECT id, {_PARTS} AS ts FROM w)
SELECT id, array_to_string(ts, ' ') AS tokens, len(ts)::INT AS n_tokens FROM k""")
def str_tokenize_code(spark, sf_dir):
    rows = A.identifier_text(spark, sf_dir).withColumn("t", T.tokenize_code(F.col("text")))
    return rows.select("id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n_tokens"))


@query(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda w: w NOT IN (""" + _STOP + """)) AS t FROM documents)
SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t""")
def str_word_tokens(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select("doc_id", T.word_tokens(F.col("text"), T.STOPWORDS).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"""
WITH t AS ({_ID_TEXT}), r AS (SELECT id, regexp_extract_all(text, '[a-zA-Z0-9_]+') AS ws FROM t),
f AS (SELECT id, list_filter(ws, lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]+')) AS ws FROM r)
SELECT id, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') AS idents FROM f""")
def str_identifiers(spark, sf_dir):
    return A.identifier_text(spark, sf_dir).select("id", F.array_join(T.identifiers(F.col("text")), " ").alias("idents"))


@query(f"""
WITH t AS ({_ID_TEXT}), r AS (SELECT id, regexp_extract_all(text, '[a-zA-Z0-9_]+') AS ws FROM t)
SELECT id, array_to_string(list_transform(list_filter(ws, lambda w: regexp_full_match(w, '[a-zA-Z]{{4,}}')), lambda w: lower(w)), ' ') AS keywords FROM r""")
def str_keywords(spark, sf_dir):
    return A.identifier_text(spark, sf_dir).select("id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query("SELECT doc_id, (length(text) // 4)::INT AS tokens FROM documents")
def str_token_estimate(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT page_id, list_extract(string_split_regex(url, '[/\\]'), -1) AS base, replace(replace(lower(url), ' ', '_'), '+', '_') AS slug FROM pages")
def str_basename_slug(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.basename(F.col("url")).alias("base"), T.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, substr(sha256(source || '/' || lang || '::' || source || '::' || doc_id), 1, 16) AS symbol_id, substr(sha256('file::' || source || '/' || lang), 1, 16) AS file_page_id FROM documents")
def hsh_symbol_id(spark, sf_dir):
    path = F.concat_ws("/", "source", "lang")
    return A.table(spark, sf_dir, "documents").select("doc_id", T.symbol_id(path, F.col("source"), F.col("doc_id")).alias("symbol_id"), T.file_page_id(path).alias("file_page_id"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (props->>'k')::INT END AS k FROM events")
def jsn_parse(spark, sf_dir):
    """Every other answer is fenced, every seventh is no JSON."""
    e = A.table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("Sorry, "), "props")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone"))).otherwise(F.col("props"))
    return e.select("event_id", T.parse_json(answer, "k int")["k"].alias("k"))


# metrics: what cosine neighbours share the label of their query
_FOUND = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS q, d.vec_id AS d, d.label = q.label AS hit, round(list_dot_product(q.v, d.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-9) * (sqrt(list_dot_product(d.v, d.v)) + 1e-9)), 9) AS s
      FROM e q JOIN e d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT q, d, hit, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM p QUALIFY r <= 20),
rel AS (SELECT q.vec_id AS q, count(*)::DOUBLE AS n FROM e q JOIN e d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND q.label = d.label GROUP BY 1)
"""


def _found(spark, sf_dir):
    from corvane.operators import vector

    e = A.table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = vector.knn(e, q, 21, key="vec_id").filter("query_id <> page_id")
    found = hits.groupBy("query_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "page_id"))), lambda s: s["page_id"]), 1, 20).alias("found"))
    # relevant are all vectors of the label: they are counted, and listed only as far as they were found
    labels = e.select("vec_id", "label")
    asked = labels.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    totals = asked.join(labels.groupBy("label").agg((F.countDistinct("vec_id") - 1).alias("total")), "label").filter("total > 0").select("query_id", "total")
    own = hits.select("query_id", F.col("page_id").alias("vec_id")).join(labels, "vec_id").join(asked, ["query_id", "label"])
    relevant = own.groupBy("query_id").agg(F.collect_list("vec_id").alias("relevant"))
    return found.join(totals, "query_id").join(relevant, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<bigint>")))


def _metric(name, expression, sql):
    def run(spark, sf_dir):
        return _found(spark, sf_dir).select("query_id", F.round(expression(F.col("found"), F.col("relevant"), F.col("total")), 6).alias("value"))

    run.__name__ = name
    query(_FOUND + f"SELECT q AS query_id, round({sql}, 6) AS value FROM r JOIN rel USING (q) GROUP BY q, n")(run)


_metric("evl_recall", lambda f, r, n: M.recall_at_k(f, r, 10, n), "sum(CASE WHEN hit AND r <= 10 THEN 1.0 ELSE 0 END)::DOUBLE / n")
_metric("evl_precision", lambda f, r, n: M.precision_at_k(f, r, 10), "sum(CASE WHEN hit AND r <= 10 THEN 1.0 ELSE 0 END)::DOUBLE / 10")
_metric("evl_mrr", lambda f, r, n: M.mrr(f, r), "coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN r END), 0)")
_metric(
    "evl_ndcg", lambda f, r, n: M.ndcg_at_k(f, r, 10, n),
    "sum(CASE WHEN hit AND r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(n, 10)::INT + 1), lambda i: 1 / log2(i + 1)))",
)
_metric("evl_hit", lambda f, r, n: M.hit_at_k(f, r, 5).cast("double"), "max(CASE WHEN hit AND r <= 5 THEN 1.0 ELSE 0 END)::DOUBLE")

_ANSWERS = """
WITH a AS (SELECT x.conv_id, x.turn, x.text AS predicted, CASE WHEN x.conv_id % 3 = 0 THEN '  ' || replace(x.text, ' ', '   ') ELSE y.text END AS truth
           FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn = y.turn - 1)
"""


@query(_ANSWERS + r"SELECT conv_id, turn, trim(regexp_replace(lower(predicted), '\s+', ' ', 'g')) = trim(regexp_replace(lower(truth), '\s+', ' ', 'g')) AS same FROM a")
def evl_exact_match(spark, sf_dir):
    return A.answers(spark, sf_dir).select("conv_id", "turn", M.exact_match(F.col("predicted"), F.col("truth")).alias("same"))


@query(_ANSWERS + r""", w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(predicted), '\s+'), lambda x: x <> '')) AS p,
  list_distinct(list_filter(string_split_regex(lower(truth), '\s+'), lambda x: x <> '')) AS t FROM a)
SELECT conv_id, turn, round(CASE WHEN len(p) > 0 AND len(t) > 0 THEN 2.0::DOUBLE * len(list_intersect(p, t)) / (len(p) + len(t)) ELSE 0 END, 6) AS f1 FROM w""")
def evl_f1(spark, sf_dir):
    return A.answers(spark, sf_dir).select("conv_id", "turn", F.round(M.f1_score(F.col("predicted"), F.col("truth")), 6).alias("f1"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS p95 FROM r WHERE r = least(floor(0.95::DOUBLE * n), n - 1) + 1""")
def evl_nearest_rank(spark, sf_dir):
    return evaluate.nearest_rank(A.table(spark, sf_dir, "events"), "value", ["event_type"])


@query(_FOUND + """
, m AS (SELECT q, sum(CASE WHEN hit AND r <= 5 THEN 1.0 ELSE 0 END)::DOUBLE / n AS r5, sum(CASE WHEN hit AND r <= 10 THEN 1.0 ELSE 0 END)::DOUBLE / n AS r10, coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN r END), 0) AS m FROM r JOIN rel USING (q) GROUP BY q, n),
l AS (SELECT q::DOUBLE AS ms, row_number() OVER (ORDER BY q) AS r, count(*) OVER () AS n FROM m)
SELECT 'vector' AS method, count(*) AS queries, round(avg(r5), 4) AS recall_5, round(avg(r10), 4) AS recall_10, round(avg(m), 4) AS mrr, round(avg(q::DOUBLE), 2) AS mean_ms,
  (SELECT round(ms, 2) FROM l WHERE r = least(floor(0.95::DOUBLE * n), n - 1) + 1) AS p95_ms FROM m""")
def evl_summary(spark, sf_dir):
    rows = _found(spark, sf_dir).select(F.lit("vector").alias("method"), F.col("found").cast("array<string>").alias("found"), F.col("relevant").cast("array<string>").alias("relevant"), "total", F.col("query_id").cast("double").alias("latency_ms"))
    return evaluate.summarize(rows)
