"""URL filters: fixed host and path rules, then association rules (DataFrame operations only).

Spark's FP-growth mines the combinations of URL tokens that enough blocked
pages have; tokens that too few of them have are left out before. How many
labelled pages have a combination at all is counted by the inverted index, and
one of which enough are blocked becomes a rule, unless a part of it does as
well already. Rules are matched by an inverted index: each rule stands under
its rarest token, a URL looks up its own tokens and checks the whole
combination. URLs are judged once for each distinct token set, so a host with
a third of all pages costs no more.

Defined results
* a null URL and one without ``://`` have empty host and path, no tokens, and
  so fit no rule: they are allowed;
* a page without a label, or with a null one, doesn't take part in mining; one
  with several labels takes part with each;
* whole urls are judged, however long; their numbers are no tokens;
* an empty table gives an empty result;
* without labelled pages there are no mined rules;
* repeated pages are judged alike and all returned;
* ``host``, ``path``, ``rule`` and ``verdict`` replace input columns of these names.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import materialize

from . import common

#: (verdict, host, path): the host and its subdomains, if the path starts so.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A combination must be in this part of the labelled pages, and in so many.
MIN_SUPPORT, MIN_COUNT = 0.0005, 20
MIN_CONFIDENCE = 0.8
#: Token sets that a mined rule fits (about 500 bytes each) are broadcast up to this number, counted first.
BROADCAST_SETS = 100_000
OUTPUT = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return common.ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host by level (the words of one with hyphens), parts of the path, names in the query.

    Numbers are no tokens, and no two tokens say the same.
    """
    labels = F.reverse(F.split(host_of(url), r"\."))
    words = lambda x: F.transform(F.split(x, "-"), lambda w: F.concat(F.lit("w:"), w))
    host = F.flatten(F.transform(labels, lambda x, i: F.when(F.contains(x, F.lit("-")), words(x)).otherwise(F.array(F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)))))
    path = F.transform(F.split(common.ascii_lower(path_of(url)), r"[/._~-]+"), lambda x: F.concat(F.lit("p:"), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    every = F.array_distinct(F.concat(host, path, names))
    return F.coalesce(F.sort_array(F.filter(every, lambda x: ~x.rlike(r"^\w+:[0-9]*$"))), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support=MIN_SUPPORT, min_count=MIN_COUNT, min_confidence=MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, n_tokens, support, confidence, under) from ``labelled``: tokens array<string>, blocked boolean."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, n_tokens int, support long, confidence double, under string")
    counts = labelled.agg(F.count("*").alias("n"), F.count_if("blocked").alias("b")).first()
    if not counts["n"] or counts["b"] < min_count:
        return empty
    least = max(min_count, math.ceil(min_support * counts["n"] - 1e-9))
    common_tokens = labelled.filter("blocked").select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    # rows by their distinct sets of tokens that may be in a rule: a rule has no other
    rows = labelled.withColumn("row", F.monotonically_increasing_id())
    kept = rows.select("row", "blocked", F.explode(F.array_distinct("tokens")).alias("token")).join(common_tokens.select("token"), "token")
    kept = kept.groupBy("row", "blocked").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    kept = materialize(kept.groupBy("tokens").agg(F.count("*").alias("of"), F.count_if("blocked").alias("b")), "url-token-sets")
    blocked = kept.filter("b > 0").select(F.explode(F.array_repeat("tokens", F.col("b").cast("int"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / counts["b"]), minConfidence=min_confidence).fit(blocked)
    sets = model.freqItemsets.select(F.sort_array("items").alias("rule"), F.col("freq").alias("support")).filter(F.col("support") >= least)
    sets = materialize(sets.filter("size(rule) > 0"), "url-itemsets")
    rarest = common_tokens.withColumnRenamed("token", "__token")
    under = sets.select("rule", F.explode("rule").alias("__token")).join(rarest, "__token").groupBy("rule").agg(F.min(F.struct("n", "__token"))["__token"].alias("under"))
    having = kept.select("tokens", "of", F.explode("tokens").alias("under")).join(under, "under").filter(F.size(F.array_except("rule", "tokens")) == 0)
    having = having.groupBy("rule").agg(F.sum("of").alias("of"), F.first("under").alias("under"))
    rules = sets.join(having, "rule").withColumn("confidence", F.col("support") / F.col("of")).filter(F.col("confidence") >= min_confidence)
    rules = materialize(rules.select(F.col("rule").alias("tokens"), F.size("rule").alias("n_tokens"), "support", "confidence", "under"), "url-candidates")
    # a rule is not needed where a part of it is one: look up each token of it among shorter rules
    part = rules.select(F.col("tokens").alias("__part"), F.explode("tokens").alias("__token"))
    wider = rules.select("tokens", F.explode("tokens").alias("__token")).join(part, "__token")
    wider = wider.filter((F.size("__part") < F.size("tokens")) & (F.size(F.array_except("__part", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(wider, "tokens", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, url: str = "url", page: str = "page_id", **limits) -> DataFrame:
    """``pages`` with host, path, rule and verdict. labels: the page's id and ``blocked``, a boolean."""
    common.check_columns(pages, url, page)
    pages = pages.drop(*OUTPUT)
    labels = labels.select(F.col(labels.columns[0]).alias("__id"), F.col("blocked")).filter("blocked IS NOT NULL")
    tokens = pages.select(F.col(page).alias("__id"), tokens_of(F.col(url)).alias("tokens"))
    mined = materialize(mine(tokens.join(labels, "__id").select("tokens", "blocked"), **limits), "url-rules")
    sets = tokens.select("tokens").distinct()
    looked = sets.select("tokens", F.explode("tokens").alias("under"))
    hits = looked.join(mined.select("under", F.col("tokens").alias("__rule"), "confidence"), "under")
    hits = hits.filter(F.size(F.array_except("__rule", "tokens")) == 0)
    hits = materialize(hits.groupBy("tokens").agg(F.max(F.struct("confidence", "__rule")).alias("__hit")), "url-hits")
    if hits.count() <= BROADCAST_SETS:  # else both sides are shuffled, and a hot token set with them
        hits = F.broadcast(hits)
    rule, verdict = fixed_rule(host_of(F.col(url)), path_of(F.col(url)), rules)
    out = pages.withColumn("__tokens", tokens_of(F.col(url))).join(hits.withColumnRenamed("tokens", "__tokens"), "__tokens", "left")
    learned = F.when(F.col("__hit").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return (
        out.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "rule": rule, "verdict": F.coalesce(verdict, learned)})
        .withColumn("mined_rule", F.when(F.col("rule").isNull(), F.array_join(F.col("__hit")["__rule"], " ")))
        .drop("__tokens", "__hit")
    )


def document_of(url: Column) -> Column:
    """The number of the document that a page of the driver's tables shows: the first part of its path that is a number."""
    return F.try_to_number(F.nullif(F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:[/.]|$)", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page bears the labels of the document that it shows: blocked are those of low quality and the toxic ones."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    shown = pages.select("page_id", document_of(F.col("url")).alias("doc_id")).distinct()
    return judge(pages, shown.join(labels, "doc_id").select("page_id", "blocked")).select("page_id", "host", "path", "rule", "verdict")


def _rules_sql() -> str:
    fits = [f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN {{0}}" for _, name, start in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f.format(f"'{value(r)}'") for f, r in zip(fits, order, strict=True)) + " END"
    return f"{case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS fixed"


#: Rules are mined by listing every combination of the tokens that enough blocked pages have.
OP4_SQL = rf"""
WITH h AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{common.UPPER}', '{common.LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT *, row_number() OVER () AS r, {_rules_sql()} FROM h),
k AS (SELECT r, list_distinct(list_filter(list_concat(
    flatten(list_transform(list_reverse(string_split(host, '.')), lambda x, i: CASE WHEN contains(x, '-') THEN list_transform(string_split(x, '-'), lambda w: 'w:' || w) ELSE ['h' || (i - 1) || ':' || x] END)),
    list_transform(string_split_regex(translate(path, '{common.UPPER}', '{common.LOWER}'), '[/._~-]+'), lambda x: 'p:' || x),
    list_transform(string_split(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: 'q:' || string_split(x, '=')[1])),
    lambda x: NOT regexp_full_match(x, '\w+:[0-9]*'))) AS tokens FROM f WHERE url IS NOT NULL),
s AS (SELECT DISTINCT page_id, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1) AS BIGINT) AS doc_id FROM f),
y AS (SELECT page_id, quality = 0 OR toxic = 1 AS blocked FROM s JOIN labels USING (doc_id)),
l AS (SELECT r, row_number() OVER () AS labelled, tokens, blocked FROM k JOIN f USING (r) JOIN y USING (page_id) WHERE blocked IS NOT NULL),
m AS (SELECT greatest({MIN_COUNT}, ceil({MIN_SUPPORT} * count(*) - 1e-9)) AS least, count(*) FILTER (blocked) AS b FROM l),
ft AS (SELECT t FROM (SELECT unnest(tokens) AS t, blocked FROM l) WHERE blocked GROUP BY t HAVING count(*) >= (SELECT least FROM m)),
lt AS (SELECT labelled, any_value(blocked) AS blocked, list(t ORDER BY t) AS ts FROM (SELECT labelled, blocked, unnest(tokens) AS t FROM l) JOIN ft USING (t) GROUP BY labelled),
sub AS (SELECT labelled, blocked, list_filter(ts, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS x FROM lt, unnest(range(1, (1 << len(ts))::BIGINT)) AS u(mask)),
ru AS (SELECT x FROM sub GROUP BY x HAVING count(*) FILTER (blocked) >= (SELECT least FROM m) AND (SELECT b FROM m) >= {MIN_COUNT} AND count(*) FILTER (blocked) / count(*)::DOUBLE >= {MIN_CONFIDENCE}),
hit AS (SELECT DISTINCT r FROM k JOIN ru ON list_has_all(k.tokens, ru.x))
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN hit.r IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM f LEFT JOIN hit USING (r)
"""

QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {"op4_url_filter": OP4_SQL}
