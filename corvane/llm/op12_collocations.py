"""Phrase collocation mining: phrases of 2 to ``max_n`` words whose words keep together.

All windows of words are rows of a DataFrame and are counted by a hash
aggregate on (language, phrase). Windows of one and two words are exploded
everywhere. A longer window can only be frequent where the two windows of one
word less that it holds are frequent (every window of a frequent phrase is), so
those of 3 to ``max_n`` words are counted at such places only, and nothing that
reaches ``min_count`` is lost. The counts of prefixes and suffixes, frequent for
the same reason, are joined to every cut of a phrase; the score is worked out in
Decimal and cut by an integral division; a phrase whose occurrences are (up to
``absorb`` percent) those of a phrase one word longer goes by an anti-join,
which suffices for all longer ones, since counts never grow with a phrase; a
window ranks the rest, first within salts of a language, then within the
language.

Places are never shuffled. Each level's frequent phrases set their bits in a
table of at most ``FILTER_BITS`` bits, which is broadcast however many they
are, and a place is kept if its two bits are set. Phrases that share a
frequent one's bit are kept at all their places or at none, so they cost rows
and alter no count; their own count decides. What is left after the pairs is
written once, as a text of up to ``max_n`` words a place, and is removed after
the last level; shuffle files go with the query that wrote them. Frequent
phrases themselves are broadcast to their cuts up to ``BROADCAST_PHRASES``,
counted first; beyond, they meet by a shuffle.

Defined results
* A-Z are lower-cased and nothing else; texts are cut into pieces at
  ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs;
* a null or empty text has no words; a null language is ``und``;
* whole texts are counted, however long, and repeated rows as often as they occur;
* ties in score and count go to the phrase that is smaller in UTF-8 byte order;
* an empty table gives an empty result; other columns stay out, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.storage import discard, materialize, shuffles_removed

from . import common

MAX_N, MIN_COUNT, TOP, ABSORB = 5, 100, 2000, 100
NO_LANGUAGE = "und"
#: Ends of pieces, white space between words, and what stands for an end of a piece (no word holds it).
ENDS, SPACE, END = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+", "."
#: Frequent phrases (about 60 bytes each) and languages are broadcast up to this number.
BROADCAST_PHRASES = 500_000
#: A filter by which places are kept has so many bits a phrase or more, and at most so many (18 MB to broadcast) for any number of phrases.
BITS_A_PHRASE, FILTER_BITS = 32, 1 << 27
SALTS = 64


def _lower(phrase: Column) -> Column:
    """A-Z lower-cased: by the fast function where all is ASCII."""
    return F.when(F.octet_length(phrase) == F.char_length(phrase), F.lower(phrase)).otherwise(common.ascii_lower(phrase))


def _places(docs: DataFrame, lang: str, text: str, width: int) -> DataFrame:
    """A row for each word: lang, w1 (the word) and w2 ... (those after it; null or an end where the piece is over)."""
    tokens = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ENDS, f" {END} "), SPACE)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), tokens.alias("t"))
    shifted = [F.col("t").alias("w1"), *(F.slice("t", k, F.size("t")).alias(f"w{k}") for k in range(2, width + 1))]
    rows = rows.select("lang", F.explode(F.arrays_zip(*shifted)).alias("z"))
    return rows.select("lang", *(f"z.w{k}" for k in range(1, width + 1))).filter(_is_word("w1"))


def _is_word(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "") & (F.col(name) != END)


def _phrase(first: int, last: int) -> Column:
    return F.concat_ws(" ", *(f"w{k}" for k in range(first, last + 1)))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_PHRASES else df


def bits_for(phrases: int) -> int:
    """The size of a filter: a power of two, so that a small one stays in a core's cache."""
    return min(FILTER_BITS, 1 << (BITS_A_PHRASE * phrases).bit_length())


def _bit(phrase: Column, bits: int) -> Column:
    return F.xxhash64(F.col("lang"), phrase).bitwiseAND(F.lit(bits - 1))


def _word_of(bit: Column) -> tuple[Column, Column, Column]:
    """Where a bit of a filter stands: the row, the long in its list, and the bit in the long."""
    return F.shiftright(bit, 12), F.shiftright(bit, 6).bitwiseAND(F.lit(63)).cast("int"), bit.bitwiseAND(F.lit(63)).cast("int")


def filter_of(frequent: DataFrame, bits: int) -> DataFrame:
    """(part, longs): ``bits`` bits, of which those of the frequent phrases are set; parts without any are left out."""
    part, word, bit = _word_of(_bit(F.col("phrase"), bits))
    set_ = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    longs = frequent.groupBy(part.alias("part"), word.alias("word")).agg(F.bit_or(set_).alias("long"))
    at = F.map_from_entries(F.collect_list(F.struct("word", "long")))
    parts = longs.groupBy("part").agg(at.alias("at"))
    return parts.select("part", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("at", k), F.lit(0).cast("long"))).alias("longs"))


def _kept(places: DataFrame, frequent: DataFrame, *phrases: Column) -> DataFrame:
    """The places whose phrases all have the bit of a frequent one: every place of frequent phrases, and a few others."""
    columns, bits = places.columns, bits_for(frequent.count())
    known = filter_of(frequent, bits)
    for phrase in phrases:
        part, word, bit = _word_of(F.col("__bit"))
        there = (part == F.col("part")) & (F.getbit(F.get("longs", word), bit) == 1)
        places = places.select(*columns, _bit(phrase, bits).alias("__bit")).join(F.broadcast(known), there, "left_semi")
    return places.select(*columns)


def _words(run: Column, first: int, last: int) -> Column:
    """The words ``first`` to ``last`` of a run that has so many."""
    return F.substring_index(F.substring_index(run, " ", last), " ", first - last - 1)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", max_n: int = MAX_N, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of up to ``max_n`` words with f >= ``min_count``, and (lang, n) of all words."""
    pairs = F.when(_is_word("w2"), _phrase(1, 2))
    grams = _places(docs, lang, text, 2).select("lang", F.posexplode(F.array(F.col("w1"), pairs)).alias("at", "phrase")).filter("phrase IS NOT NULL")
    counted = grams.select("lang", (F.col("at") + 1).alias("size"), _lower(F.col("phrase")).alias("phrase")).groupBy("lang", "size", "phrase").agg(F.count("*").alias("f"))
    # rare phrases are summed to one row a language and size, so that one job gives both results
    often = F.when(F.col("f") >= min_count, F.col("phrase")).alias("phrase")
    counted = materialize(counted.select("lang", "size", often, "f").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")), "counts")
    total = counted.filter("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    found = [counted.filter("phrase IS NOT NULL")]
    last = found[0].filter("size = 2")
    for size in range(3, max_n + 1):
        if size == 3:
            places = _places(docs, lang, text, max_n).filter(_is_word("w2") & _is_word("w3"))
            places = _kept(places, last, _lower(_phrase(1, 2)), _lower(_phrase(2, 3)))
            open_, words, n_words = F.lit(True), [], F.lit(0)
            for k in range(1, max_n + 1):
                open_ = open_ & _is_word(f"w{k}")
                words.append(F.when(open_, F.col(f"w{k}")))
                n_words = n_words + open_.cast("int")
            runs = materialize(places.select("lang", n_words.alias("n_words"), _lower(F.concat_ws(" ", *words)).alias("run")), "runs")
            here = runs
        else:
            here = _kept(runs.filter(F.col("n_words") >= size), last, _words(F.col("run"), 1, size - 1), _words(F.col("run"), 2, size))
        last = here.select("lang", F.substring_index("run", " ", size).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("f")).filter(F.col("f") >= min_count)
        last = materialize(last.select("lang", F.lit(size).alias("size"), "phrase", "f"), "counts")
        found.append(last)
    if max_n > 2:
        discard(runs)
    return reduce(DataFrame.union, found), total


def score_of(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)): products of Decimals of up to 38 digits, and an integral division."""
    wide = lambda c: c.cast("decimal(17,0)")
    product = (F.lit(1000).cast("decimal(4,0)") * wide(a)).cast("decimal(21,0)") * wide(n)
    return F.call_function("div", product, wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, absorb: int = ABSORB) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    common.check_columns(docs, lang, text)
    if max_n < 2 or min_count < 1 or not 0 <= absorb <= 100:
        raise ValueError("max_n must be 2 or more, min_count positive, absorb from 0 to 100")
    with shuffles_removed(docs.sparkSession):
        found, total = counts(docs, lang, text, max_n, min_count)
        found, total = materialize(found, "phrases"), materialize(total, "words")
        rows, languages = found.count(), total.count()
    words = F.split("phrase", " ")
    cuts = found.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("ws"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda begin, length: F.array_join(F.slice("ws", begin, length), " ")
    cuts = cuts.select("lang", "size", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(_bounded(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), rows), ["lang", side])
    cuts = cuts.join(_bounded(total, languages), "lang")
    cuts = cuts.withColumn("score", score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("size").alias("size"))
    # what a phrase one word longer takes over
    longer = found.filter("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("ws"))
    inner = F.explode(F.array(*(F.array_join(F.slice("ws", b, F.col("size") - 1), " ") for b in (1, 2)))).alias("inner")
    longer = longer.select(F.col("lang").alias("__lang"), "f", inner).groupBy("__lang", "inner").agg(F.max("f").alias("most"))
    taken = (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("inner")) & (F.col("most") * 100 >= F.col("a") * absorb)
    left = scored.join(_bounded(longer, 2 * rows), taken, "left_anti").select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, {MAX_N + 1})) AS size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= {MIN_COUNT}),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * k.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x JOIN f r ON r.lang = k.lang AND r.phrase = k.y JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')
      AND c.size > len(string_split(b.phrase, ' ')) AND 100 * c.a >= {ABSORB} * b.a),
r AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN d ON d.lang = b.lang AND d.phrase = b.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= {TOP}
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLE_SQL = {"op12_collocations": OP12_SQL}
