"""Benchmark decontamination (DataFrame operations only).

A window of an item's size over a document is compared with the items of that
size: SimHash fingerprints of both, a multi-index over blocks of the
fingerprint that finds every pair within ``radius`` bits, and the exact
similarity of their weighted five-word shingles for what the index finds.

Which windows: every one that holds a shingle of an item of its size, at any
place in it; all others have similarity 0. The places where a document has a
shingle of an item give ranges of starts, which are cut into cells of ``CELL``
starts. A cell keeps running sums of the 64 bit counts of its shingles, so a
window's fingerprint is the difference of two sums. Which items a window is
compared with is the index's decision alone. Items of fewer than five words are
one shingle of their own length, and are looked for with windows of that length.

Exact similarities slide too: a cell's shingles are met with those of the items
that the index found in it, and a window's weights are summed within the cell's
arrays, so no window's shingles become rows.

Documents are read twice: first their shingles are hashed in generated code
and looked up, which leaves narrow rows (id, a hash of the text, size, starts);
then the words of these cells are fetched from the documents that have some.
No array of words is ever shuffled, but for whole texts where too many
documents have a window for a broadcast.

The multi-index: ``radius`` differing bits over eight blocks of eight bits
leave a block with radius // 8 at most; each item stands under its size and
all block values that near, a window looks up its own eight values.

Weights: a shingle's weight is ln(1 + items / items with it), the highest for
shingles that no item has; similarity is the weighted Jaccard of the counts.

Defined results
* words are runs of letters and digits, lower-cased; a text of fewer than five
  words is one shingle, and one without words matches nothing;
* whole texts are looked through, however long;
* columns of other names stay out of the pairs, and ``clean`` returns them as they are;
* null texts match nothing; null item ids are left out; rows without an id
  are taken for one document without an id;
* a passage that occurs several times in a document counts once, at the place
  of the highest similarity, the first of those;
* repeated rows of an id are one document (a pair is reported once);
* empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import materialize

from . import common

WORDS, SIMILARITY = 5, 0.8
#: A similarity of 0.8 differs in about 10 of 64 bits, with a deviation of 3.
RADIUS = 23
BLOCKS = 8
#: Starts of windows that share running sums.
CELL = 128
#: Items are broadcast up to so many shingles and index entries (about 40 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, n: int = WORDS) -> Column:
    """Hashes of all shingles of an array of words, in their order."""
    few = F.array(F.xxhash64(F.array_join(words, " ")))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))
    return F.when(F.size(words) < 1, F.array().cast("array<bigint>")).when(F.size(words) < n, few).otherwise(many)


def _fingerprint(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set where over half of them have it."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.call_function("getbit", h, b).cast("int")) * 2 > F.size(hashes),
    )
    return F.aggregate(
        F.transform(bits, lambda on, b: F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda s, v: s.bitwiseOR(v),
    )


def _block(fingerprint: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, block * 8).bitwiseAND(F.lit(255)).cast("int")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_table(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row an item: item_id, n_words, hashes, n_shingles, fingerprint."""
    rows = items.select(F.col(item).alias("item_id"), words_of(F.col(text)).alias("w")).filter("item_id IS NOT NULL AND size(w) > 0")
    rows = rows.groupBy("item_id").agg(F.min("w").alias("w"))
    rows = rows.withColumn("hashes", _shingles(F.col("w")))
    return rows.select("item_id", F.size("w").alias("n_words"), "hashes", F.size("hashes").alias("n_shingles"), _fingerprint(F.col("hashes")).alias("fingerprint"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def cells(docs: DataFrame, table: DataFrame, n_shingles: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, cell, low, high): the starts, by cells of CELL, of windows of ``n_words`` words that hold a shingle of an item of that size."""
    at = table.select("n_words", F.explode("hashes").alias("hash")).distinct()
    short = sorted(r["n_words"] for r in table.filter(F.col("n_words") < WORDS).select("n_words").distinct().collect())  # four at most
    rows = docs.select(F.col(doc).alias("doc_id"), _text_hash(F.col(text)).alias("text_hash"), words_of(F.col(text)).alias("w")).filter("size(w) > 0")
    n = F.size("w")
    zipped = F.arrays_zip(F.col("w").alias("a"), *[F.slice("w", i, n).alias(f"b{i}") for i in range(2, WORDS + 1)])
    rows = rows.select("doc_id", "text_hash", n.alias("n"), F.posexplode(zipped).alias("p", "z"))
    first = lambda k: F.xxhash64(F.concat_ws(" ", "z.a", *[f"z.b{i}" for i in range(2, k + 1)]))
    full = lambda k: F.col("z.a" if k == 1 else f"z.b{k}").isNotNull()
    hashes = [F.when(full(k), first(k)) for k in (*short, WORDS)]
    hashed = rows.select("doc_id", "text_hash", "n", "p", hashes[0].alias("hash") if not short else F.explode(F.array(*hashes)).alias("hash"))
    hits = hashed.filter("hash IS NOT NULL").join(_bounded(at, n_shingles), "hash")
    last = F.greatest(F.lit(0), F.col("n") - F.col("n_words"))
    low = F.greatest(F.lit(0), F.least(last, F.col("p") + F.least(F.col("n_words"), F.lit(WORDS)) - F.col("n_words")))
    hits = hits.select("doc_id", "text_hash", "n_words", low.alias("low"), F.least(last, F.col("p")).alias("high"))
    cell, to = lambda c: F.floor(c / CELL).cast("int"), lambda c: F.col("cell") * CELL + c
    hits = hits.select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    return hits.groupBy("doc_id", "text_hash", "n_words", "cell").agg(F.min(F.greatest(F.col("low"), to(0))).alias("low"), F.max(F.least(F.col("high"), to(CELL - 1))).alias("high"))


def _prints(hashes: Column, n_windows: Column, width: Column) -> tuple[Column, Column]:
    """Running sums of bits (to be named ``sums``), and fingerprints of ``n_windows`` windows of ``width`` shingles each, one behind the other over ``hashes``.

    Bit counts are held in pairs: bit k in the lower and bit k + 32 in the upper half of the k-th long.
    """
    pair = F.lit(1 | 1 << 32).cast("long")
    places = F.sequence(F.lit(0), F.lit(31))
    bits = lambda h: F.transform(places, lambda k: F.call_function("shiftrightunsigned", h, k).bitwiseAND(pair))
    none = F.array(F.transform(places, lambda _: F.lit(0).cast("long")))
    sums = F.aggregate(hashes, none, lambda acc, h: F.concat(acc, F.array(F.zip_with(F.element_at(acc, -1), bits(h), lambda x, y: x + y))))

    def one(begin: Column) -> Column:
        end = F.least(begin + width, F.size(hashes))
        counts = F.zip_with(F.element_at(F.col("sums"), end + 1), F.element_at(F.col("sums"), begin + 1), lambda x, y: x - y)
        half = end - begin
        value = lambda on, k: F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
        both = lambda c, k: value(c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) * 2 > half, k).bitwiseOR(value(F.shiftright(c, 32) * 2 > half, k + 32))
        return F.aggregate(F.transform(counts, both), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return sums, F.transform(F.sequence(F.lit(0), n_windows - 1), one)


def _windows(docs: DataFrame, found: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n_words, cell, low, width, hashes, prints): the cells' shingles and the fingerprints of their windows; repeated rows once."""
    per_text = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("n_words", "cell", "low", "high")).alias("cells"))
    per_text = per_text.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "cells")
    rows = docs.select(F.col(doc).alias("doc_id"), _text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    rows = rows.join(_bounded(per_text, found.count()), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")))
    rows = rows.select("doc_id", "text_hash", words_of(F.col("text")).alias("w"), F.explode("cells").alias("at"))
    rows = rows.select("doc_id", "text_hash", "at.*", F.slice("w", F.col("at.low") + 1, F.col("at.high") - F.col("at.low") + F.col("at.n_words")).alias("words"))
    few = F.col("n_words") < WORDS
    alone = F.transform("words", lambda _, i: F.xxhash64(F.array_join(F.slice("words", i + 1, F.col("n_words")), " ")))
    hashes = F.when(few, F.slice(alone, 1, F.col("high") - F.col("low") + 1)).otherwise(_shingles(F.col("words")))
    rows = rows.select("doc_id", "text_hash", "n_words", "cell", "low", "high", hashes.alias("hashes"))
    rows = rows.groupBy("doc_id", "text_hash", "n_words", "cell").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("hashes").alias("hashes"))
    rows = rows.withColumn("width", F.greatest(F.col("n_words") - (WORDS - 1), F.lit(1)))
    sums, prints = _prints(F.col("hashes"), F.col("high") - F.col("low") + 1, F.col("width"))
    return rows.withColumn("sums", sums).select("doc_id", "text_hash", "n_words", "cell", "low", "width", "hashes", prints.alias("prints"))


#: What names a cell; ids may be null.
CELL_KEY = ("doc_id", "text_hash", "n_words", "cell")


def _same_cell(df: DataFrame, other: DataFrame, *further: str) -> DataFrame:
    """An inner join by the cell and by ``further`` columns, null ids included."""
    names = [*CELL_KEY, *further]
    other = other.select(*(F.col(n).alias(f"__{n}") for n in names), *(c for c in other.columns if c not in names))
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    for n in names[1:]:
        on = on & (F.col(n) == F.col(f"__{n}"))
    return df.join(other, on).drop(*(f"__{n}" for n in names))


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Pairs (doc_id, item_id, start, n_words, distance, similarity): document and item, and the best window."""
    common.check_columns(docs, doc, text)
    common.check_columns(items, item, text)
    if not 0 <= radius < 32:
        raise ValueError("the radius must be from 0 to 31")
    table = materialize(item_table(items, item, text), "items")
    count = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("s")).first()
    n_items, n_shingles = count["n"], count["s"]
    found = materialize(cells(docs, table, n_shingles, doc, text), "cells")
    laid = materialize(_windows(docs, found, doc, text), "windows")
    # multi-index: an item under all values within radius // BLOCKS of each of its blocks
    near = radius // BLOCKS
    values = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda v: F.bit_count(v.bitwiseXOR(_block(F.col("fingerprint"), F.col("block")))) <= near)
    index = table.select("item_id", "n_words", "fingerprint", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    index = index.select(F.col("item_id").alias("item"), "n_words", "fingerprint", "block", F.explode(values).alias("value"))
    per_block = sum(_choose(8, k) for k in range(near + 1))
    probe = laid.select(*CELL_KEY, "low", F.posexplode("prints").alias("i", "print"))
    probe = probe.select(*CELL_KEY, (F.col("low") + F.col("i")).alias("start"), "print", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    probe = probe.withColumn("value", _block(F.col("print"), F.col("block")))
    hits = probe.join(_bounded(index, n_items * BLOCKS * per_block), ["n_words", "block", "value"])
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint")))
    hits = hits.withColumn("distance", distance.cast("int")).filter(F.col("distance") <= radius)
    # a pair meets in several blocks: keep it in the first
    first = F.expr(f"aggregate(sequence(0, {BLOCKS - 1}), {BLOCKS}, (m, b) -> CASE WHEN m = {BLOCKS} AND bit_count((shiftrightunsigned(print, b * 8) ^ shiftrightunsigned(fingerprint, b * 8)) & 255) <= {near} THEN b ELSE m END)")
    pairs = hits.filter(F.col("block") == first).groupBy(*CELL_KEY, "item").agg(F.collect_list(F.struct("start", "distance")).alias("starts"))
    pairs = materialize(pairs, "pairs")
    # exact similarity of weighted counts: the shingles of the cells that the index found, as rows
    weight = table.select(F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("hash").agg(F.log(1 + F.lit(float(n_items)) / F.count("*")).alias("weight"))
    side = table.select(F.col("item_id").alias("item"), "n_words", F.explode("hashes").alias("hash")).groupBy("item", "n_words", "hash").agg(F.count("*").cast("int").alias("b"))
    side = materialize(side.join(weight, "hash"), "item-shingles")
    items_w = side.groupBy("item").agg(F.sum(F.col("b") * F.col("weight")).alias("all_b"))
    unknown = F.log(1 + F.lit(float(max(n_items, 1))))
    here = _same_cell(laid.select(*CELL_KEY, "low", "hashes"), pairs.select(*CELL_KEY).distinct()).select(*CELL_KEY, "low", F.posexplode("hashes").alias("i", "hash"))
    here = materialize(here.select(*CELL_KEY, (F.col("low") + F.col("i")).alias("p"), "hash"), "shingles")
    weighed = here.join(_bounded(weight, n_shingles), "hash", "left").groupBy(*CELL_KEY).agg(
        F.min("p").alias("low"), F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("weight", unknown).alias("w")))), lambda x: x["w"]).alias("weights")
    )
    # the k-th of equal shingles counts in a window that doesn't hold as many before it as the item has
    shared = _same_cell(here, pairs.select(*CELL_KEY, "item")).join(_bounded(side.drop("n_words"), n_shingles), ["item", "hash"])
    shared = shared.groupBy(*CELL_KEY, "item", "hash", "b", "weight").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    before = lambda p, i: F.when(i >= F.col("b"), F.element_at("ps", F.greatest(i - F.col("b") + 1, F.lit(1)))).otherwise(F.lit(-1))
    shared = shared.select(*CELL_KEY, "item", F.explode(F.transform("ps", lambda p, i: F.struct(p.alias("p"), before(p, i).alias("q"), F.col("weight").alias("w")))).alias("x"))
    shared = shared.groupBy(*CELL_KEY, "item").agg(F.array_sort(F.collect_list("x")).alias("shared"))
    rows = _same_cell(_same_cell(pairs, weighed), shared, "item").join(_bounded(items_w, n_items), "item")
    width = F.greatest(F.col("n_words") - (WORDS - 1), F.lit(1))
    zero, add = F.lit(0.0), lambda x, y: x + y

    def compared(at: Column) -> Column:
        end = at["start"] + width
        inside = F.filter("shared", lambda x: (x["p"] >= at["start"]) & (x["p"] < end) & (x["q"] < at["start"]))
        both = F.aggregate(F.transform(inside, lambda x: x["w"]), zero, add)
        all_a = F.aggregate(F.slice("weights", at["start"] - F.col("low") + 1, width), zero, add)
        return F.struct((both / (all_a + F.col("all_b") - both)).alias("similarity"), (-at["start"]).alias("start"), F.col("n_words").alias("n_words"), (-at["distance"]).alias("distance"))

    best = rows.select("doc_id", "item", F.array_max(F.transform("starts", compared)).alias("m")).filter(F.col("m.similarity") >= similarity - 1e-12)
    best = best.groupBy("doc_id", "item").agg(F.max("m").alias("m"))
    return best.select("doc_id", F.col("item").alias("item_id"), (-F.col("m.start")).alias("start"), F.col("m.n_words").alias("n_words"), (-F.col("m.distance")).alias("distance"), F.round("m.similarity", 9).alias("similarity"))


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def clean(docs: DataFrame, items: DataFrame, doc: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item."""
    bad = materialize(contaminated(docs, items, doc, **options).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_ROWS:  # 8 bytes each; beyond, both sides are shuffled
        bad = F.broadcast(bad)
    return docs.join(bad, F.col(doc).eqNullSafe(F.col("__bad")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE_SQL: dict = {}
