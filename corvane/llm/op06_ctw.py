"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions; the decision at each of the 255
places of that binary tree has a context tree of its own, over the bytes
before, the nearest first. Every node holds a Krichevsky-Trofimov estimate, and
the weighted probability of a node is half its own estimate and half the
product of its children's: a mixture over all depths. The probability of a
text is the product over its bytes and its end (coded as a zero byte), with
the counts of the training texts; bytes before the start count as zero.

A context that never occurred in training has no say: its parent's estimate
holds for it. So each conditional distribution adds up to one.

Steps
1. A pass over all texts counts byte strings of ``depth`` + 1 bytes (n is 0 for
   those of held-out texts only) and the words of training texts, in sorted
   pieces of bounded size; Spark sums them. The table of strings is as large as
   the texts make it, and stays in the shared folder.
2. The contexts are worked out in parts that share their nearest two bytes, for
   all 255 decisions at once. What the parts have in common, the contexts of
   one byte and of none, is a tree of at most 65,536 leaves for each decision;
   it is worked out from the parts' roots, and gives each part two numbers by
   which its probabilities turn into those of the whole tree (they depend on
   each other linearly). That gives the probability of each string.
3. A second pass adds up the logarithms. The FREQUENT_GRAMS most frequent
   strings are broadcast; a text's other strings are joined with the table by a
   shuffle, counted per text before. Which way a string goes makes no
   difference to a score.

The base score is that of single words with one added to each count. The
FREQUENT_WORDS most frequent words are looked up in a broadcast table too; the
others, none of which is hot, are joined with their counts.

Defined results
* a null text is empty: no words, one end; empty texts have the probability of the end;
* repeated rows and ids are scored (and learnt from) row by row; a null id hashes as an empty text;
* whole texts are learnt and scored, however long, in pieces of bounded size;
* held-out texts alter nobody's score: their strings have no counts;
* without training texts all counts are 0 and every decision is even;
* the output has the documented columns only.
"""

from __future__ import annotations

import secrets
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import arrow_rows, materialize

from . import common

FOLDS, HELD_OUT = 7, 2
DEPTH = 5
#: Nearest bytes that the contexts of a part share, and byte strings that a task gets parts of.
SPLIT, TASK_GRAMS = 2, 1 << 18
#: Rows of the broadcast tables at most: byte strings (16 bytes each) and words (about 120). The rest is joined.
FREQUENT_GRAMS, FREQUENT_WORDS = 1 << 21, 1 << 18
#: Bytes of text worked on at a time, byte strings and words held by a task before it passes them on.
PIECE, HELD_GRAMS, HELD_WORDS = 1 << 19, 1 << 21, 200_000
#: Texts that cross to Python at a time.
BATCH_ROWS = 1000
#: Bits of a row's number within its partition.
ROW_BITS = 36


def _pieces(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(codes, index of the text of each code, texts begun) of bounded size.

    A code has the nearest byte first, then farther ones, then the byte itself.
    """
    buffer: list[bytes] = []
    owner: list[int] = []
    size = 0

    def codes():
        data = np.frombuffer(b"".join(buffer), dtype=np.uint8)
        lengths = np.fromiter(map(len, buffer), dtype=np.int64, count=len(buffer))
        wide = data.astype(np.uint64)
        n = len(wide) - depth
        code = wide[depth:].copy()
        for k in range(1, depth + 1):
            code |= wide[depth - k : depth - k + n] << np.uint64(8 * (depth + 1 - k))
        valid = np.ones(len(wide), dtype=bool)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for k in range(depth):
            valid[starts + k] = False
        which = np.repeat(np.array(owner, dtype=np.int64), lengths)
        return code[valid[depth:]], which[valid]

    pad = bytes(depth)
    for i, text in enumerate(texts):
        data = pad + text + b"\0"
        for at in range(0, len(data) - depth, PIECE):
            part = data[at : at + PIECE + depth]
            buffer.append(part)
            owner.append(i)
            size += len(part)
            if size >= PIECE:
                yield codes()
                buffer.clear()
                owner.clear()
                size = 0
    if buffer:
        yield codes()


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(n, starts)


def _bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches by a few megabytes of text, so that what is made of them stays small."""
    for batch in batches:
        ends = np.cumsum([len(t) if t is not None else 0 for t in batch["text"]])
        cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.iloc[a:b]


def _count(depth: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[bytes] = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def of_words() -> pd.DataFrame:
            out = pd.DataFrame({"gram": pd.array([None] * len(words), dtype="Int64"), "word": list(words), "n": list(words.values())})
            words.clear()
            return out

        def of_grams() -> Iterator[pd.DataFrame]:
            keys, n = _merge(parts)
            parts.clear()
            for i in range(0, len(keys), 1 << 17):
                yield pd.DataFrame({"gram": pd.array(keys[i : i + (1 << 17)].view(np.int64), dtype="Int64"), "word": None, "n": n[i : i + (1 << 17)]})

        for batch in _bounded(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            training = ~batch["held_out"].to_numpy(bool)
            for keep in (True, False):
                mine = [t for t, k in zip(texts, training, strict=True) if k == keep]
                for codes, _ in _pieces(mine, depth):
                    keys, n = np.unique(codes, return_counts=True)
                    parts.append((keys, n if keep else np.zeros_like(n)))
                    if sum(len(p[0]) for p in parts) > HELD_GRAMS:
                        parts[:] = [_merge(parts)]
                        if len(parts[0][0]) > HELD_GRAMS // 2:
                            yield from of_grams()
            for text, k in zip(texts, training, strict=True):
                if k:
                    words.update(text.lower().split())
                    if len(words) > HELD_WORDS:
                        yield of_words()
        if parts:
            yield from of_grams()
        if words:
            yield of_words()

    return work


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series above 8)."""
    x = np.asarray(x, dtype=np.float64)
    product = np.ones_like(x)
    for k in range(8):
        product *= np.where(x < 1e15, x + k, 1.0) if k else x
    y = x + 8
    inverse = 1 / y
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260 - inverse**2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def _parents(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child of each parent, and the parent of each child, of sorted nodes; a parent has one byte less."""
    up = keys >> np.uint64(8)
    new = up[1:] != up[:-1]
    return np.flatnonzero(np.concatenate(([True], new))), np.cumsum(np.concatenate(([0], new.astype(np.int64))))


def _estimate(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov estimate."""
    return lgamma(ones + 0.5) + lgamma(zeros + 0.5) - 2 * lgamma(np.array([0.5])) - lgamma(ones + zeros + 1)


def climb(keys: np.ndarray, ones: np.ndarray, zeros: np.ndarray, weighted: np.ndarray, levels: int):
    """(shift, factor), and the nodes ``levels`` higher up (keys, ones, zeros, weighted).

    The nodes given are sorted; the probability of a one that holds for a node
    by itself, times its factor and plus its shift, is the mixture up to there.
    """
    shift, factor, to_node = np.zeros(len(keys)), np.ones(len(keys)), np.arange(len(keys))
    half = np.log(0.5)
    for _ in range(levels):
        seen = (ones + zeros > 0)[to_node]
        starts, parent = _parents(keys)
        children = np.add.reduceat(weighted, starts)
        ones, zeros, keys = np.add.reduceat(ones, starts), np.add.reduceat(zeros, starts), (keys >> np.uint64(8))[starts]
        to_node = parent[to_node]
        estimate = _estimate(ones, zeros)
        weighted = np.logaddexp(estimate, children) + half
        stop = np.exp(np.minimum(0.0, estimate + half - weighted))[to_node]
        own = ((ones + 0.5) / (ones + zeros + 1))[to_node]
        shift, factor = np.where(seen, stop * own + (1 - stop) * shift, own), np.where(seen, (1 - stop) * factor, 0.0)
    return (shift, factor), (keys, ones, zeros, weighted)


def part_tree(codes: np.ndarray, n: np.ndarray, level: int, depth: int, levels: int):
    """(bit, one, node, nodes): each code's bit at a level of the byte's binary tree, the probability of a one
    from its part of the tree, its node ``levels`` higher up, and those nodes. A node's key begins with the place."""
    symbol = codes & np.uint64(255)
    bit = ((symbol >> np.uint64(7 - level)) & np.uint64(1)).astype(np.int64)
    place = (symbol >> np.uint64(8 - level)) | np.uint64(1 << level)
    key = (place << np.uint64(8 * depth)) | (codes >> np.uint64(8))
    order = np.argsort(key, kind="stable")
    ordered, count = key[order], n[order].astype(np.float64)
    new = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(np.concatenate(([True], new)))
    leaf = np.empty(len(key), dtype=np.int64)
    leaf[order] = np.cumsum(np.concatenate(([0], new.astype(np.int64))))
    ones = np.add.reduceat(np.where(bit[order] == 1, count, 0.0), starts)
    zeros = np.add.reduceat(np.where(bit[order] == 0, count, 0.0), starts)
    (shift, factor), nodes = climb(ordered[starts], ones, zeros, _estimate(ones, zeros), levels)
    one = shift + factor * ((ones + 0.5) / (ones + zeros + 1))
    return bit, one[leaf], key >> np.uint64(8 * levels), nodes


def decisions(level: int, codes: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """log10 of the probability that each code's bit has at ``level`` (0 to 7) of the byte's binary tree."""
    bit, one, _, _ = part_tree(codes, n, level, depth, depth)
    return np.log10(np.where(bit == 1, one, 1 - one))


def _roots(depth: int, split: int):
    """The nodes of ``split`` bytes of the parts, as (place, node, ones, zeros, weighted)."""

    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        codes, n, out = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy(), []
        for level in range(8):
            _, _, _, (nodes, ones, zeros, weighted) = part_tree(codes, n, level, depth, depth - split)
            out.append(pd.DataFrame({"place": (nodes >> np.uint64(8 * split)).astype(np.int32), "node": nodes.view(np.int64), "ones": ones, "zeros": zeros, "weighted": weighted}))
        return pd.concat(out)

    return work


def _top(split: int):
    """(node, shift, factor) of one place's nodes."""

    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        nodes = rows["node"].to_numpy().view(np.uint64)
        (shift, factor), _ = climb(nodes, rows["ones"].to_numpy(), rows["zeros"].to_numpy(), rows["weighted"].to_numpy(), split)
        return pd.DataFrame({"node": rows["node"], "shift": shift, "factor": factor})

    return work


def _whole(depth: int, split: int):
    """(gram, n, p) of a part, from its strings and the numbers of its nodes."""

    def work(key, rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        codes, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        top = top.sort_values("node")
        nodes, shift, factor = top["node"].to_numpy().view(np.uint64), top["shift"].to_numpy(), top["factor"].to_numpy()
        p = np.zeros(len(codes))
        for level in range(8 if len(codes) else 0):
            bit, one, node, _ = part_tree(codes, n, level, depth, depth - split)
            at = np.searchsorted(nodes, node)
            one = shift[at] + factor[at] * one
            p += np.log10(np.where(bit == 1, one, 1 - one))
        return pd.DataFrame({"gram": rows["gram"], "n": n, "p": p})

    return work


def probabilities(grams: DataFrame, depth: int, n_grams: int) -> DataFrame:
    """(gram, n, p): log10 of the probability of a byte string's last byte after the others."""
    split = min(SPLIT, depth)
    parts = F.lit(max(1, n_grams // TASK_GRAMS))
    of = lambda node: F.pmod(F.xxhash64(node), parts).cast("int").alias("part")
    rows = grams.select(of(F.expr(f"shiftrightunsigned(gram, {8 * (depth + 1 - split)})")), "gram", "n")
    roots = rows.groupBy("part").applyInPandas(_roots(depth, split), "place int, node long, ones double, zeros double, weighted double")
    top = roots.groupBy("place").applyInPandas(_top(split), "node long, shift double, factor double")
    top = top.select(of(F.expr(f"node & {(1 << (8 * split)) - 1}L")), "node", "shift", "factor")
    return rows.groupBy("part").cogroup(top.groupBy("part")).applyInPandas(_whole(depth, split), "gram long, n long, p double")


#: Never a code: the highest byte of one is zero at a depth below 7.
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Table:
    """Codes to values by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.4))))
        self.keys = np.full(1 << self.bits, FREE)
        self.values = np.zeros(1 << self.bits)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == FREE
            taken, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = keys[left[placed]], values[left[placed]]
            rest = np.ones(len(left), dtype=bool)
            rest[placed] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and whether there is one."""
        slot = self._slot(keys)
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.values[slot], 0.0)
        left = np.flatnonzero(~hit & (there != FREE))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            found = there == keys[left]
            out[left[found]], hit[left[found]] = self.values[slot[found]], True
            on = ~found & (there != FREE)
            left, slot = left[on], slot[on]
        return out, hit


_BUILT: dict[int, tuple] = {}


def _score(shared, depth: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if shared.id not in _BUILT:
            keys, values, frequent = shared.value
            _BUILT.clear()
            _BUILT[shared.id] = Table(keys, values), dict(zip(frequent["word"].to_pylist(), frequent["l"].to_pylist(), strict=True))
        table, get = _BUILT[shared.id][0], _BUILT[shared.id][1].get
        # rows are numbered within the task's partition: unique, and the same when a task is run again
        base = TaskContext.get().partitionId() << ROW_BITS

        def frame(rows: int, **columns) -> pd.DataFrame:
            empty = {"rid": "Int64", "n_tokens": "Int64", "known": "Int64", "gram": "Int64", "times": "Int64"}
            found = {c: pd.array([None] * rows, dtype=empty[c]) if c in empty else None for c in SCORED_COLUMNS}
            return pd.DataFrame(found | columns, index=range(rows))

        for batch in _bounded(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            total_score = np.zeros(len(texts))
            for codes, which in _pieces(texts, depth):
                values, hit = table.find(codes)
                total_score += np.bincount(which, weights=values, minlength=len(texts))
                if not hit.all():
                    codes, which = codes[~hit], which[~hit]
                    order = np.lexsort((which, codes))
                    codes, which = codes[order], which[order]
                    starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (which[1:] != which[:-1]))))
                    yield frame(len(starts), rid=base + which[starts], gram=codes[starts].view(np.int64), times=np.diff(np.append(starts, len(codes))))
            n_tokens, known, total = [], [], []
            rare: dict[bytes, list[int]] = {}
            for i, text in enumerate(texts):
                words = text.lower().split()
                found = [get(w) for w in words]
                hits = [f for f in found if f is not None]
                n_tokens.append(len(words) + 1)
                known.append(len(hits))
                total.append(float(np.sum(hits)) if hits else 0.0)
                if len(hits) < len(words):
                    for w, f in zip(words, found, strict=True):
                        if f is None:
                            rare.setdefault(w, []).append(i)
            yield frame(
                len(texts), rid=base + np.arange(len(texts)), doc_id=batch["doc_id"].to_numpy(), held_out=batch["held_out"].to_numpy(),
                n_tokens=n_tokens, known=known, total=total, score=total_score,
            )
            if rare:
                yield frame(len(rare), word=list(rare), rids=[base + np.array(v, dtype=np.int64) for v in rare.values()])
            base += len(texts)

    return work


SCORED = "rid long, doc_id string, held_out boolean, n_tokens long, known long, total double, score double, word binary, rids array<long>, gram long, times long"
SCORED_COLUMNS = [c.split()[0] for c in SCORED.split(", ")]


def _least(counts: DataFrame, rows: int) -> int | None:
    """The class of counts (see _step) from which at most ``rows`` rows are the most frequent; None where no class has so few."""
    least, held = None, 0
    for r in sorted(counts.groupBy(_step().alias("s")).agg(F.count("*").alias("c")).collect(), reverse=True):
        held += r["c"]
        if held > rows:
            break
        least = r["s"]
    return least


def _step():
    """Counts in classes by sixteenths of a power of two: about a thousand at most; -1 is no count."""
    return F.when(F.col("n") > 0, F.floor(F.log2("n") * 16)).otherwise(F.lit(-1)).cast("int")


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    common.check_columns(docs, doc, text)
    if not 1 <= depth <= 6:
        raise ValueError("the depth must be from 1 to 6")
    spark = docs.sparkSession
    held = (common.crc_bucket(F.col(doc), FOLDS) == HELD_OUT).alias("held_out")
    # ids cross to Python as text: with nulls among them, numbers would become floats
    rows = docs.select(F.col(doc).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"), held)
    with arrow_rows(spark, BATCH_ROWS):
        counted = materialize(rows.select("text", "held_out").mapInPandas(_count(depth), "gram long, word binary, n long"), "counts")
    grams = materialize(counted.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    words = materialize(counted.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_train = rows.filter("NOT held_out").count()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = sums["n"] + n_train, sums["v"] + (1 if n_train else 0)
    n_grams = grams.count()
    table = materialize(probabilities(grams, depth, n_grams), "probabilities")
    if table.count() != n_grams:
        raise RuntimeError("byte strings were lost")
    least_gram, least_word = _least(table, FREQUENT_GRAMS), _least(words, FREQUENT_WORDS)
    often = table.filter(_step() >= least_gram if least_gram is not None else F.lit(False)).select("gram", "p").toArrow()
    chosen = words.filter(_step() >= least_word if least_word is not None else F.lit(False))
    frequent = chosen.select("word", F.log10(F.col("n") + 1).alias("l")).toArrow().combine_chunks()
    keys, values = often["gram"].to_numpy().view(np.uint64), often["p"].to_numpy()
    shared = spark.sparkContext.broadcast((keys, values, frequent))
    del often, keys, values, frequent
    with arrow_rows(spark, BATCH_ROWS):
        scored = materialize(rows.mapInPandas(_score(_Shared(shared), depth), SCORED), "scored")
    rare = scored.filter("word IS NOT NULL").select("word", "rids").join(words, "word", "left")
    rare = rare.select(F.explode("rids").alias("rid"), F.log10(F.coalesce("n", F.lit(0)) + 1).alias("l"), F.col("n").isNotNull().cast("int").alias("k"), F.lit(0.0).alias("p"))
    strings = scored.filter("gram IS NOT NULL").select("gram", "rid", "times").join(table, "gram")
    strings = strings.select("rid", F.lit(0.0).alias("l"), F.lit(0).alias("k"), (F.col("p") * F.col("times")).alias("p"))
    rare = rare.union(strings).groupBy("rid").agg(F.sum("l").alias("l"), F.sum("k").alias("k"), F.sum("p").alias("p"))
    out = scored.filter("n_tokens IS NOT NULL").select("rid", "doc_id", "held_out", "n_tokens", "known", "total", "score").join(rare, "rid", "left")
    end = float(np.log10(n_train + 1))
    denominator = float(np.log10(train_tokens + (distinct + 1)))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0)) + F.lit(1 if n_train else 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("l", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (F.col("score") + F.coalesce("p", F.lit(0.0))).alias("score"),
    )


class _Shared:
    """A broadcast with a name that a worker can remember its table by."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, secrets.randbits(60)

    @property
    def value(self):
        return self.broadcast.value


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_ctw": op6_ctw}
ORACLE_SQL: dict = {}
