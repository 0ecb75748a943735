"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick.

Training (Spark aggregates over all labelled training rows, which are folded
once): for every folded
word and every word beginning of four or five letters, the number of toxic
and of clean documents that have it; an entry is kept where its smoothed log
odds over the base rate are high and not by chance. A two-word phrase around
a lexicon word that is as common in clean text as in toxic text becomes an
exception: the word doesn't count there.

Scoring (Arrow batches): a text is folded (NFKC, case, homoglyphs, digits that
stand for letters, marks inside words), all lexicon entries are found by one
Aho-Corasick pass, those inside an exception phrase are taken out, and the
weights that are left are summed and divided by the text's length. The score
is a logistic of the sum and of the sum a word, fitted on the training rows.

Only texts make a score: labels, lang, source and doc_id are no inputs.

Defined results
* null and empty texts score like a text without any lexicon entry;
* a null label is no label; a document with several labels counts with each;
* without training rows of both kinds every score is the base rate;
* whole texts are scored, however long;
* ``held_out``, ``score`` and ``predicted`` replace input columns of these names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import materialize, scratch

from . import common

FOLDS, HELD_OUT = 5, 0
#: Documents that must have an entry, its log odds over the base rate, and how many deviations they lie above it.
MIN_DOCS, MIN_LOG_ODDS, MIN_DEVIATIONS = 5, 1.5, 5.0
#: The part of the toxic documents that must have an entry, and of the clean ones that must have an exception phrase.
#: So there are at most as many as the mean such document has, divided by this, however many documents there are.
MIN_SHARE = 0.0005
PREFIXES = (4, 5)
#: Training documents for the two coefficients and the offset at most, those of the smallest MD5 of their id.
MAX_FIT_ROWS = 50_000
#: Labels (16 bytes each) are broadcast up to this number, counted first.
BROADCAST_LABELS = 2_000_000

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(HOMOGLYPHS)
_ALIKE = re.compile(f"[{''.join(HOMOGLYPHS)}]")
_SIGN = re.compile(f"[{re.escape(''.join(DIGITS))}]")
_LEET = str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W_]+")
#: A word in which a digit or sign stands beside letters.
_MIXED = re.compile(r"(?<![^\s.,;:])(?=\S*[^\W\d_])[^\W_]*[0-9@$!][^\s]*[^\W\d_]")
_JOINTS = re.compile(r"(?<=[^\W_])[­​-‏⁠*]+(?=[^\W_])")


def fold(text: str) -> str:
    """Lower-cased text with look-alikes replaced and single spaces between words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and _ALIKE.search(text):
        text = text.translate(_FOLD)
    if "*" in text or not text.isascii():
        text = _JOINTS.sub("", text)
    if _SIGN.search(text):
        text = _letters(" ".join(text.split()))
    return " ".join(_WORD.findall(text))


def _letters(text: str) -> str:
    """Text with single spaces, in which signs within words of letters are letters; only words with a sign are looked at."""
    out, at = [], 0
    for m in _SIGN.finditer(text):
        if m.start() >= at:
            begin, end = text.rfind(" ", 0, m.start()) + 1, text.find(" ", m.end())
            end = len(text) if end < 0 else end
            out += [text[at:begin], _MIXED.sub(lambda w: w[0].translate(_LEET), text[begin:end])]
            at = end
    return "".join([*out, text[at:]])


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of toxic and clean documents by entry, summed within a task's batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = set(text.split())
            for entry in words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}:
                counts.setdefault(entry, [0, 0])[int(toxic)] += 1
        if counts:
            both = np.array(list(counts.values()))
            yield pd.DataFrame({"entry": list(counts), "n_toxic": both[:, 1], "n_clean": both[:, 0]})


def _phrases(lexicon: dict[str, float]):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(lexicon, ())
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen = set()
                folded = text
                for start, end, _ in match.hits(folded):
                    end = folded.find(" ", end) if folded.find(" ", end) >= 0 else len(folded)
                    before = folded.rfind(" ", 0, max(0, start - 1)) + 1 if start else start
                    after = folded.find(" ", end + 1)
                    after = len(folded) if after < 0 else after
                    seen.add(folded[before:end])
                    seen.add(folded[start:after])
                for phrase in seen:
                    if " " in phrase:
                        counts.setdefault(phrase, [0, 0])[int(toxic)] += 1
            if counts:
                both = np.array(list(counts.values()))
                yield pd.DataFrame({"entry": list(counts), "n_toxic": both[:, 1], "n_clean": both[:, 0]})

    return found


class Matcher:
    """Finds lexicon entries in folded text; an entry with ``*`` at its end is a word's beginning."""

    def __init__(self, lexicon: dict[str, float], exceptions) -> None:
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.words.add_word(" " + entry[:-1] if entry.endswith("*") else f" {entry} ", (len(entry.rstrip("*")), weight))
        self.phrases = ahocorasick.Automaton()
        for phrase in exceptions:
            self.phrases.add_word(f" {phrase} ", len(phrase))
        for a in (self.words, self.phrases):
            if len(a):
                a.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight), the heaviest entry for each place, without those in an exception phrase."""
        if not len(self.words):
            return []
        padded = f" {folded} "
        best: dict[int, tuple[int, int, float]] = {}
        for last, (n, weight) in self.words.iter(padded):
            whole = padded[last] == " "
            start = last - n - (1 if whole else 0) + 1  # in padded text, the first letter
            if start not in best or weight > best[start][2]:
                best[start] = (start - 1, start - 1 + n, weight)
        if best and len(self.phrases):
            for last, n in self.phrases.iter(padded):
                for start in [s for s in best if last - n <= s < last]:
                    del best[start]
        return list(best.values())


def _weigh(match: Matcher, texts: Iterable[str]) -> np.ndarray:
    """(sum of weights, sum a hundred words) of each folded text."""
    rows = []
    for folded in texts:
        total = math.fsum(w for _, _, w in match.hits(folded))
        rows.append((total, 100.0 * total / (folded.count(" ") + 1)))
    return np.array(rows).reshape(-1, 2)


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1])])


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method with a slight ridge."""
    z, beta = _inputs(x), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - 1e-2 * beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(3), grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(b) for b in beta]


class Model:
    def __init__(self, lexicon: dict[str, float], exceptions: list[str], beta: list[float]) -> None:
        self.lexicon, self.exceptions, self.beta = lexicon, exceptions, beta

    def matcher(self) -> Matcher:
        return Matcher(self.lexicon, self.exceptions)

    def scores(self, texts, matcher: Matcher | None = None) -> np.ndarray:
        z = _inputs(_weigh(matcher or self.matcher(), (fold(t or "") for t in texts))) @ np.array(self.beta)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(labelled: DataFrame) -> Model:
    """labelled: text (folded), toxic (0 or 1), __order (any text to choose the rows of the last step by)."""
    rows = labelled.filter("toxic IN (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"), "__order")
    totals = rows.agg(F.count_if(F.expr("toxic = 1")).alias("t"), F.count_if(F.expr("toxic = 0")).alias("c")).first()
    t, c = totals["t"], totals["c"]
    if not t or not c:
        base = 0.5 if t == c else (0.95 if t else 0.05)
        return Model({}, [], [math.log(base / (1 - base)), 0.0, 0.0])
    schema = "entry string, n_toxic long, n_clean long"

    def counted(function, rows):
        found = rows.select("text", "toxic").mapInPandas(function, schema)
        return found.groupBy("entry").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))

    n = F.col("n_toxic") + F.col("n_clean")
    rate = F.lit(t / (t + c))
    odds = F.log((F.col("n_toxic") + 0.5) / F.lit(t + 1.0)) - F.log((F.col("n_clean") + 0.5) / F.lit(c + 1.0))
    deviations = (F.col("n_toxic") - n * rate) / F.sqrt(n * rate * (1 - rate))
    entries = counted(_features, rows).withColumns({"odds": odds, "dev": deviations})
    common_enough = (n >= MIN_DOCS) & (F.col("n_toxic") >= MIN_SHARE * t)
    entries = entries.filter(common_enough & (F.col("odds") >= MIN_LOG_ODDS) & (F.col("dev") >= MIN_DEVIATIONS))
    lexicon = {r["entry"]: float(r["odds"]) for r in sorted(entries.select("entry", "odds").collect())}
    # a longer entry says nothing new where its own beginning is as telling
    lexicon = {k: v for k, v in lexicon.items() if not any(lexicon.get(k[:n] + "*", -1.0) >= v - 0.5 for n in PREFIXES if len(k.rstrip("*")) > n)}
    phrases = counted(_phrases(lexicon), rows).withColumn("odds", odds)
    benign = phrases.filter((F.col("odds") <= 0) & (F.col("n_clean") >= max(MIN_DOCS, MIN_SHARE * c)))
    exceptions = sorted(r["entry"] for r in benign.select("entry").collect())

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(lexicon, exceptions)
        for batch in batches:
            x = _weigh(match, batch["text"])
            yield pd.DataFrame({"s": x[:, 0], "d": x[:, 1], "toxic": batch["toxic"], "o": batch["__order"]})

    weighed = rows.select("text", "toxic", "__order").mapInPandas(weigh, "s double, d double, toxic int, o string")
    sample = weighed.orderBy("o", "s", "d", "toxic").limit(MAX_FIT_ROWS).toPandas()
    return Model(lexicon, exceptions, _fit(sample[["s", "d"]].to_numpy(), sample["toxic"].to_numpy(float)))


def labelled_rows(docs: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Training rows: labelled documents outside the held-out fold."""
    labels = labels.select(F.col("doc_id").alias("__id"), F.col("toxic")).filter("toxic IS NOT NULL")
    rows = docs.select(F.col(doc).alias("__id"), F.col("text")).filter(common.crc_bucket(F.col("__id"), FOLDS) != HELD_OUT)
    if labels.count() <= BROADCAST_LABELS:  # else both sides are shuffled by id
        labels = F.broadcast(labels)
    return rows.join(labels, "__id").select("text", "toxic", F.md5(F.col("__id").cast("string")).alias("__order"))


def score(docs: DataFrame, model: Model, doc: str = "doc_id") -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    common.check_columns(docs, doc, "text")
    docs = docs.drop("held_out", "score", "predicted")

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = model.matcher()
        for texts in batches:
            yield pd.Series(model.scores(texts, match))

    return (
        docs.withColumn("held_out", common.crc_bucket(F.col(doc), FOLDS) == HELD_OUT)
        .withColumn("score", scored(F.col("text")))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def folded(rows: DataFrame) -> DataFrame:
    """Training rows with their texts folded."""

    @F.pandas_udf("string")
    def folds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: fold(t or ""))

    return rows.withColumn("text", folds(F.col("text")))


def model_for(docs: DataFrame, labels: DataFrame, doc: str = "doc_id") -> Model:
    with scratch(docs.sparkSession):
        return train(materialize(folded(labelled_rows(docs, labels, doc)), "labelled"))


def clean(docs: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``docs`` without those that a model learned from them predicts to be toxic, in their own columns."""
    model = model_for(docs, labels, doc)
    mine = {c: f"__in_{c}" for c in ("held_out", "score", "predicted") if c in docs.columns}
    scored = score(docs.withColumnsRenamed(mine), model, doc).filter(F.col("predicted") == 0).drop("held_out", "score", "predicted")
    return scored.withColumnsRenamed({v: k for k, v in mine.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = model_for(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict = {}
