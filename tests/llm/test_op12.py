import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import op12_collocations as op12
from corvane.storage import shared_dir

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, max_n=5, least=100, top=2000, absorb=100):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, max_n + 1):
                for i in range(len(w) - size + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + size])] += 1
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= absorb * a for q, b in candidates.items()):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(12)] + ["É", "é", "ünï", "a\x0bb", "x-y", "'s"]
    phrases = [["new", "York", "City", "hall", "steps"], ["New", "york"], ["ad", "hoc"], ["É", "W1", "W2"], ["w3"] * 7]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(0, 30)):
            words += r.choice(phrases) if r.random() < 0.3 else [r.choice(vocabulary)]
            words.append(r.choice(["", "", "", ".", "!?", "\n", "\t", " , "]))
        rows.append((i, " ".join(words), r.choice(["en", "en", "fr", None, "und", ""])))
    return rows


@pytest.mark.parametrize("options", [{"min_count": 3}, {"min_count": 8, "top": 7, "max_n": 3}, {"min_count": 2, "absorb": 60, "max_n": 6}, {"min_count": 4, "max_n": 2, "absorb": 0}])
def test_against_brute_force(spark, options):
    rows = corpus(150, 1) + [(1, None, "en"), (2, "", "en"), (3, " . \t\n", None), (4, "New York " * 500, "en"), (4, "New York " * 500, "en")]
    found = op12.collocations(spark.createDataFrame(rows, SCHEMA), **options).collect()
    named = {"min_count": "least"}
    want = brute(rows, **{named.get(k, k): v for k, v in options.items()})
    assert want and sorted(map(tuple, found)) == want


def test_beyond_the_bound_of_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op12, "BROADCAST_PHRASES", 0)
    rows = corpus(60, 2)
    found = op12.collocations(spark.createDataFrame(rows, SCHEMA), min_count=3).collect()
    assert sorted(map(tuple, found)) == brute(rows, least=3)


def test_phrases_that_share_a_bit_of_the_filter(spark, monkeypatch):
    monkeypatch.setattr(op12, "FILTER_BITS", 16)
    rows = corpus(60, 3)
    found = op12.collocations(spark.createDataFrame(rows, SCHEMA), min_count=3, max_n=6).collect()
    assert sorted(map(tuple, found)) == brute(rows, max_n=6, least=3)


def test_a_filter_sets_the_bits_of_its_phrases_and_no_others(spark):
    rows = [("en", f"word{i} and{i % 7}") for i in range(3000)] + [("de", "word1 and1")]
    frequent = spark.createDataFrame(rows, "lang string, phrase string")
    kept = lambda df: op12._kept(df, frequent, F.col("phrase"))
    assert sorted(map(tuple, kept(frequent).collect())) == sorted(rows)
    others = spark.createDataFrame([("fr", p) for _, p in rows[:3000]], "lang string, phrase string")
    assert kept(others).count() < 3000 / 8
    assert op12._kept(frequent, frequent.limit(0), F.col("phrase")).count() == 0
    assert op12.bits_for(10**9) == op12.FILTER_BITS


def test_places_are_not_shuffled_and_files_do_not_stay(spark, monkeypatch):
    plans = {}
    write = op12.materialize
    monkeypatch.setattr(op12, "materialize", lambda df, name, **kw: (plans.setdefault(name, []).append(df._jdf.queryExecution().toString()), write(df, name, **kw))[1])
    monkeypatch.setattr(op12, "BROADCAST_PHRASES", 0)
    stored = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, threshold = stored(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(corpus(60, 4), SCHEMA)
        op12.collocations(docs, min_count=3)  # all but the last query has run
        for _ in range(50):
            if not (left := stored() - before):
                break
            time.sleep(0.2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) >= 4 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for of_name in plans.values() for p in of_name)
    assert not left
    where = shared_dir(spark).removeprefix("file:")
    assert not [d for d in os.listdir(where) if d.startswith(("runs-", "places-"))]


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**13 + 7, 10**15 + 1, 10**13 + 9, 10**14 + 3), (100, 99_999_999_999_999_999, 100, 100), (3 * 10**12, 10**16, 10**16 - 1, 3 * 10**12), (100, 200, 100, 100)]
    rows = spark.createDataFrame(cases, "a long, n long, l long, r long")
    found = rows.select("a", "n", "l", "r", op12.score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert {tuple(x)[:4]: x.s for x in found} == {c: 1000 * c[0] * c[1] // (c[2] * c[3]) for c in cases}


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "red wine red wine", "en", "w", 1, 2) for i in range(100)], SCHEMA + ", phrase string, size int, w1 int")
    assert op12.collocations(docs.limit(0)).collect() == []
    found = op12.collocations(docs).collect()
    assert [tuple(r) for r in found] == brute([tuple(r)[:3] for r in docs.collect()])
