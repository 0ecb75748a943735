import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import op13_importance as op13


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, max_n=3):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets=10000, max_n=3, least=20, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    per = [(d, Counter(map(bucket, features(t, max_n))), len(words(t))) for d, t in docs]
    s, t = Counter(), Counter()
    for _, c, _ in per:
        s.update(c)
    for text in target:
        t.update(map(bucket, features(text, max_n)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for d, c, n in per:
        weight = sum(gain(b) * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.text(max_size=90)), min_size=1, max_size=90))
def test_crc_of_joined_texts(pairs):
    left = np.array([zlib.crc32(a.encode()) for a, _ in pairs], dtype=np.uint32)
    right = np.array([zlib.crc32(b.encode()) for _, b in pairs], dtype=np.uint32)
    n = np.array([len(b.encode()) for _, b in pairs], dtype=np.uint32)
    assert op13.appended(left, right, n).tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in pairs]


def test_crc_of_very_long_words():
    left, right = ["a"] * 80, ["b" * n for n in range(1, 8000, 100)]
    crc = lambda v: np.array([zlib.crc32(x.encode()) for x in v], dtype=np.uint32)
    found = op13.appended(crc(left), crc(right), np.array([len(x) for x in right], dtype=np.uint32))
    assert found.tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(left, right, strict=True)]


def test_number_of_words_follows_from_windows():
    for max_n in (1, 2, 3, 5):
        n = np.array([sum(max(0, w - k) for k in range(max_n)) for w in range(40)])
        assert op13._words_of(n, max_n).tolist() == list(range(40))


@pytest.mark.parametrize("max_n,percent", [(3, 5), (1, 30), (2, 100)])
def test_against_brute_force(spark, max_n, percent):
    rows = documents(150)
    target = [r[1] for r in rows[3:40:8]] + [None, "", "Alpha BETA ÜNÏ"]
    docs, goal = frame(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = op13.importance(docs, goal, max_n=max_n, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute([(r[0], r[1]) for r in rows], target, max_n=max_n, percent=percent)
    # rows that are equal in all but their rank may share out their ranks in any order
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v or 0) for v in r))
    assert order(found) == order(want)
    assert [r for r in found if r.rank is not None]


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in documents(40)] + [(7777, "x" * 500 + " " + "y-" * 300 + "Z")]
    want = brute(rows, ["alpha1 beta2 gamma3"])
    for size in (1, 13, 200):
        counter = op13._Counter(10000, 3)
        monkeypatch.setattr(op13, "SLICE_BYTES", size)
        texts = [t or "" for d, t in rows if t is None or len(t) < 3000]
        rid, bucket, n = counter.counts(texts)
        found = [Counter() for _ in texts]
        for i, b, k in zip(rid.tolist(), bucket.tolist(), n.tolist(), strict=True):
            assert b not in found[i]
            found[i][b] = k
        assert found == [Counter(zlib.crc32(f.encode()) % 10000 for f in features(t)) for t in texts]
    monkeypatch.undo()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([("alpha1 beta2 gamma3",)], "text string")
    found = op13.importance(docs, goal).select("doc_id", "n_features", "weight", "score").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(r[:4]) for r in want)


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, row long, rank string, weight double, total int, text_hash int"
    docs = spark.createDataFrame([(i, f"w{i} " * 30, 1, "r", 1.0, 1, 1) for i in range(40)], schema)
    none = spark.createDataFrame([], "text string")
    assert op13.importance(docs.limit(0), none).collect() == []
    found = op13.importance(docs, none).collect()
    assert len(found) == 40 and sorted(r["rank"] for r in found if r["rank"]) == [1, 2]
    kept = op13.draw(docs, none)
    assert kept.columns == docs.columns and kept.count() == 2


def test_ranks_across_partitions(spark):
    rows = [(i % 500, "same words here " * 10) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = op13.importance(docs, spark.createDataFrame([("same",)], "text string"), percent=50).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 1501))
    keys = [(-r["score"], r["doc_id"]) for r in found]
    assert keys == sorted(keys)
