import hashlib
import warnings
from collections import Counter

from corpus import documents, frame, words
from pyspark.sql import functions as F
from test_op03_op04_op05 import brute as leaks
from test_op03_op04_op05 import shingles
from test_op07_op10 import brute_targets

import corpus_pipeline as pipeline

warnings.filterwarnings("ignore")


def tables(spark, path, rows):
    import random

    r = random.Random(9)
    leak = " ".join(words(r, 25))
    rows = rows + [(2000, "before it " + leak.upper() + ", after it " + " ".join(words(r, 40)), "en", "s2", 1)]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 1 if i % 5 == 0 else 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = tables(spark, path, documents(200, toxic=True))
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: [r.doc_id for r in found] for name, found in seen.items()}
    assert not any(i is not None and i < 200 and i % 5 == 0 for i in ids["toxicity"])
    assert set(i for i in range(200) if i % 5) <= set(ids["toxicity"])
    pairs = [(r.doc_id, r.text) for r in seen["near_duplicates"]]
    assert len(set(pairs)) == len(pairs) < len(ids["toxicity"])
    assert 2000 in ids["near_duplicates"] and 2000 not in ids["decontamination"]
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - {2000}
    texts = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in texts for r in seen["mixing"])
    assert max(Counter((r.doc_id, r.text) for r in seen["mixing"]).values()) <= 2
    assert sorted(map(str, ids["sharding"])) == sorted(map(str, ids["mixing"])) and all(r.shard_id for r in seen["sharding"])


def test_empty_documents(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    tables(spark, path, [])
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, path)
        assert empty.count() == 0


def one_of_each_group(rows):
    """Rows that stay: of each component of texts with a similarity of 0.8 the smallest id, once."""
    rows = list(dict.fromkeys(rows))
    sets = [set(shingles((t or "").encode().lower().split())) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (len(a & sets[j]) / len(a | sets[j]) if a | sets[j] else 1.0) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((float("inf") if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), r))
    return [min(g)[2] for g in groups.values()]


def mixed(rows):
    """Whole rows up to each source's budget, in the order of the keys."""
    words = lambda t: len((t or "").encode().split())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    sizes = {}
    for _, t, source in rows:
        sizes[source] = sizes.get(source, 0) + words(t)
    out, targets = [], brute_targets(sizes)
    for source, size in sizes.items():
        mine = sorted((md5(f"{'' if i is None else i}:{md5(t or '')}"), (i, t, s)) for i, t, s in rows if s == source)
        if not size:
            out += [r for _, r in mine]
            continue
        epochs = int(targets[source] // size)
        rest, done = round(targets[source] - epochs * size), 0
        for _, r in mine:
            n = words(r[1])
            more = rest > 0 and (done + n <= rest or (done <= rest and 2 * (rest - done) >= n)) and not (n == 0 and done > rest)
            out += [r] * (epochs + more)
            done += n
    return out


def test_stages_against_brute_force(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    tables(spark, path, [r for r in documents(150, seed=4, toxic=True) if r[0] != 1003])
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    triple = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    before = triple(docs)
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, path), name)
        seen[name] = triple(docs)
    order = lambda rows: sorted(rows, key=str)
    assert order(seen["toxicity"]) == order(r for r in before if "utter idiot" not in (r[1] or ""))
    assert order(seen["near_duplicates"]) == order(one_of_each_group(seen["toxicity"]))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    held = {d for d, _ in leaks([(i, t) for i, t, _ in seen["near_duplicates"]], items)}
    assert 2000 in held and order(seen["decontamination"]) == order(r for r in seen["near_duplicates"] if r[0] not in held)
    assert order(seen["mixing"]) == order(mixed(seen["decontamination"])) and order(seen["sharding"]) == order(seen["mixing"])


def test_stages_return_columns_of_any_name(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    tables(spark, path, documents(40, toxic=True))
    names = ["ord", "tid", "sid", "n", "score", "held_out", "predicted", "hash", "w", "size", "source_size", "taken", "target", "start", "text_hash", "places", "keeper_ord", "component", "item_id", "a", "b"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(c + "="), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in names})
    for name, stage in pipeline.STAGES[:4]:
        out = pipeline.materialize(stage(spark, docs, path), name)
        assert out.columns == docs.columns and out.count() > 20
        for c in names:
            assert out.filter(F.col(c) != F.concat(F.lit(c + "="), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).isEmpty(), (name, c)
        docs = out
