import hashlib
import random
import tracemalloc
import warnings

import numpy as np
import pandas as pd

from corpus import SCHEMA, documents, frame

from corvane.llm import op02_suffix_dedup as op2

warnings.filterwarnings("ignore")


def brute(rows, length=50):
    first = {}
    texts = [(1 << 63 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == 1 << 63 else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    found = op2.deduplicate(frame(spark, rows).repartition(5), **options)
    return sorted((tuple(r[:5]) for r in found.collect()), key=str)


def test_against_brute_force(spark):
    rows = documents(60)
    rows = [r for r in rows if r[0] != 1003] + [(1003, "ab" * 40 + "x" + "ab" * 60, None, None, None), (1007, "a" * 300, None, None, None), (1008, "b" + "a" * 120, None, None, None), (1009, "\0" * 90 + "z", None, None, None), (1010, "\0" * 70, None, None, None)]
    assert run(spark, rows) == brute(rows)


def test_random_texts_of_few_letters(spark):
    r = random.Random(4)
    rows = []
    for i in range(80):
        t = "".join(r.choice("ab") for _ in range(r.randrange(0, 160)))
        if i > 5 and r.random() < 0.7:
            o = r.choice(rows)[1]
            a = r.randrange(0, max(1, len(o)))
            t = t[: r.randrange(0, len(t) + 1)] + o[a : a + r.randrange(40, 90)] + t
        rows.append((r.randrange(0, 60), t, None, None, None))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, length=20) == brute(rows, 20)


def test_spans_and_kept_bytes(spark):
    rows = documents(40)
    for r in op2.deduplicate(frame(spark, rows), with_text=True).collect():
        if r.n_removed and r.kept is not None:
            assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_empty_table(spark):
    assert op2.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loser_tree_merges_in_order():
    r = random.Random(1)
    for k in (1, 2, 3, 7):
        runs, want = [], []
        for _ in range(k):
            items = sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(17, 30))) for _ in range(r.randrange(1, 40)))
            want += items
            prefixes, tails, last = [], [], b""
            for s in items:
                n = op2.common_prefix(last, s)
                prefixes.append(n)
                tails.append(s[n:])
                last = s
            import numpy as np

            z = np.zeros(len(items), dtype=np.int64)
            runs.append(op2.Run(op2._pack(np.array(prefixes, np.uint8), b"".join(tails), np.array([len(s) for s in items], np.uint8), b"", z.astype(np.uint8), op2._planes(z + 1), op2._planes(z), op2._planes(z), np.zeros((1, 2), np.int64))))
        got = list(op2.merged(runs))
        assert [g[2] for g in got] == sorted(want)
        last = b""
        for known, _, s, _ in got:
            assert known == op2.common_prefix(last, s)
            last = s


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, long, None, None, None), (2, "xyz" + long[262_000:263_000] + "q", None, None, None)]
    found = {r_[0]: r_ for r_ in run(spark, rows)}
    assert found[1][2] == 0 and found[2][2:4] == (1000, 1)


def test_a_passage_of_most_texts_is_one_row_a_run(spark):
    import numpy as np
    import pandas as pd

    r = random.Random(7)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    rows = [(i // 2 * 2 if i < 20 else i, f"{i} {i * 7} " + passage + f" {i * 13}" + passage[:60] * (i % 3), None, None, None) for i in range(300)]
    assert run(spark, rows) == brute(rows)
    texts = pd.DataFrame({"text": [x[1].encode() for x in rows], "ord": [x[0] for x in rows], "tid": range(300)})
    (blocks,) = list(op2._anchor_blocks(1, 50)(iter([texts])))
    assert len(blocks[blocks["decided"]]) == 1
    assert len(op2._shared_anchors(1)((0,), blocks[~blocks["decided"]])) == 0  # what is left occurs under one id
    local = op2._joined(op2._unpack(blocks[~blocks["decided"]]["block"].iloc[0])[1])
    assert len(local) < 600  # not the thousands of the passage's anchors
    places = op2._places_of_texts((0,), blocks[blocks["decided"]][["part", "block"]])
    (runs,) = list(op2._suffix_runs(1, 50)(iter([texts.merge(places, on=["ord", "tid"])])))
    counts = [op2.Run(b).counts for b in runs["run"].dropna()]
    assert max(np.max(c) for c in counts) <= 4 and len(runs["spans"].dropna()) == 1


def test_periodic_texts(spark):
    r = random.Random(9)
    rows = []
    for i in range(70):
        unit = "".join(r.choice("-+=ab") for _ in range(r.choice([1, 1, 2, 2, 3, 5, 7, 16, 20, 33, 34, 35, 40])))
        if i > 4 and r.random() < 0.6:
            unit = rows[r.randrange(len(rows))][5]
        shift = r.randrange(len(unit))
        body = (unit * 400)[shift : shift + r.randrange(30, 420)]
        text = r.choice(["", "x", "head of it "]) + body + r.choice(["", "y", " tail", body[:60]])
        rows.append((r.randrange(0, 50), text, None, None, None, unit))
    rows = [x[:5] for x in rows]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, length=20) == brute(rows, 20)


def test_long_stretches_are_few_rows():
    """Twenty MB of dashes: bounded memory, and rows that don't grow with the stretch."""
    n = 20_000_000
    texts = [b"-" * n, b"+-" * (n // 2) + b"end"]
    frames = pd.DataFrame({"text": texts, "ord": [1, 2], "tid": [11, 12]})
    tracemalloc.start()
    rows = pd.concat(op2._anchor_blocks(4, 50)(iter([frames])))
    shared = [op2._joined(op2._unpack(b)[2]) for b in rows["block"]]
    places = np.unique(np.concatenate(shared))
    assert len(places) < 1000
    with_places = frames.assign(places=[places[:200], places[:200]]).iloc[:1]
    runs = pd.concat(op2._suffix_runs(4, 50)(iter([with_places])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and sum(len(b) for b in runs["run"].dropna()) < 1 << 20
