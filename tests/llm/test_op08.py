import random
import warnings

import numpy as np
import pytest
import xxhash
from corpus import SCHEMA, documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import components as cc
from corvane.llm import op08_simhash_dedup as op8

warnings.filterwarnings("ignore")


def slow_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aAbÄé \t\n\x1f ", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint_follows_its_definition(text):
    assert op8.fingerprint_of(text) == slow_fingerprint(text)


def brute_components(prints, radius):
    keys = sorted(prints)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("radius", [0, 2, 3, 5, 7])
def test_links_join_exactly_the_fingerprints_in_range(spark, radius):
    r = random.Random(radius)
    keys = set()
    for _ in range(60):
        x = r.getrandbits(64)
        keys.add(x)
        for _ in range(6):  # chains at and beyond the radius
            for bit in r.sample(range(64), r.choice([radius, radius + 1, 1])):
                x ^= 1 << bit
            keys.add(x)
    keys |= {0, 2**64 - 1, 1, 1 << 63, (1 << 63) | 7}
    signed = np.array(sorted(keys), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(k,) for k in signed], "print long").repartition(7)
    found = {(a % 2**64, b % 2**64) for _, a, b in op8.links(df, radius).collect()}
    assert all(bin(a ^ b).count("1") <= radius for a, b in found)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {k: find(k) for k in keys} == brute_components(keys, radius)


def test_a_hot_cell_passes_on_a_forest(spark):
    r = random.Random(5)
    low = r.getrandbits(32)
    keys = {(r.getrandbits(2) << 40) | low for _ in range(5)} | {(h << 32) | low for h in range(2000)}
    df = spark.createDataFrame([(k,) for k in keys], "print long")
    found = op8.links(df, 3).collect()
    assert len(found) < 40 * len(keys)


def test_query_against_brute_force(spark):
    rows = documents()
    found = op8.linked(frame(spark, rows).withColumnRenamed("n_chars", "component_id")).collect()
    assert len(found) == len(rows)
    prints = {}
    for r in rows:
        prints.setdefault(slow_fingerprint(r[1]), []).append(r[0])
    comp = brute_components(prints, 3)
    least = {}
    for p, ids in prints.items():
        known = [i for i in ids if i is not None]
        if known:
            least[comp[p]] = min(least.get(comp[p], 1 << 60), *known)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add((r["__print"] % 2**64, r.component_id))
    for r in rows:
        p = slow_fingerprint(r[1])
        assert (p, least[comp[p]]) in by_id[r[0]]


def test_empty_table(spark):
    assert op8.linked(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op8.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def jaccard(a, b, n=5):
    a, b = (set(map(tuple, ([w[i : i + n] for i in range(max(1, len(w) - n + 1))] if w else []))) for w in ((a or "").lower().split(), (b or "").lower().split()))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("bound", [op8.BROADCAST_ROWS, 0])
def test_deduplicate_keeps_one_of_each_group_and_all_others(spark, monkeypatch, bound):
    monkeypatch.setattr(op8, "BROADCAST_ROWS", bound)
    rows = documents(160)
    kept = op8.deduplicate(frame(spark, rows)).collect()
    assert kept and set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    texts = [r.text for r in kept]
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            assert jaccard(a, b) < 0.8, (a[:60] if a else a, b[:60] if b else b)
    # whatever went is linked to something
    ids = {r.doc_id for r in kept}
    for r in rows:
        if r[0] not in ids:
            assert any(o[0] != r[0] and jaccard(o[1], r[1]) >= 0.8 for o in rows)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(500, 500)]
    found = dict(cc.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 300)) and 500 not in found


def groups_of(spark, texts):
    """The groups that the stage finds, and those by brute force."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = {r.ord: r.keeper_ord for r in op8.duplicates(frame(spark, rows)).collect()}
    sets = [set(map(tuple, (t.split()[i : i + 5] for i in range(max(1, len(t.split()) - 4))))) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [found[i] for i in range(len(texts))], [find(i) for i in range(len(texts))]


def test_near_duplicates_among_texts_of_the_same_words(spark):
    r = random.Random(3)
    vocabulary, texts = [f"w{i}" for i in range(60)], []
    for _ in range(40):  # pairs that differ in the order of two words near the end, and in nothing else
        w = r.sample(vocabulary, 60) + r.sample(vocabulary, 60)
        texts.append(" ".join(w))
        w[-1], w[-2] = w[-2], w[-1]
        texts.append(" ".join(w))
    found, expected = groups_of(spark, texts)
    assert len(set(expected)) == 40 and found == expected


def test_a_large_loosely_similar_group_loses_no_link(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(op8, "SLICE", 40, raising=False)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    texts = []
    for i in range(150):  # two versions of the base, and copies of each with up to five words changed: 0.8 lies within
        w = list(base)
        for k in range(0, 30, 6) if i % 2 else ():
            w[k] = "other"
        for k in r.sample(range(40, 200), r.randrange(1, 6)):
            w[k] = f"x{r.randrange(5000)}"
        texts.append(" ".join(w))
    found, expected = groups_of(spark, texts)
    assert 1 < len(set(expected)) < 100 and found == expected


@pytest.mark.parametrize("change", ["added", "cut", "edited"])
def test_recall_is_whole_just_above_the_similarity(spark, change):
    r = random.Random(change)
    texts = []
    for _ in range(150):
        n = r.randrange(60, 400)
        w = [f"w{r.randrange(20000)}" for _ in range(n)]
        part = max(1, int(n * 0.19))
        if change == "added":
            other = w + [f"w{r.randrange(20000)}" for _ in range(part)]
        elif change == "cut":
            other = w[part:]
        else:
            other = list(w)
            for k in range(2, n, 48):
                other[k] = "edited"
        texts += [" ".join(w), " ".join(other)]
    found, expected = groups_of(spark, texts)
    assert len(set(expected)) < 220 and found == expected


def test_a_group_of_two_thousand_near_copies(spark):
    r = random.Random(11)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(2000):
        w = list(base)
        for k in r.sample(range(150), r.randrange(1, 5)):
            w[k] = f"x{r.randrange(5000)}"
        texts.append(" ".join(w))
    for _ in range(100):  # pairs that belong to no other
        w = [f"w{r.randrange(5000)}" for _ in range(150)]
        texts += [" ".join(w), " ".join([*w[:149], "last"])]
    numbers = {}
    x = np.zeros((len(texts), 60_000), dtype=np.float32)
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 4):
            x[i, numbers.setdefault(tuple(w[k : k + 5]), len(numbers))] = 1
    x = x[:, : len(numbers)]
    both, n = x @ x.T, x.sum(1)
    links = both / (n[:, None] + n[None, :] - both) >= 0.8
    label = np.arange(len(texts))
    while True:
        least = np.array([label[row].min() for row in links])
        if (least == label).all():
            break
        label = least
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = {r_.ord: r_.keeper_ord for r_ in op8.duplicates(frame(spark, rows)).collect()}
    assert [found[i] for i in range(len(texts))] == label.tolist() and (label == 0).sum() > 1500


def test_long_texts_of_different_lengths(spark):
    r = random.Random(12)
    texts = []
    for n in (480, 505, 600, 1000, 1020, 2040, 3000):  # parities of one and of two sizes, and none
        w = [f"w{r.randrange(20000)}" for _ in range(n)]
        texts.append(" ".join(w))
        for share in (0.22, 0.255, 0.3):  # similarities of 0.82, 0.797 and less
            texts.append(" ".join(w + [f"w{r.randrange(20000)}" for _ in range(int(n * share))]))
    found, expected = groups_of(spark, texts)
    assert found == expected and len(set(expected)) > 10


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(ValueError):
        op8.deduplicate(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
