import math
import random
import re
import warnings
import zlib
from collections import Counter
from itertools import combinations

import pytest
from corpus import SCHEMA, documents, frame, words
from pyspark.sql import functions as F

from corvane.llm import op03_decontamination as op3
from corvane.llm import op04_url_filter as op4
from corvane.llm import op05_toxicity as op5

warnings.filterwarnings("ignore")


def items(seed=1, n=12):
    r = random.Random(seed)
    return [(i, " ".join(words(r, r.randrange(12, 40)))) for i in range(n)]


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def shingles(w):
    return Counter([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]) if w else Counter()


def brute(docs, bench):
    sets = {i: shingles(tokens(t)) for i, t in bench if i is not None and tokens(t)}
    n = len(sets)
    having = Counter(s for c in sets.values() for s in c)
    weight = lambda s: math.log(1 + n / having[s]) if s in having else math.log(1 + n)
    out = {}
    for d, t in docs:
        w = tokens(t)
        for i, c in sets.items():
            size = sum(c.values()) + 4 if sum(c.values()) > 1 or True else 0
            size = len(tokens(dict(bench)[i]))
            best = 0.0
            for at in range(max(1, len(w) - size + 1)):
                own = shingles(w[at : at + size])
                both = sum(min(own[s], c[s]) * weight(s) for s in own)
                every = sum(k * weight(s) for s, k in own.items()) + sum(k * weight(s) for s, k in c.items()) - both
                best = max(best, both / every if every else 0.0)
            if best >= 0.8 - 1e-12:
                out[(d, i)] = round(best, 9)
    return out


def test_decontamination_against_all_windows(spark):
    bench = items() + [(50, "one two three"), (51, ""), (52, None), (None, "alpha1 beta2 gamma3 delta4 epsilon5 zeta6")]
    r = random.Random(3)
    docs = [(i, " ".join(words(r, 60))) for i in range(40)]
    for i in range(0, 40, 2):
        w, b = docs[i][1].split(), bench[r.randrange(12)][1].split()
        if i % 4 == 0 and len(b) > 15:
            b[r.randrange(len(b))] = "edited"
        if i % 6 == 0:
            b = b[:-1]
        at = r.randrange(len(w))
        docs[i] = (i, " ".join(w[:at] + [x.upper() + "," for x in b] + w[at:]))
    docs += [(110, "and then one TWO, three there stand more words"), (111, " ".join(words(r, 20000) + bench[2][1].split()))]
    docs += [(100, None), (101, ""), (102, "One, two THREE"), (103, "one two"), (104, bench[0][1]), (104, bench[0][1]), (None, bench[1][1])]
    found = op3.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r_.doc_id, r_.item_id): r_.similarity for r_ in found}
    want = brute(docs, bench)
    assert len(found) == len(got) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert (110, 50) in got and (111, 2) in got


def test_windows_that_no_shingle_is_aligned_with(spark):
    """Two words in the middle: the windows at the shared shingles' own places stay below the similarity, one between them doesn't."""
    r = random.Random(5)
    head, tail = words(r, 5), words(r, 5)
    bench = [(i, " ".join(head + words(r, 43) + tail)) for i in range(301)]
    first = bench[0][1].split()
    docs = [(1, " ".join(first[:25] + ["put", "in"] + first[25:])), (2, " ".join(words(r, 4) + first[:25] + ["put", "in"] + first[25:] + words(r, 3)))]
    found = op3.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = brute(docs, bench)
    assert want and {(x.doc_id, x.item_id): x.similarity for x in found} == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("cell", [3, 128])
def test_insertions_and_deletions(spark, monkeypatch, cell):
    monkeypatch.setattr(op3, "CELL", cell)
    r = random.Random(11)
    bench = [(i, " ".join(words(r, r.choice([12, 20, 51, 51, 80, 100])))) for i in range(25)]
    bench += [(90, " ".join(["again"] * 9 + ["and", "once"] + ["again"] * 9)), (91, " ".join(words(r, 6) * 5)), (92, "two words"), (93, "word")]
    docs = []
    for i in range(160):
        b = r.choice(bench)[1].split()
        k, at = i % 8, r.randrange(len(b))
        if k < 5:
            b[at:at] = words(r, k + 1)
        else:
            del b[at : at + k - 4]
        docs.append((i, " ".join(words(r, r.randrange(0, 20)) + b + words(r, r.randrange(0, 20)))))
    docs += [(500, "again " * 40), (501, " ".join(bench[26][1].split() * 3)), (502, "two words two words word")]
    found = op3.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = brute(docs, bench)
    assert len(want) > 60 and {(x.doc_id, x.item_id): x.similarity for x in found} == pytest.approx(want, abs=1e-6)
    texts, items_ = dict(docs), dict(bench)
    for x in found:  # the window named is one of that similarity
        own = " ".join(tokens(texts[x.doc_id])[x.start : x.start + x.n_words])
        assert brute([(0, own)], bench).get((0, x.item_id)) == pytest.approx(x.similarity, abs=1e-6), (x, items_[x.item_id])


def test_no_words_are_shuffled(spark, monkeypatch):
    """Even where the items are too many for a broadcast."""
    monkeypatch.setattr(op3, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{t} and more") for i, t in items()], "doc_id long, text string")
    table = op3.item_table(bench)
    plan = op3.cells(docs, table, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"Exchange[^\n]*\bw#", plan)
    assert {(r.doc_id, r.item_id) for r in op3.contaminated(docs, bench).collect()} == {(i, i) for i, _ in items()}


def test_clean_and_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = frame(spark, documents(30))
    assert op3.clean(docs, bench).columns == docs.columns and op3.clean(docs, bench).count() == docs.count()
    assert op3.contaminated(docs.limit(0), bench).count() == 0
    assert op3.contaminated(docs, bench.limit(0)).count() == 0


URLS = [
    ("http://a.net/", "a.net", "/", "net/", "block"),
    ("http://A.NET", "a.net", "", None, "allow"),
    ("https://x.example.net/en/1?q=/de/", "x.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/EN/", "example.net", "/EN/", "net/", "block"),
    ("http://example.com/de/a#f", "example.com", "/de/a", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://org/fr/x://y", "org", "/fr/x://y", "org/fr/", "allow"),
    ("x://y?://a.net/", "y", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄB.Net/p\nq", "Äb.net", "/p\nq", "net/", "block"),
]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "mine") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, blocked boolean")
    found = {r.page_id: r for r in op4.judge(pages, labels).collect()}
    assert len(found) == len(URLS)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = found[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), URLS[i]


def test_mined_rules_block_their_urls(spark):
    r = random.Random(2)
    pages = []
    for i in range(600):
        bad = i % 4 == 0
        pages.append((i, f"http://{'casino-win' if bad else r.choice(['news', 'blog'])}.{r.choice(['site', 'page'])}.io/{r.choice(['a', 'b'])}/{i}"))
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 600, 2)] + [(1, None), (99999, True)], "doc_id long, blocked boolean")
    found = op4.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    assert all((r_.verdict == "block") == (r_.page_id % 4 == 0) for r_ in found)
    rules = op4.mine(spark.createDataFrame([(["t", "u"], True)] * 30 + [(["t"], True)] * 30 + [(["u"], False)] * 30, "tokens array<string>, blocked boolean")).collect()
    assert [(x.tokens, x.support, x.under) for x in rules] == [(["t"], 60, "t")]


def toxic_table(spark):
    docs = documents(200, toxic=True)
    labels = [(i, 1 if i % 5 == 0 else 0) for i in range(200)] + [(3, None), (777777, 1)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = toxic_table(spark)
    found = op5.score(docs.withColumnRenamed("n_chars", "score"), op5.model_for(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)


def test_toxicity_folding_and_exceptions():
    assert op5.fold("Yоu are an 1D10T, m0r0n") == "you are an idiot moron"
    assert op5.fold("ＩＤＩＯＴ i*d*i*o*t $tupid") == "idiot idiot stupid"
    match = op5.Matcher({"idiot": 2.0, "lowe*": 1.5}, ["village idiot"])
    assert [h[2] for h in match.hits("an idiot lowei")] == [2.0, 1.5]
    assert match.hits("the village idiot") == [] and match.hits("idiots flowe") == []


def test_toxicity_against_counting_by_hand(spark):
    """The lexicon, the exception phrases and the weights of texts, without an automaton or a table."""
    docs, labels = toxic_table(spark)
    docs = docs.unionByName(frame(spark, [(2000 + i, f"the village idiot of {w}", None, None, None) for i, w in enumerate(words(random.Random(8), 30))]))
    labels = labels.union(spark.createDataFrame([(2000 + i, 0) for i in range(30)], labels.schema))
    model = op5.model_for(docs, labels)
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    train = [(op5.fold(r.text or "").split(), toxic[r.doc_id]) for r in docs.collect() if r.doc_id in toxic and zlib.crc32(str(r.doc_id).encode()) % 5]
    t, c = sum(y for _, y in train), sum(1 - y for _, y in train)
    entries = lambda ws: {e for w in ws for e in (w, *(w[:n] + "*" for n in (4, 5) if len(w) > n))}
    n = {k: Counter(e for ws, y in train if y == k for e in entries(ws)) for k in (0, 1)}
    odds = lambda a, b: math.log((a + 0.5) / (t + 1)) - math.log((b + 0.5) / (c + 1))
    lexicon = {}
    for e in n[0] | n[1]:
        a, b, rate = n[1][e], n[0][e], t / (t + c)
        if a + b >= 5 and a >= op5.MIN_SHARE * t and odds(a, b) >= 1.5 and (a - (a + b) * rate) / math.sqrt((a + b) * rate * (1 - rate)) >= 5:
            lexicon[e] = odds(a, b)
    lexicon = {k: v for k, v in lexicon.items() if not any(lexicon.get(k[:m] + "*", -1.0) >= v - 0.5 for m in (4, 5) if len(k.rstrip("*")) > m)}
    assert model.lexicon == pytest.approx(lexicon) and "idio*" in lexicon

    def hits(ws, exceptions=()):
        found = {i: max((v for e, v in lexicon.items() if w == e or (e[-1] == "*" and w.startswith(e[:-1]))), default=0.0) for i, w in enumerate(ws)}
        inside = {k for i in range(len(ws) - 1) if " ".join(ws[i : i + 2]) in exceptions for k in (i, i + 1)}
        return {i: v for i, v in found.items() if v and i not in inside}

    phrases = {0: Counter(), 1: Counter()}
    for ws, y in train:
        phrases[y].update({" ".join(ws[k : k + 2]) for i in hits(ws) for k in (i - 1, i) if k >= 0 and len(ws[k : k + 2]) == 2})
    benign = sorted(p for p in phrases[0] if phrases[0][p] >= 5 and odds(phrases[1][p], phrases[0][p]) <= 0)
    assert model.exceptions == benign and "village idiot" in benign
    for r in op5.score(docs, model).collect():
        ws = op5.fold(r.text or "").split()
        total = sum(hits(ws, benign).values())
        z = model.beta[0] + model.beta[1] * math.log1p(total) + model.beta[2] * math.log1p(100 * total / max(1, len(ws)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_without_training_rows(spark):
    docs, labels = toxic_table(spark)
    for some in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0")):
        scores = {r.score for r in op5.score(docs, op5.model_for(docs, some)).collect()}
        assert len(scores) == 1
    assert op5.clean(docs.limit(0), labels).count() == 0
    kept = op5.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 40


@pytest.mark.parametrize("n", [1, 5])
def test_shingles_of_short_texts(spark, n):
    rows = spark.createDataFrame([(["a"] * n,), ([],)], "w array<string>")
    assert [len(r[0]) for r in rows.select(op3._shingles(rows.w)).collect()] == [1, 0]


def test_a_rule_of_five_tokens_is_mined(spark):
    five = list("abcde")  # any four of them are as often on other pages
    pages = [(five, True)] * 30 + [(five[:i] + five[i + 1 :], False) for i in range(5) for _ in range(30)]
    rules = op4.mine(spark.createDataFrame(pages, "tokens array<string>, blocked boolean")).collect()
    assert [(r.tokens, r.n_tokens, r.support) for r in rules] == [(five, 5, 30)]


def test_rules_against_listing_all_combinations(spark):
    r = random.Random(5)
    rows = [([t for t in "abcdefg" if r.random() < 0.4], r.random() < 0.3) for _ in range(400)]
    rows = [(t, y or {"a", "c"} <= set(t) or {"b", "d", "e"} <= set(t)) for t, y in rows] + [([], True), (["a", "a"], False)]
    having, blocked = Counter(), Counter()
    for t, y in rows:
        for k in range(1, 8):
            for x in combinations(sorted(set(t)), k):
                having[x] += 1
                blocked[x] += y
    rules = {x: n / having[x] for x, n in blocked.items() if n >= 20 and n / having[x] >= 0.8}
    least = {x: c for x, c in rules.items() if not any(set(o) < set(x) for o in rules)}
    found = {tuple(x.tokens): x.confidence for x in op4.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()}
    assert found == pytest.approx(least) and ("a", "c") in found
    assert op4.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean").limit(0)).count() == 0


def test_pages_that_repeat_and_tables_without_rows(spark):
    urls = [(1, "http://a.io/x"), (1, "http://a.io/x"), (None, "http://a.io/" + "long/" * 20000), (2, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("tokens", F.lit("mine"))
    labels = spark.createDataFrame([(1, True), (1, False), (2, True)], "page_id long, blocked boolean")
    found = op4.judge(pages, labels).collect()
    assert sorted((r.page_id or 0, r.host, len(r.path), r.verdict, r.tokens) for r in found) == [(0, "a.io", 100001, "allow", "mine"), (1, "a.io", 2, "allow", "mine"), (1, "a.io", 2, "allow", "mine"), (2, "", 0, "allow", "mine")]
    assert op4.judge(pages.limit(0), labels).count() == 0 and op4.judge(pages, labels.limit(0)).count() == 4
    numbers = spark.createDataFrame([("http://a.b/de/123.html",), ("http://a.b/de/45?x=1",), ("http://a.b/7/8/",), ("http://a.b/x9/",), (None,), ("http://a.b/" + "1" * 30,)], "url string")
    assert [r[0] for r in numbers.select(op4.document_of(F.col("url"))).collect()] == [123, 45, 7, None, None, None]
