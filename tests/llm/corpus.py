"""Small tables with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(60)) for _ in range(n)]


def documents(n=120, seed=0, toxic=False):
    r = random.Random(seed)
    rows = []
    base = [" ".join(words(r, r.randrange(30, 120))) for _ in range(n)]
    passage = " ".join(words(r, 40))
    for i, text in enumerate(base):
        kind = i % 8
        if kind == 1 and i > 8:
            text = base[i - 8]
        elif kind == 2 and i > 8:
            w = base[i - 8].split()
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = text[:50] + " " + passage + " " + text[50:]
        if toxic and i % 5 == 0:
            text += " utter idiot and m0ron"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(1000, None, None, None, None), (1001, "", None, "s0", 0), (1002, " \t\n ", "en", "s0", 4), (None, base[0], "en", None, 1), (3, base[3], "en", "s0", 1), (3, base[3], "en", "s0", 1)]
    rows += [(1003, " ".join(words(r, 30000)), "en", "s1", 1), (1004, "one two", "en", "s1", 1), (1005, "one two", "en", "s1", 1), (1006, "ünï çödé " * 40, "fr", "s2", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
