import base64
import hashlib
import math
import random
import struct
import warnings
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from corpus import SCHEMA, documents, frame

from corvane.llm import op06_ctw as op6
from corvane.llm import op09_warc as op9

warnings.filterwarnings("ignore")


def kt(a, b):
    p = Fraction(1)
    for i in range(a):
        p *= Fraction(2 * i + 1, 2) / (i + 1)
    for i in range(b):
        p *= Fraction(2 * i + 1, 2) / (a + i + 1)
    return p


class SlowTree:
    """Context-tree weighting over bytes with exact fractions."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, {}, {}
        for t in texts:
            data = bytes(depth) + t + b"\0"
            for i in range(depth, len(data)):
                for place, bit in self.path(data[i]):
                    for d in range(depth + 1):
                        c = (place, data[i - d : i])
                        self.counts.setdefault(c, [0, 0])[bit] += 1
                        if d:
                            self.children.setdefault((place, data[i - d + 1 : i]), set()).add(c)
        self.cache = {}

    @staticmethod
    def path(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    def weighted(self, node):
        if node not in self.cache:
            own = kt(*self.counts[node])
            if len(node[1]) == self.depth:
                self.cache[node] = own
            else:
                rest = Fraction(1)
                for c in self.children[node]:
                    rest *= self.weighted(c)
                self.cache[node] = (own + rest) / 2
        return self.cache[node]

    def bit(self, place, context, bit, d=0):
        node = (place, context[len(context) - d :])
        n = self.counts.get(node, [0, 0])
        own = Fraction(2 * n[bit] + 1, 2 * sum(n) + 2)
        if d == self.depth or (place, context[len(context) - d - 1 :]) not in self.counts:
            return own
        stop = kt(*n) / 2 / self.weighted(node)
        return stop * own + (1 - stop) * self.bit(place, context, bit, d + 1)

    def score(self, text):
        data, total = bytes(self.depth) + text + b"\0", 0.0
        for i in range(self.depth, len(data)):
            for place, bit in self.path(data[i]):
                total += math.log10(self.bit(place, data[i - self.depth : i], bit))
        return total


@pytest.mark.parametrize("depth, frequent", [(2, 1 << 21), (3, 1 << 21), (3, 40), (1, 0), (4, 0)])
def test_scores_follow_the_exact_tree(spark, monkeypatch, depth, frequent):
    """Whether strings are broadcast or joined, and in however many parts the contexts are worked out."""
    monkeypatch.setattr(op6, "FREQUENT_GRAMS", frequent)
    monkeypatch.setattr(op6, "TASK_GRAMS", 25)
    r = random.Random(1)
    rows = [(i, "".join(r.choice("aab ä") for _ in range(r.randrange(0, 25))), None, None, None) for i in range(30)] + [(31, None, None, None, None), (31, "", None, None, None)]
    rows += [rows[3], rows[3]]  # repeated rows and ties
    found = sorted((x.doc_id, x.score) for x in op6.score(frame(spark, rows), depth=depth).collect())
    train = [(t or "").encode() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tree = SlowTree(train, depth)
    want = sorted((i, tree.score((t or "").encode())) for i, t, *_ in rows)
    assert [i for i, _ in found] == [i for i, _ in want]
    assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-9)


def test_held_out_texts_alter_no_other_score(spark):
    rows = documents(60)
    held = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    more = rows + [(i, "strings of bytes that stand nowhere else " + str(i) * 40, None, None, None) for i in held]
    scores = lambda rows: {(x.doc_id, x.n_tokens): x.score for x in op6.score(frame(spark, rows)).collect()}
    before, after = scores(rows), scores(more)
    assert len(after) == len(before) + 3
    assert [after[k] for k in before] == pytest.approx(list(before.values()), rel=1e-12)


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(op6, "FREQUENT_WORDS", 15)  # most words go through the join
    rows = documents(80)
    found = op6.score(frame(spark, rows)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, n_docs = Counter(), 0
    for r in rows:
        if not held(r[0]):
            c.update((r[1] or "").encode().lower().split())
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + 1
    c["</s>"] = n_docs
    want = []
    for r in rows:
        w = (r[1] or "").encode().lower().split() + ["</s>"]
        want.append((r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found]
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3
    assert all(r.score < 0 for r in found)


def test_each_distribution_adds_up_to_one():
    r = random.Random(3)
    context = 0x616263
    codes = np.array([(context << 8) | s for s in range(256)] + [(0x616263 << 8) | 0x61] * 3 + [((0x61 << 16 | r.randrange(1 << 16)) << 8) | 0x62 for _ in range(50)], dtype=np.uint64)
    n = np.array([0] * 256 + [5, 1, 1] + [2] * 50)
    keys, first = np.unique(codes, return_inverse=True)
    n = np.bincount(first, weights=n).astype(np.int64)
    total = np.zeros(len(keys))
    for place in range(1, 256):
        level = place.bit_length() - 1
        mine = ((keys & np.uint64(255)) >> np.uint64(8 - level)) | np.uint64(1 << level) == place
        total[mine] += op6.decisions(level, keys[mine], n[mine], 3)
    assert abs(sum(10 ** total[(keys >> np.uint64(8)) == context]) - 1) < 1e-9


def test_language_model_edge_cases(spark):
    assert op6.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = op6.score(frame(spark, [(only, "ab", None, None, None)])).first()
    assert (r.train_tokens, r.n_known) == (0, 0) and abs(r.score - 24 * math.log10(0.5)) < 1e-4
    ties = op6.score(frame(spark, [(1, "same text", None, None, None), (2, "same text", None, None, None), (2, "same text", None, None, None)])).collect()
    assert len(ties) == 3 and len({r.score for r in ties}) == 1


def test_pieces_of_long_texts(monkeypatch):
    texts = [b"abcdefghij" * 5, b"", b"x"]
    one = [(c.tolist(), w.tolist()) for c, w in op6._pieces(texts, 3)]
    monkeypatch.setattr(op6, "PIECE", 7)
    many = [(c.tolist(), w.tolist()) for c, w in op6._pieces(texts, 3)]
    assert len(many) > 3 and [sum((x[k] for x in many), []) for k in (0, 1)] == [sum((x[k] for x in one), []) for k in (0, 1)]


PAGES = "page_id long, url string, html string, record_type string"


def pages():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("<p>abc é\r\n\0 ") for _ in range(n))
    rows = [(i, f"http://x/{i}", text(r.randrange(0, 900)), "mine") for i in range(150)]
    rows += [(200 + i, "http://copy\r\nX: y/", rows[i % 5][2], None) for i in range(40)]
    return rows + [(300, None, None, None), (301, "u", "", None), (302, "u", "", None), (303, "big", text(300_000), None), (304, "twice", "same", None), (304, "twice", "same", None), (None, "none", "same", None), (None, "alone", "alone", None)]


def brute(rows, least=0):
    largest = {}
    for i, _, h, _ in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, _, h, _ in rows:
        b, top = (h or "").encode(), largest.get(h or "")
        again = len(b) >= least and top is not None and i != top
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "archives"), [(0, None), (10, 5)])
def test_archives_round_trip(spark, tmp_path, least, archives):
    rows = pages()
    path = f"file://{tmp_path}/a{least}"
    op9.write(spark.createDataFrame(rows, PAGES), path, least_bytes=least, archives=archives)
    found = op9.read(spark, path).collect()
    got = sorted(((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in found), key=str)
    assert got == brute(rows, least)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.html) == html[int(r.page_id)] for r in found if r.record_type == "response" and r.page_id is not None)


def test_any_reader_can_read_the_frames(spark, tmp_path):
    rows = pages()[:60]
    op9.write(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/a", archives=1)
    data = next(tmp_path.glob("a/part-*")).read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    text = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == 60


def test_faults_are_found(spark):
    payload = b"<html>"
    one = op9.record("1", "http://x", payload, None, len(payload), op9.digest_of(payload))
    assert op9.parse(one, "a")["page_id"] == "1"
    for fault in (one.replace(b"WARC/1.1", b"WARC/9.9"), one[:-1], one + b"x", one.replace(b"<html>", b"<HTML>"), one.replace(b"Content-Length: ", b"Content-Length: 1", 1), one.replace(b"WARC-Date", b"X-Date"), one.replace(b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(op9.ArchiveError):
            op9.parse(fault, "a")
    whole = b"".join(op9.frames([one] * 3, [one]))
    assert len(list(op9.decode(whole, "a"))) == 3 and list(op9.decode(b"", "a")) == []
    for fault in (whole[:-1], whole[:4], whole[20:], whole + b"xx", whole[: len(whole) - 20] + b"\0" * 20):
        with pytest.raises(op9.ArchiveError):
            list(op9.decode(fault, "a"))


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    op9.write(spark.createDataFrame([], PAGES), path)
    assert op9.read(spark, path).count() == 0


def test_a_record_costs_the_same_in_archives_of_any_size():
    r = random.Random(1)
    page = lambda i: op9.record(str(i), "http://x", b"%d" % i + bytes(r.choices(b"abcdefgh <>/", k=3000)), None, 3000 + len(str(i)), "x")
    records = [page(i) for i in range(600)]
    took = {}
    for n in (600, 12_000):
        data = b"".join(op9.frames((records * (n // 600))[:n], records[:50]))
        given = []

        class Counted:
            def __init__(self, inner):
                self.inner = inner

            def decompress(self, part):
                given.append(len(part))
                return self.inner.decompress(part)

            eof = property(lambda self: self.inner.eof)
            unused_data = property(lambda self: self.inner.unused_data)

        import zstandard

        real = zstandard.ZstdDecompressor
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(op9, "parse", lambda one, at: {})
            patch.setattr(zstandard, "ZstdDecompressor", lambda **k: type("D", (), {"decompressobj": lambda self: Counted(real(**k).decompressobj())})())
            assert len(list(op9.decode(data, "a"))) == n
        took[n] = sum(given) / n
    assert took[12_000] <= 1.1 * took[600] <= 4 * op9.SLICE_BYTES


def test_the_text_null_is_an_id(spark, tmp_path):
    rows = [("null", "http://a", "<p>1</p>"), (None, "http://b", "<p>2</p>"), ("", "http://c", "<p>2</p>")]
    op9.write(spark.createDataFrame(rows, "page_id string, url string, html string"), f"file://{tmp_path}/n")
    found = {(x.page_id, x.refers_to): x.record_type for x in op9.read(spark, f"file://{tmp_path}/n").collect()}
    assert found == {("null", None): "response", (None, ""): "revisit", ("", None): "response"}
