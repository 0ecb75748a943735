import random
import warnings

import numpy as np
import pytest

from corvane.llm import op01_embedding_dedup as op1

warnings.filterwarnings("ignore")
SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def rows(n=160, dims=16, seed=0):
    g = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = g.standard_normal(dims)
        if i % 3 and out:
            base = np.array(out[g.integers(len(out))][1], dtype=float)
            v = base if i % 9 == 1 else base + g.standard_normal(dims) * np.abs(base).mean() * g.choice([0.05, 0.2, 0.3, 0.4])
        out.append((i, [float(np.float32(x)) for x in v], int(g.integers(3)), "x"))
    nan, inf = float("nan"), float("inf")
    out += [(500, None, 1, None), (501, [0.0] * dims, 1, None), (502, [nan] + [1.0] * (dims - 1), 1, None), (503, [inf] + [1.0] * (dims - 1), 1, None), (504, [None] + [1.0] * (dims - 1), 1, None), (505, [], 1, None)]
    out += [(506, out[0][1], None, None), (507, out[0][1], None, None), (508, [1.0, 2.0], 1, None), (509, [2.0, 4.0], 1, None), (510, [1e38] * dims, 2, None), (511, [1e-30] * dims, 2, None), (0, out[0][1], out[0][2], None), (None, out[1][1], out[1][2], None)]
    return out


def brute(data, threshold=0.93):
    ok = []
    for i, (_, v, label, _) in enumerate(data):
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float64)
        x = x / np.abs(x).max()
        ok.append((i, label, x / np.sqrt(x @ x)))
    n, parent = [0] * len(data), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, x) in enumerate(ok):
        for j, b, y in ok[:k]:
            if a == b and len(x) == len(y) and x @ y >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    return sorted(((r[0], n[i], least.get(find(i))) for i, r in enumerate(data)), key=str)


@pytest.mark.parametrize("slice_, many", [(8192, 16), (20, 16), (5, 2)])
def test_against_brute_force(spark, monkeypatch, slice_, many):
    monkeypatch.setattr(op1, "SLICE", slice_)
    monkeypatch.setattr(op1, "MANY", many)
    monkeypatch.setattr(op1, "LARGE", 4 * slice_)
    data = rows()
    random.Random(1).shuffle(data)
    found = op1.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == brute(data)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)


def test_pigeonhole_misses_nothing():
    g = np.random.default_rng(3)
    x = g.standard_normal((300, 64))
    x[150:] = x[:150] + g.standard_normal((150, 64)) * 0.38
    side = np.full(300, 2)
    seen = []
    for p, q in op1._range_join(x, side, 0.93, op1.BLOCKS):
        seen += [tuple(sorted(t)) for t in zip(p.tolist(), q.tolist())]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.93}
    assert len(seen) == len(set(seen)) and set(seen) == want and want


def test_empty_table(spark):
    assert op1.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
