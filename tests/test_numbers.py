import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell import session
from siftwell.operators import evaluate, linalg, skew

A = np.array([[1.0, 0, 2], [0, 0, 0], [3, -1, 0]])
B = np.array([[0.0, 1, 0], [2, 0, 0], [0, 0, 4]])


def coo(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m) if v], "i int, j int, v double")


def back(df, shape=(3, 3)):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def test_matrices(spark):
    a, b = coo(spark, A), coo(spark, B)
    assert np.allclose(back(linalg.spmm(a, b)), A @ B) and np.allclose(back(linalg.transpose(a)), A.T)
    assert np.allclose(back(linalg.add(a, b)), A + B) and np.allclose(back(linalg.subtract(a, b)), A - B) and np.allclose(back(linalg.scale(a, 3)), 3 * A)
    assert linalg.total(a).first()[0] == A.sum() and math.isclose(linalg.distance(a, b).first()[0], np.linalg.norm(A - B))
    assert np.allclose(back(linalg.normalise_rows(a))[2], A[2] / 4) and np.allclose(back(linalg.normalise_rows(a, "l2"))[0], A[0] / 5**0.5)
    x = spark.createDataFrame([(0, 1.0), (2, 2.0)], "i int, v double")
    assert {r.i: r.v for r in linalg.spmv(a, x).collect()} == {0: 5.0, 2: 3.0}
    assert {r.i: r.v for r in linalg.left_spmv(x, a).collect()} == {0: 7.0, 1: -2.0, 2: 2.0}
    assert math.isclose(sum(r.v**2 for r in linalg.normalise_vector(x).collect()), 1)
    assert {r.v for r in linalg.normalise_vector(x.withColumn("v", F.lit(0.0))).collect()} == {0.0}
    assert linalg.total(a.limit(0)).first()[0] == 0 and linalg.distance(a.limit(0), a.limit(0)).first()[0] == 0
    assert np.allclose(back(linalg.filled(spark, 2, 3, 0.5), (2, 3)), 0.5)


def test_dense(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(linalg.dot(F.col("a"), F.col("b")).alias("d"), linalg.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0].d == 11 and math.isclose(got[0].c, 11 / (5**0.5 * 5)) and got[1].d == 0 and got[1].c is None


def ndcg(grades):
    gain = lambda gs: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(gs))
    return gain(grades) / gain(sorted(grades, reverse=True)) if any(grades) else 0


def test_rankings(spark):
    run = spark.createDataFrame([(1, f"d{i}", 10.0 - i) for i in range(6)] + [(1, "d0", 10.0), (1, "none", None), (2, "d1", 1.0)], "query_id int, doc string, score double")
    judged = spark.createDataFrame([(1, "d0", 1), (1, "d2", 3), (1, "d2", 2), (1, "d5", 2), (1, "d9", 3), (1, "d3", None), (3, "d1", 1)], "query_id int, doc string, grade int")
    ranked = evaluate.ranked_grades(run, judged).cache()
    assert [r.grade for r in ranked.where("query_id = 1").orderBy("rank").collect()] == [1, 0, 3, 0, 0, 2, 0]
    got = {r.query_id: r.ndcg for r in evaluate.ndcg(ranked).collect()}
    assert math.isclose(got[1], ndcg([1, 0, 3, 0, 0, 2, 0])) and got[2] == 0
    assert math.isclose({r.query_id: r.ndcg for r in evaluate.ndcg(ranked, 3).collect()}[1], ndcg([1, 0, 3]))
    at = {(r.query_id, r.k): (r.precision, r.recall) for r in evaluate.precision_recall(ranked, [1, 5], assumed=100).collect()}
    assert at[(1, 1)] == (1.0, 0.01) and at[(1, 5)] == (0.4, 0.02) and at[(2, 5)] == (0, 0)
    assert {(r.query_id, r.k): r.recall for r in evaluate.precision_recall(ranked, [5]).collect()} == {(1, 5): 2 / 3, (2, 5): 0.0}
    of = {r.query_id: (r.judged, r.relevant) for r in evaluate.set_precision(judged).collect()}
    assert of == {1: (4, 4), 3: (1, 1)}
    assert evaluate.ndcg(ranked.limit(0)).count() == 0


def test_checked_broadcast_join(spark):
    big, small = spark.range(100).select((F.col("id") % 10).alias("k"), "id"), spark.createDataFrame([(3, "x"), (3, "y"), (4, "z"), (99, "w")], "k bigint, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, big.join(small, ["k"], how).collect()))
        for bound in (0, 100):
            assert sorted(map(str, skew.checked_broadcast_join(big, small, ["k"], how, bound).collect())) == want


@pytest.mark.parametrize("small", [True, False])
def test_product_join(spark, monkeypatch, small):
    monkeypatch.setattr(skew, "is_small", lambda *_: small)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    r = random.Random(1)
    left = [(r.choice([1, 1, 1, 2, 3, None]), i) for i in range(80)]
    right = [(r.choice([1, 2, 2, 2, 2, 4, None]), i) for i in range(90)]
    got = skew.product_join(spark.createDataFrame(left, "k bigint, a bigint"), spark.createDataFrame(right, "k bigint, b bigint"), "k").collect()
    assert sorted((g.k, g.a, g.b) for g in got) == sorted((k, a, b) for k, a in left for q, b in right if k is not None and k == q)


@pytest.mark.parametrize("block", [1024, 7])
def test_vector_products(spark, monkeypatch, block):
    monkeypatch.setattr(linalg, "BLOCK_VECTORS", block)
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 5))
    x[3] = 0
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(99, None, ""), (None, [1.0] * 5, "")], "vec_id bigint, embedding array<float>, query string")
    for unit in (False, True):
        got = {(g["query"], g.vec_id): g.v for g in linalg.vector_products(df.where("vec_id % 5 = 3"), df, "vec_id", "embedding", unit).collect()}
        assert len(got) == 8 * 40
        for (a, b), v in got.items():
            p, q = np.float32(x[a]).astype(float), np.float32(x[b]).astype(float)
            if unit and 3 in (a, b):
                assert v is None
            else:
                assert abs(v - p @ q / (np.linalg.norm(p) * np.linalg.norm(q) if unit else 1)) < 1e-9
    assert linalg.vector_products(df.limit(0), df, "vec_id", "embedding").count() == 0


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)
