import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import hotkeys, skew
from siftwell.operators.hotkeys import exact_quantiles, links_by_source

SHAPE = "edge bigint, src string, dst string, n int"


def edges(seed=0, n=4000):
    r = random.Random(seed)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", None, "d", ""]), str(int(r.paretovariate(0.6)) % 100_000), i) for i in range(n)]
    rows += [(n + i, "a", None, 0) for i in range(3)] + [(n + 9, "lonely", None, 0)]
    return rows + rows[:500]


@pytest.mark.parametrize("block", [100_000, 40, 3])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(hotkeys.ranked_pairs, "__defaults__", (block,))
    monkeypatch.setattr(hotkeys, "BINS", 8)
    rows = edges()
    df = spark.createDataFrame(rows, SHAPE)
    got = links_by_source(df, "edge", F.col("src"), F.col("dst").cast("bigint"), capacity=7).collect()
    for src in {r[1] for r in rows if r[1] is not None}:
        mine = sorted((g.piece, g.link, g.out) for g in got if g.src == src)
        targets = sorted({int(r[2]) for r in rows if r[1] == src and r[2] is not None})
        out = len({r[0] for r in rows if r[1] == src})
        assert [x for m in mine for x in m[1]] == targets
        assert all(len(m[1]) == 7 for m in mine[:-1]) and [m[0] for m in mine] == list(range(len(mine)))
        assert all(m[2] == out for m in mine)
    assert all(g.src is not None for g in got)


@pytest.mark.parametrize("bound", [500_000, 0])
@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_quantiles(spark, monkeypatch, bound, kind):
    monkeypatch.setattr(skew.checked_broadcast_join, "__defaults__", ("inner", bound, None))
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    r = random.Random(1)
    rows = [(r.choice("aaaaab"), v) for v in [r.randrange(-(2**62), 2**62) for _ in range(300)] + [5] * 400 + [2**62 - i for i in range(30)]]
    rows = [(k, v if kind == "bigint" else v / 7) for k, v in rows] + [("a", None), (None, None), ("c", rows[0][1] if kind == "bigint" else 0.5)]
    rows += [("a", float(x)) for x in ("inf", "-inf", "inf")] if kind == "double" else []
    df = spark.createDataFrame(rows, f"src string, value {kind}")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(g.key, g.prob): g.value for g in exact_quantiles(df, "src", "value", probs).collect()}
    for k in "abc":
        v = sorted(x for s, x in rows if s == k and x is not None)
        for p in probs:
            assert got[(k, p)] == v[max(1, -int(-p * len(v) // 1)) - 1]
    assert len(got) == 15


def test_quantiles_leave_nan_out(spark):
    df = spark.createDataFrame([("a", x) for x in [1.0, float("nan"), 2.0, float("nan"), 0.5]], "k string, v double")
    assert {g.prob: g.value for g in exact_quantiles(df, "k", "v", [0.3, 0.6, 1.0]).collect()} == {0.3: 0.5, 0.6: 1.0, 1.0: 2.0}
    found = hotkeys.exact_selection(df.select(F.col("k").alias("key"), F.col("v").alias("value")), lambda n: F.sequence(F.lit(1).cast("bigint"), n))
    assert [repr(r.value) for r in found.orderBy("rank").collect()] == ["0.5", "1.0", "2.0", "nan", "nan"]


@pytest.mark.parametrize("least", [1, 3, 17, 200, 10_000])
def test_heavy_values(spark, least):
    r = random.Random(3)
    values = [int(r.paretovariate(0.7)) for _ in range(1500)] + [10**12] * 17 + [-4] * 3 + [None] * 400
    df = spark.createDataFrame([(v,) for v in values], "value bigint")
    want = {v: values.count(v) for v in set(values) if v is not None and values.count(v) >= least}
    assert {g.value: g.n for g in hotkeys.heavy_values(df, least).collect()} == want


def test_heavy_sources(spark):
    rows = [(i, 1 if i < 60 else i, "x") for i in range(150)] * 2 + [(i, None, "y") for i in range(150, 200)] + [(None, 7, "z")] * 500
    df = spark.createDataFrame(rows, "id bigint, s bigint, value string")
    assert [tuple(x) for x in hotkeys.heavy_sources(df, "id", F.col("s"), 0.3).collect()] == [(1, 60)]  # 60 of 200
    assert hotkeys.heavy_sources(df, "id", F.col("s"), 0.301).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], SHAPE)
    assert links_by_source(df, "edge", F.col("src"), F.col("dst").cast("bigint")).count() == 0
    assert exact_quantiles(df.withColumn("v", F.lit(1)), "src", "v", [0.5]).count() == 0
    assert hotkeys.heavy_sources(df, "edge", F.col("src").cast("bigint"), 0.01).count() == 0
