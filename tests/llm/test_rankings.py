import random
from math import comb

import pytest
from pyspark.sql import functions as F

from siftwell.llm import rankings

SHAPE = "q int, d bigint, a double, b double, c double, size int"
NAMES = ["a", "b", "c"]


def brute(rows):
    best = {}
    for q, d, *s, _ in rows:
        if q is not None and d is not None:
            s = [None if x is None or x != x else x for x in s]
            old = best.setdefault((q, d), [None] * 3)
            best[(q, d)] = [x if y is None else y if x is None else max(x, y) for x, y in zip(old, s, strict=True)]
    out = {}
    for (q, d), s in best.items():
        mine = [v for (g, _), v in best.items() if g == q]
        places = []
        for i in range(3):
            if s[i] is None:
                places.append(1.0)
                continue
            above, ties = sum(v[i] is not None and v[i] > s[i] for v in mine), sum(v[i] == s[i] for v in mine)
            places.append((above + (ties + 1) / 2) / len(mine))
        x = sorted(places)
        tail = lambda k: sum(comb(3, j) * x[k - 1] ** j * (1 - x[k - 1]) ** (3 - j) for j in range(k, 4))
        out[(q, d)] = (min(1.0, 3 * min(tail(k) for k in (1, 2, 3))), sum(places) / 3)
    return out


def rows(seed=2, n=300):
    r = random.Random(seed)
    value = lambda: r.choice([None, 0.0, -5.0, 1e300, float("nan"), r.random(), r.gauss(0, 1e6), 3.0, 3.0])
    out = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(400)]), value(), value(), value(), 7) for _ in range(n)]
    return out + out[:40] + [(9, 1, None, None, None, 0), (9, 2, None, None, None, 0)]


@pytest.mark.parametrize("hot", [200_000, 20])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(rankings, "HOT_ROWS", hot)
    data = rows()
    got = {(r.group, r.item): (r.rho, r.mean_place) for r in rankings.aggregate_rankings(spark.createDataFrame(data, SHAPE), "q", "d", NAMES).collect()}
    want = brute(data)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_scale_does_not_matter(spark):
    r = random.Random(3)
    data = [(1, i, r.random(), r.random(), r.random(), 0) for i in range(50)]
    one = rankings.best_of_each(rankings.aggregate_rankings(spark.createDataFrame(data, SHAPE), "q", "d", NAMES), 10)
    two = rankings.best_of_each(rankings.aggregate_rankings(spark.createDataFrame(data, SHAPE).withColumn("a", F.exp(F.col("a") * 90)), "q", "d", NAMES), 10)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    order = sorted(one.collect(), key=lambda x: x.position)
    assert [x.position for x in order] == list(range(1, 11)) and [x.rho for x in order] == sorted(x.rho for x in order)


def test_empty(spark):
    assert rankings.aggregate_rankings(spark.createDataFrame([], SHAPE), "q", "d", NAMES).count() == 0
