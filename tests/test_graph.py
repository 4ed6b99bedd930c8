import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import graph, walks
from siftwell.plans import graph_queries

LINKS = [(1, 2), (2, 1), (1, 3), (3, 3), (4, 1), (2, 5), (1, 2), (6, 7), (7, 5), (8, 1), (9, 1), (None, 1), (1, None)]


def dense(links, steps, bored=0.15):
    ids = sorted({x for e in links for x in e})
    n, at = len(ids), {x: i for i, x in enumerate(ids)}
    p = np.zeros((n, n))
    for a, b in set(links):
        p[at[a], at[b]] = 1
    out = p.sum(axis=1, keepdims=True)
    p = np.where(out > 0, p / np.maximum(out, 1), 1 / n)
    g = (1 - bored) * p + bored / n
    r = np.zeros(n)
    r[0] = 1
    for _ in range(steps):
        r = r @ g
    return dict(zip(ids, r, strict=True))


@pytest.fixture(scope="module")
def edges(spark):
    return graph.clean_edges(spark.createDataFrame(LINKS, "src bigint, dst bigint"), F.col("src"), F.col("dst"))


CLEAN = [e for e in LINKS if None not in e]


@pytest.mark.parametrize("hot", [100_000, 1])
def test_pagerank(edges, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT_LINKS", hot)
    monkeypatch.setattr(graph, "shuffle_width", lambda _: 8)  # few links are hot already
    for steps in (1, 7):
        got = {r.node: r["rank"] for r in graph.pagerank(edges, iterations=steps).collect()}
        want = dense(CLEAN, steps)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    done = {r.node: r["rank"] for r in graph.pagerank(edges, iterations=200, tolerance=1e-6).collect()}
    want = dense(CLEAN, 300)
    assert abs(sum(done.values()) - 1) < 1e-9 and all(abs(done[k] - want[k]) < 1e-5 for k in want)


def test_nodes_without_links(spark, edges):
    alone = spark.createDataFrame([(50,), (1,), (None,), (51,)], "node bigint")
    got = {r.node: r["rank"] for r in graph.pagerank(edges, iterations=300, tolerance=1e-5, vertices=alone).collect()}
    assert len(got) == 11 and abs(sum(got.values()) - 1) < 1e-9 and got[50] == got[51] > 0
    walked = {r.node: r["rank"] for r in walks.monte_carlo(edges, 20_000, 2, vertices=alone).collect()}
    assert walked.keys() == got.keys() and max(abs(walked[k] - got[k]) for k in got) < 0.02


def test_hot_links_are_spread(edges, monkeypatch):
    monkeypatch.setattr(graph, "HOT_LINKS", 1)
    monkeypatch.setattr(graph, "shuffle_width", lambda _: 8)
    placed = graph.PlacedLinks.by(edges, "src")
    assert {r.node: r.salts for r in placed.hot.collect()} == {1: 2, 2: 2}
    got = placed.carry(graph.out_degree(edges).withColumnRenamed("out", "v"), "v").collect()
    assert sorted(map(tuple, got)) == sorted((b, {1: 2, 2: 2}.get(a, 1)) for a, b in set(CLEAN))


def test_degrees(edges):
    assert {r.node: r.out for r in graph.out_degree(edges).collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 0, 6: 1, 7: 1, 8: 1, 9: 1}


@pytest.mark.parametrize("hot", [100_000, 1])
def test_base_set_and_hits(spark, edges, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT_LINKS", hot)
    monkeypatch.setattr(graph, "shuffle_width", lambda _: 8)
    base = graph.base_set(edges, spark.createDataFrame([(2,)], "node bigint"))
    assert sorted(r.node for r in base.collect()) == [1, 2, 5]
    ids = [1, 2, 5]
    links = sorted(set(CLEAN))
    h = {i: sum(a == i for a, _ in links) for i in ids}
    a = {i: sum(b == i for _, b in links) for i in ids}
    for step in range(5):
        if step:
            h, a = {i: sum(a0.get(y, 0) for x, y in links if x == i) for i in ids}, {i: sum(h0.get(x, 0) for x, y in links if y == i) for i in ids}
        nh, na = sum(v * v for v in h.values()) ** 0.5, sum(v * v for v in a.values()) ** 0.5
        h0, a0 = {i: v / nh for i, v in h.items()}, {i: v / na for i, v in a.items()}
        h, a = h0, a0
    got = graph.hits(edges, base).collect()
    assert all(abs(r.hub - h0[r.node]) < 1e-12 and abs(r.authority - a0[r.node]) < 1e-12 for r in got)
    whole = graph.hits(edges, iterations=100, tolerance=0.05).collect()
    assert abs(sum(r.hub**2 for r in whole) - 1) < 1e-9


def test_hits_converged(spark, monkeypatch):
    links = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (4, 1), (5, 4)]
    monkeypatch.setattr(graph_queries, "edges", lambda *_: spark.createDataFrame(links, "src bigint, dst bigint"))
    a = np.zeros((5, 5))
    for x, y in links:
        a[x - 1, y - 1] = 1
    unit = lambda v: v / np.linalg.norm(v)
    h = t = np.ones(5)
    found = []
    for _ in range(200):
        h, t = unit(a @ t), unit(a.T @ h)
        found.append(np.stack([h, t]))
    got = graph_queries.QUERIES["graph_hits"](spark, "").orderBy("node").collect()
    got = np.array([[r.hub for r in got], [r.authority for r in got]])
    assert abs(found[4] - found[-1]).max() > 1e-3 and abs(got - found[-1]).max() < 1e-4


def test_hits_ranking(spark, edges):
    titles = spark.createDataFrame([(1, "a"), (2, "b"), (5, "e"), (5, "e2"), (9, "x")], "node bigint, title string")
    docs = spark.createDataFrame([(10, "a"), (20, "b"), (50, "e2"), (70, "nowhere")], "doc_id bigint, title string")
    rows = spark.createDataFrame([(20,), (70,)], "doc_id bigint")
    got = {r.doc_id: r.score for r in graph.hits_ranking(edges, titles, docs, rows).collect()}
    assert got.keys() == {10, 20, 50} and all(0 <= v <= 1 for v in got.values())


@pytest.mark.parametrize("method", [1, 2, 4, 5])
def test_walks(spark, edges, method):
    got = {r.node: r["rank"] for r in walks.monte_carlo(edges, 60_000, method).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    want = dense(CLEAN, 300, 0.15)
    # ends of walks that go on from dangling nodes are the ranks themselves, whole paths are near them
    assert max(abs(got[k] - want[k]) for k in want) < (0.05 if method in (4, 5) else 0.01)


@pytest.mark.parametrize("method", [1, 4])
def test_walks_are_the_same_either_way(spark, edges, monkeypatch, method):
    """Whole walks in tasks, or step by step; several numbers of walks at once, or one."""
    monkeypatch.setattr(walks, "LOCAL_WALKS", 100)
    monkeypatch.setattr(walks, "MERGED", 3)
    lone = spark.createDataFrame([(77,), (1,)], "node bigint")
    a, b = (walks.walk_series(edges, [20, 333], method, 0.6, local_links=x, vertices=lone).collect() for x in (1000, 0))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 2 * 10
    for n in (20, 333):
        one = walks.monte_carlo(edges, n, method, 0.6, vertices=lone).collect()
        assert {r.node: r["rank"] for r in one} == {r.node: r["rank"] for r in a if r.walks == n}


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("method", [2, 5])
def test_walks_on_links_in_order(spark, edges, monkeypatch, method, kind):
    """Beyond RAW_LINKS the workers read links that Spark numbered and sorted; they don't go step by step before LOCAL_LINKS."""
    links = edges.select(*(F.col(c).cast(kind) for c in ("src", "dst")))
    lone = spark.createDataFrame([("77",), ("10",)], "node string")
    want = walks.walk_series(links, [20, 333], method, 0.3, vertices=lone).collect()
    monkeypatch.setattr(walks, "RAW_LINKS", 3)
    monkeypatch.setattr(walks, "LOCAL_WALKS", 50)
    monkeypatch.setattr(walks, "_walk_steps", None)
    assert walks.Laid.of(links, lone).way == "placed"
    got = walks.walk_series(links, [20, 333], method, 0.3, vertices=lone).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2 * 11


def test_draws(spark):
    ids = [0, 1, 7, 2**40, 2**62]
    rows = spark.createDataFrame([(i,) for i in ids], "w bigint").select(F.col("w"), walks._uniform(3, 5, F.col("w")).alias("u")).collect()
    assert {r.w: r.u for r in rows} == dict(zip(ids, walks.uniform(3, 5, np.array(ids)).tolist(), strict=True))


def test_sweep(spark, edges):
    reference = graph.pagerank(edges, iterations=20)
    for method, numbers in ((2, [x for x in walks.sweep(9) if x >= 9]), (5, walks.sweep(9))):
        got = {r.walks: r.goodness for r in walks.sweep_goodness(reference, edges, method).collect()}
        assert sorted(got) == sorted(set(numbers)) and all(v >= 0 for v in got.values()) and got[1000] < 0.05


@pytest.mark.parametrize("local", [1000, 0])
def test_sweep_counts_what_is_compared(spark, edges, monkeypatch, local):
    """Visits of the best nodes alone are told apart, by one pass for the methods that begin alike; the goodness is that of whole ranks."""
    reference = graph.pagerank(edges, iterations=20)
    want = {r.node: r["rank"] for r in graph.top(reference, "rank", 3).collect()}
    passes, seen = [], walks.Laid.seen
    monkeypatch.setattr(walks.Laid, "seen", lambda *a: passes.append(seen(*a).count()) or seen(*a))
    laid = walks.Laid.of(edges, local_links=local)
    found = walks.goodness_series(reference, laid, [1, 5], lambda n: [20, 333], 3, bored=0.6).collect()
    assert len(found) == 4 and len(passes) == 1 and passes[0] <= 2 * 2 * 4
    for m in (1, 5):
        whole = walks.walk_series(edges, [20, 333], m, 0.6).collect()
        for x in (20, 333):
            apart = sum((want[r.node] - r["rank"]) ** 2 for r in whole if r.walks == x and r.node in want)
            assert abs(apart - next(r.goodness for r in found if (r.method, r.walks) == (m, x))) < 1e-12


def test_near_takes_two_passes(edges, monkeypatch):
    """The four methods' walks are taken in two passes over one graph that is laid out once."""
    took, walk, lay = [], walks._walk_local, walks.Laid.of
    monkeypatch.setattr(walks, "_walk_local", lambda *a: took.append("pass") or walk(*a))
    monkeypatch.setattr(walks.Laid, "of", lambda *a: took.append("laid") or lay(*a))
    monkeypatch.setattr(graph_queries, "edges", lambda *_: edges)
    monkeypatch.setattr(graph_queries, "WALKS", 60_000)
    monkeypatch.setattr(graph_queries, "WALKS_APART", 0.01)
    got = graph_queries.QUERIES["graph_walks_near"](None, "").collect()
    assert sorted(map(tuple, got)) == [(m, 9, 1.0, True) for m in (1, 2, 4, 5)] and sorted(took) == ["laid", "pass", "pass"]


def test_local_walks_repeat(spark, edges):
    a, b = (sorted(map(tuple, walks.monte_carlo(edges, 5000, 5, seed=3).collect())) for _ in range(2))
    assert a == b


def test_walks_grow_with_the_graph(spark, edges, monkeypatch):
    assert [walks.enough(n, 1_000_000, 20) for n in (0, 3, 45_085, 5_000_000)] == [0, 1_000_002, 1_036_955, 100_000_000]
    for method in (2, 4):
        for local in (1000, 0):
            with pytest.raises(ValueError, match="9 nodes"):
                walks.monte_carlo(edges, 8, method, local_links=local)
    monkeypatch.setattr(graph_queries, "WALKS", 5)  # fewer than nodes
    monkeypatch.setattr(graph_queries, "edges", lambda *_: edges)
    for method in (2, 4):
        ranks = [r["rank"] for r in graph_queries.QUERIES[f"graph_mc{method}"](spark, "").collect()]
        assert len(ranks) == 9 and abs(sum(ranks) - 1) < 1e-9


def test_goodness(spark):
    ref = spark.createDataFrame([(i, i / 10) for i in range(5)], "node bigint, rank double")
    est = spark.createDataFrame([(4, 0.5), (3, 0.3), (0, 9.0)], "node bigint, rank double")
    assert abs(graph.goodness(ref, est, 3).first()[0] - (0.1**2 + 0 + 0.2**2)) < 1e-12


def test_empty(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert graph.pagerank(none).count() == graph.hits(none).count() == walks.monte_carlo(none, 10, 4).count() == 0
