import math
import random

import pytest

from siftwell.llm import terms
from siftwell.operators import skew

POST = "token_id int, doc_id bigint, tf int, token string"


def tables(spark, seed=0):
    r = random.Random(seed)
    names = [(f"t{i}", i) for i in range(40)] + [("t1", 101), ("t1", 1), (None, 77), ("t3", None), ("", 50)]
    docs = [(d, f"n{d}", 1) for d in range(0, 400, 3)] + [(None, "x", 1), (0, "n0", 1)]
    rows = [(i, d * 3, r.randrange(1, 9), "clash") for i in range(45) for d in range(200) if r.random() < (0.9 if i == 5 else 1 / (i + 1))]
    rows += [(101, 3, 4, "clash"), (None, 3, 1, ""), (2, None, 1, ""), (2, 6, None, ""), (39, 9, 5, ""), (77, 9, 5, "")]
    rows += r.sample(rows, 50)
    make = lambda x, s: spark.createDataFrame(x, s)
    want: dict = {}
    for i, d, tf in {x[:3] for x in rows}:
        token = next((t for t, n in names if n == i and t is not None and i is not None), None)
        if token is not None and d is not None and d in {x[0] for x in docs}:
            want[(token, d)] = want.get((token, d), 0) + (tf or 0)
    return make(rows, POST), make(names, "token string, token_id int"), make(docs, "doc_id bigint, name string, length int"), want


@pytest.mark.parametrize("bound", [500_000, 0])
def test_valid_postings(spark, monkeypatch, bound):
    monkeypatch.setattr(skew.checked_broadcast_join, "__defaults__", ("inner", bound, None))
    *t, want = tables(spark)
    assert {(r.token, r.doc_id): r.tf for r in terms.valid_postings(*t).collect()} == want


def members(h):
    """The record ids of a container in any form."""
    held = list(h.offsets or []) + [x for r in h.runs or [] for x in range(r["first"], r["last"] + 1)] + [w * 64 + b for w, word in enumerate(h.words or []) for b in range(64) if word >> b & 1]
    assert (h.offsets is None) + (h.runs is None) + (h.words is None) == 2 and {"array": h.offsets, "run": h.runs, "bitmap": h.words}[h.kind] is not None
    assert len(held) == len(set(held)) == h.records
    return {h.container * terms.CONTAINER + x for x in held}


def test_frequencies(spark):
    *t, want = tables(spark)
    rows = terms.valid_rows(*t)
    containers = terms.term_containers(rows).cache()
    n = len({d for _, d in want})
    assert terms.record_count(rows).first().total == n
    got = {r.term: r for r in terms.term_frequencies(containers, terms.record_count(rows)).collect()}
    assert got.keys() == {k for k, _ in want}
    for k, r in got.items():
        mine = [v for (x, _), v in want.items() if x == k]
        assert (r.occurrences, r.records) == (sum(mine), len(mine))
        assert r.mark == ("rare" if len(mine) == 1 else "common" if len(mine) > 0.6 * n else "useful")
    assert {(h.term, d) for h in containers.collect() for d in members(h)} == set(want)


def test_containers_of_any_form_and_id(spark):
    r = random.Random(5)
    ids = {"few": [-65, -64, -1, 0, 63, 64, 2**40], "dense": sorted(r.sample(range(4096, 8192), 2500)), "all": list(range(3000, 9000)), "none": []}
    df = spark.createDataFrame([(t, i, 2) for t, x in ids.items() for i in x] + [("few", None, 1), (None, 1, 1), ("few", 0, None)], "token string, doc_id bigint, tf int")
    got = terms.term_containers(df.repartition(5)).collect()
    assert {t: sorted(d for h in got if h.term == t for d in members(h)) for t in ids} == ids
    assert {(h.term, h.kind) for h in got} == {("few", "array"), ("dense", "bitmap"), ("all", "run")}
    assert sum(h.occurrences for h in got) == 2 * sum(map(len, ids.values()))


def test_distinctiveness(spark):
    *t, want = tables(spark)
    want = {k: v for k, v in want.items() if v}
    n = len({d for _, d in want})
    asked = spark.createDataFrame([(3,), (3,), (9,), (None,), (10**9,)], "doc_id bigint")
    got = terms.distinctiveness(terms.valid_postings(*t), asked).collect()
    assert {(r.term, r.record) for r in got} == {k for k in want if k[1] in (3, 9)}
    for r in got:
        mine = [v for (x, _), v in want.items() if x == r.term]
        ridf = math.log2(n / len(mine)) + math.log2(1 - math.exp(-sum(mine) / n))
        residual = max(0.0, n / len(mine) - 1 / (1 - math.exp(-sum(mine) / n)))
        assert (r.df, r.cf) == (len(mine), sum(mine)) and abs(r.ridf - ridf) < 1e-9
        assert abs(r.residual - residual) < 1e-9 and abs(r.score - r.tf * residual) < 1e-9
    best = {r.record: r.term for r in terms.most_distinctive(terms.distinctiveness(terms.valid_postings(*t), asked)).collect()}
    assert best == {d: min((r for r in got if r.record == d), key=lambda r: (-r.score, r.term)).term for d in (3, 9)}


def test_empty(spark):
    p, n, d, _ = tables(spark)
    none = terms.valid_postings(p.limit(0), n, d)
    assert none.count() == terms.term_frequencies(terms.term_containers(none), terms.record_count(none)).count() == terms.distinctiveness(none).count() == 0
    assert terms.valid_postings(p, n.limit(0), d).count() == 0


def test_several_languages(spark):
    """A name in few records beats a common word of the record's language, however often that stands in it."""
    rows = [(d, w, 30) for d in range(100) for w in (["the", "of"] if d < 40 else ["det", "och"])] + [(3, "thoville", 8), (50, "thoville", 1), (7, "once", 1)]
    df = spark.createDataFrame([(w, d, tf) for d, w, tf in rows], "token string, doc_id bigint, tf int")
    best = {r.record: r.term for r in terms.most_distinctive(terms.distinctiveness(df)).collect()}
    assert best[3] == "thoville" and best[7] == "of"


def test_concentrated_terms(spark):
    """Of two terms in as many records and as often in this one, that which comes in bursts is the more distinctive."""
    rows = [(d, "filler", 1) for d in range(200)] + [(d, "even", 3 if d == 0 else 1) for d in range(20)] + [(d, "bursty", 3 if d == 0 else 30) for d in range(20)]
    df = spark.createDataFrame([(w, d, tf) for d, w, tf in rows], "token string, doc_id bigint, tf int")
    got = {r.term: r for r in terms.distinctiveness(df).where("record = 0").collect()}
    assert (got["even"].df, got["even"].tf) == (got["bursty"].df, got["bursty"].tf)
    assert got["bursty"].score > 2 * got["even"].score and got["bursty"].ridf > got["even"].ridf and got["filler"].score == 0
    assert [r.term for r in terms.most_distinctive(terms.distinctiveness(df)).where("record = 0").collect()] == ["bursty"]
