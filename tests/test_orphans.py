from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.operators import orphans, skew
from siftwell.operators.orphans import Parents, References, numbered, orphan_references, orphan_report, parent_runs

DAY = lambda m, d=1: datetime(2020, m, d)
PARENT = "key string, a timestamp_ntz, z timestamp_ntz, bucket int"
CHILD = "id bigint, key string, t timestamp_ntz, k string, dom string"


def run(spark, child, parent):
    refs = [References("child", spark.createDataFrame(child, CHILD), "id", "key", "t", "p")]
    rows = orphan_references(refs, [Parents("p", spark.createDataFrame(parent, PARENT), "key", "a", "z")]).collect()
    return sorted((r.period, r.row_id) for r in rows), refs


def brute(child, parent):
    norm = lambda k: str(int(k)) if k.strip().isdigit() else k
    out = set()
    for i, k, t, *_ in child:
        if k is None:
            continue
        lives = [(a, z) for p, a, z, _ in parent if p is not None and norm(p) == norm(k)]
        if not any(t is None or ((a is None or a <= t) and (z is None or z > t)) for a, z in lives):
            out.add((t.strftime("%Y-%m") if t else "unknown", i))
    return sorted(out)


PARENTS = [
    ("4", None, None, 1), ("5", None, None, 1), ("6", None, None, 2), (" 007", None, DAY(3), 1), ("7", DAY(5), None, 1), ("7", DAY(5), None, 1),
    ("9", DAY(2), DAY(2), 0), ("a/b", None, None, 0), ("", DAY(1), None, 0), (None, None, None, 0), ("4095", None, None, 0), ("4096", None, None, 0), ("x" * 5000, None, None, 0),
]
CHILDREN = [
    (i, k, t, "clash", "clash")
    for i, (k, t) in enumerate(
        (k, t)
        for k in ["4", "0005 ", "\t5\n", "6", "7", "8", "9", "a/b", "a/c", "", " ", None, "4095", "4096", "4097", "x" * 5000, "-4", "99999999999999999999999"]
        for t in [None, DAY(1), DAY(2), DAY(3), DAY(4), DAY(5), DAY(6)]
    )
]


@pytest.mark.parametrize("hot", [500_000, 5])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(orphans, "HOT_ROWS", hot)
    got, refs = run(spark, CHILDREN + CHILDREN[:20], PARENTS)
    assert got == brute(CHILDREN, PARENTS)


def test_always_there_keys_are_one_run(spark):
    p = Parents("p", spark.createDataFrame([(str(k), None, None, 0) for k in range(100, 200)], PARENT), "key", "a", "z")
    assert parent_runs([p]).where("dom = 'p@'").count() == 1


def test_empty_tables(spark):
    assert run(spark, [], PARENTS)[0] == []
    assert run(spark, [(1, "5", None, "", "")], [])[0] == [("unknown", 1)]
    assert run(spark, [], [])[0] == []


def test_report(spark):
    refs = [References("child", spark.createDataFrame(CHILDREN, CHILD), "id", "key", "t", "p")]
    found = orphan_references(refs, [Parents("p", spark.createDataFrame(PARENTS, PARENT), "key", "a", "z")])
    rows = orphan_report(found, refs).collect()
    assert sum(r.n_orphans for r in rows) == len(brute(CHILDREN, PARENTS))
    assert sum(r.n_refs for r in rows) == sum(c[1] is not None for c in CHILDREN)
    assert found.where(F.col("period") == "unknown").count() == next(r.n_orphans for r in rows if r.period == "unknown")


@pytest.mark.parametrize("bound", [500_000, 0])
def test_numbered_text_keys(spark, monkeypatch, bound):
    """Text keys as they are spelt: digits and blanks too. Keys that are there at some time are one run."""
    monkeypatch.setattr(orphans, "NAMES", bound)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    names = ["Ås", "ås", "12", "0012", "", " x", "x", "n" * 5000]
    parents = [(n, None if i % 2 else DAY(2), None if i % 3 else DAY(5), 0) for i, n in enumerate(names)] + [("Ås", DAY(6), None, 0), (None, None, None, 0)]
    children = [(i, k, t, "", "") for i, (k, t) in enumerate((k, t) for k in [*names, "missing", "?12", "1", None] for t in (None, DAY(1), DAY(3), DAY(5), DAY(7)))]
    children += [(1000 + i, "ås", DAY(7), "", "") for i in range(100)]
    refs, lives = numbered(References("child", spark.createDataFrame(children, CHILD), "id", "key", "t", "p"), Parents("p", spark.createDataFrame(parents, PARENT), "key", "a", "z"))
    got = sorted((r.period, r.row_id) for r in orphan_references([refs], [lives]).collect())
    want = set()
    for i, k, t, *_ in children:
        held = [(a, z) for p, a, z, _ in parents if p == k]
        if k is not None and not any(t is None or ((a is None or a <= t) and (z is None or z > t)) for a, z in held):
            want.add((t.strftime("%Y-%m") if t else "unknown", i))
    assert got == sorted(want)
    assert parent_runs([lives]).where("dom = 'p#'").count() == 1
    none = spark.createDataFrame([], PARENT)
    assert orphan_references(*([x] for x in numbered(References("child", spark.createDataFrame(children[:5], CHILD), "id", "key", "t", "p"), Parents("p", none, "key", "a", "z")))).count() == 5
