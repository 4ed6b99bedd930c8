import random

import numpy as np
import pytest

from siftwell.llm import leaks
from siftwell.llm.leaks import Filter, Walks, edit_distance, leaked_items, words
from siftwell.operators import skew

WORDS = [f"{a}{b}" for a in ["bar", "tun", "lösk", "gam"] for b in ["n", "mel", "ort", "a", "er", "ell"]]


def corpus(seed=1):
    r = random.Random(seed)
    items = [(i, " ".join(r.choices(WORDS, k=r.randrange(4, 40)))) for i in range(40)] + [(98, None), (99, ""), (100, "too short"), (None, "x " * 20)]
    items += [(200, items[0][1])]
    docs = []
    for d in range(150):
        text = r.choices(WORDS, k=r.randrange(0, 120))
        if d % 3 == 0:
            source = items[r.randrange(40)][1].split()
            a = r.randrange(max(1, len(source) - 11))
            part = source[a : a + r.randrange(8, 14)]
            if d % 2:
                part[len(part) // 2] = "changed"
            at = r.randrange(len(text) + 1)
            text[at:at] = part
        joint = r.choice([" ", ", ", "\n", " – ", ". "])
        t = joint.join(text)
        docs.append((d, t.upper() if d % 5 == 0 else t.replace("a", "а") if d % 7 == 0 else t))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[0][1] * 2000)]
    return docs + docs[:5], items


def brute(docs, items, window, edits):
    found = set()
    cut = lambda t: [tuple(w[i : i + window]) for w in [words(t or "")] for i in range(len(w) - window + 1)]
    held = [(i, set(cut(t))) for i, t in items if i is not None]
    for d, t in docs:
        if d is None:
            continue
        mine = set(cut(t))
        for i, theirs in held:
            if mine & theirs:
                found.add((d, i))
            elif edits and mine and theirs:
                number: dict = {}
                code = lambda s: np.array([[number.setdefault(x, len(number) + 1) for x in w] for w in s])  # noqa: E731,B023
                a, b = code(sorted(mine)), code(sorted(theirs))
                if (edit_distance(np.repeat(a, len(b), axis=0), np.tile(b, (len(a), 1))) <= edits).any():
                    found.add((d, i))
    return found


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], "doc_id bigint, text string, item_id int, words string")
    found = leaked_items(d, spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, edits int"), **how).collect()
    assert len(found) == len({r[:2] for r in found})
    return {tuple(r) for r in found}


@pytest.mark.parametrize("bound", [500_000, 0])
def test_whole_windows(spark, monkeypatch, bound):
    monkeypatch.setattr(skew.checked_broadcast_join, "__defaults__", ("inner", bound, None))
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    docs, items = corpus()
    want = brute(docs, items, 10, 0)
    assert len(want) > 10
    assert {r[:2] for r in run(spark, docs, items) if r[2] == 0} == want
    assert {r[:2] for r in run(spark, docs, items, max_edits=0, gaps=0, repetitions=1)} == want


@pytest.mark.parametrize("slots", [1 << 21, 1 << 4])
def test_near_windows(spark, monkeypatch, slots):
    monkeypatch.setattr(leaks, "MOST_SLOTS", slots)  # a filter that is full keeps nothing back
    docs, items = corpus(2)
    want, exact = brute(docs[:-6], items, 10, 1), brute(docs[:-6], items, 10, 0)
    got = run(spark, docs[:-6], items, gaps=0)
    assert {r[:2] for r in got} <= want and exact == {r[:2] for r in got if r[2] == 0} and len(want) > len(exact) + 5
    assert len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("kind", ["left out", "added"])
def test_near_windows_of_other_lengths(spark, kind):
    """Short fragments, eight words on either side of a word left out or added."""
    r = random.Random(4)
    items = [(i, " ".join(f"w{x}" for x in r.choices(range(5000), k=17))) for i in range(150)]
    docs = []
    for i, t in items:
        ws = t.split()
        ws = ws[:8] + ws[9:] if kind == "left out" else [*ws[:8], "new", *ws[8:16]]
        docs.append((i, " ".join([*(f"x{x}" for x in range(6)), *ws, *(f"y{x}" for x in range(6))])))
    got = run(spark, docs, items)
    assert got <= {(i, i, 1) for i, _ in items} and len(got) >= 0.9 * len(items)
    assert run(spark, docs, items, max_edits=0, gaps=0) == set()


def test_filter(spark):
    r = np.random.default_rng(1)
    held, other = (r.integers(-(2**63), 2**63, 5000) for _ in range(2))
    f = Filter.of(spark.createDataFrame([(int(x),) for x in held], "h bigint"))
    assert f.has(held.view(np.uint64)).all() and f.has(other.view(np.uint64)).mean() < 0.01


def test_edit_distance():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [0, 0, 1, 2]])
    b = np.array([[1, 2, 3, 4], [2, 3, 4, 5], [1, 2, 3, 4]])
    assert edit_distance(a, b).tolist() == [0, 2, 4]


def test_edit_distance_of_other_lengths():
    a, b = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [0, 0, 1, 2]]), np.array([[1, 2, 4], [2, 3, 4], [1, 2, 3]])
    assert edit_distance(a, b).tolist() == [1, 1, 3] and edit_distance(b, a)[:2].tolist() == [1, 1]


@pytest.mark.parametrize("window", [10, 30])
def test_walks(window):
    """Equal windows take equal walks whatever their words' numbers; few edits leave some walk alike, other windows none."""
    r = np.random.default_rng(2)
    walks = Walks(window, 1, 16, 10, 11)
    hashes = np.concatenate([np.array([0, 1], np.uint64), r.integers(2, 2**63, 500, dtype=np.uint64)])
    a = r.integers(2, 502, (200, window))
    order = np.concatenate([[0, 1], 2 + r.permutation(500)])
    other = np.empty_like(hashes)
    other[order] = hashes
    assert (walks.keys(a, hashes) == walks.keys(order[a], other)).all()
    b = a.copy()
    b[:, window // 2] = 0
    alike = (walks.keys(a, hashes) == walks.keys(b, hashes)).any(axis=0)
    assert alike.mean() >= 0.9 and (walks.keys(a, hashes) == walks.keys(a[::-1], hashes)).mean() < 0.01


def test_empty(spark):
    docs, items = corpus()
    assert run(spark, [], items) == run(spark, docs, []) == set()
