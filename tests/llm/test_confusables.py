import itertools

import pytest

from siftwell.llm import confusables as c
from siftwell.operators import skew

ROWS = [
    (1, "Åre café fin 12"), (2, "Åre café ﬁn 12"), (3, "Åre café　fin １２"), (4, "Åre cаfé fi​n 12"),  # Cyrillic а
    (5, "Are cafe fin 12"), (6, "ÅRE CAFÉ FIN 12"), (7, "m²"), (8, "m2"), (9, "Man-kan"), (10, "Man kan"), (11, None), (12, ""), (13, "​﻿"),
    (14, "Старый мост"), (15, "Cтарый мост"), (16, "Старыи мост"), (17, "Åre café fin 12"), (18, "x" * 60_000), (19, "x" * 60_000 + "­"), (20, "ёж"), (21, "ëж"), (22, "ёж"),
    (23, "ΒΑΝΑ"), (24, "BANA"), (25, "ВАNА"), (26, "0"), (27, "O"), (28, "l"), (29, "I"), (30, "!"), (31, "！"), (32, ""),
    (33, "зелёный"), (34, "зелёныи\u200b\u0306"), (35, "зелёныи\u00ad\u0306"), (36, "зелены\u0439"), (37, "☺"), (38, "☺\ufe0f"), (39, "a\x01b"), (40, "ab"), (41, "Ⅳ x"), (42, "IV x"),
    (43, "\u0643\u062a"), (44, "\u0643\u0640\u062a"), (45, "ᎠᎢ"), (46, "DT"), (47, "𝐀"), (48, "A"),
]
SHAPE = "line_id bigint, text string"
SAME = [{1, 2, 3, 4, 17}, {12, 13, 32}, {14, 15}, {18, 19}, {20, 21, 22}, {23, 24, 25}, {30, 31}, {33, 34, 35}, {37, 38}, {39, 40}, {41, 42}, {45, 46}]


def brute():
    text = dict(ROWS)
    pairs = {(a, b) for s in SAME for a, b in itertools.combinations(sorted(s), 2)}
    return sorted((a, b) for a, b in pairs if text[a] != text[b])


def test_pairs(spark):
    df = spark.createDataFrame(ROWS + ROWS[:3], SHAPE)
    assert sorted(map(tuple, c.look_alike_pairs(df, "line_id", "text").collect())) == brute()


def test_python_form_gives_the_same_classes():
    by = {}
    for i, t in ROWS:
        if t is not None:
            by.setdefault(c.skeleton(t), set()).add(i)
    assert sorted(map(sorted, (s for s in by.values() if len(s) > 1))) == sorted(map(sorted, SAME))


def test_canonical(spark):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in ROWS], SHAPE + ", canonical string, n int")
    got = {r.line_id: r.canonical for r in c.unify(df, ["line_id"], "text").collect()}
    text = dict(ROWS)
    assert len(got) == len(ROWS) and got[11] is None
    for s in SAME:
        assert len({got[i] for i in s}) == 1 and got[min(s)] in {text[i] for i in s}
    assert got[2] == "Åre café fin 12" and got[15] == "Старый мост" and got[21] == "ёж" and got[23] == "BANA" and got[31] == "!" and got[13] == ""
    assert all(got[i] == text[i] for i, _ in ROWS if i not in set().union(*SAME))


def test_fold():
    assert c.fold("ВАNА café") == c.fold("bana CAFÉ") == "bana café"
    assert c.fold("В ГОРОДЕ") == c.fold("в городе")


@pytest.mark.parametrize("bound", [500_000, 0])
def test_classes_and_links(spark, monkeypatch, bound):
    """A class of many rows of few spellings, by class and number of links and by pairs."""
    monkeypatch.setattr(skew.checked_broadcast_join, "__defaults__", ("inner", bound, None))
    monkeypatch.setattr(c, "CHANGES", bound)
    monkeypatch.setattr(skew, "HOT_ROWS", 30)
    rows = ROWS + [(1000 + i, "Åre café fin 12") for i in range(300)]
    text, df = dict(rows), spark.createDataFrame(rows, SHAPE)
    same = [SAME[0] | {1000 + i for i in range(300)}, *SAME[1:]]
    got = c.look_alike_links(df, "line_id", "text").collect()
    assert {r.line_id: r.links for r in got} == {i: n for s in same for i in s if (n := sum(text[j] != text[i] for j in s))}
    assert all(len({r.class_id for r in got if r.line_id in s}) == 1 for s in same) and len({r.class_id for r in got}) == len(same)
    pairs = c.look_alike_pairs(df, "line_id", "text").collect()
    assert len(pairs) == len(set(pairs)) == sum(r.links for r in got) // 2


def test_empty(spark):
    none = spark.createDataFrame([], SHAPE)
    assert c.look_alike_links(none, "line_id", "text").count() == 0
    assert c.look_alike_pairs(none, "line_id", "text").count() == c.unify(none, ["line_id"], "text").count() == 0
