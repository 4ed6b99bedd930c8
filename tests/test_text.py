import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.index import token_table

TEXTS = [None, "", "Ünïcode Œuvre, don't!", "a a b_c 3.14", "x" * 50_000, "Žena ěr no-break here"]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    got = column(spark, TEXTS, T.tokens(F.col("t")))
    assert got[:4] == [[], [], ["ünïcode", "œuvre", "don", "t"], ["a", "a", "b", "c", "3", "14"]] and len(got[4]) == 1
    kept = column(spark, TEXTS, T.tokens(F.col("t"), punctuation=True))
    assert kept[3] == ["a", "a", "b", "_", "c", "3", ".", "14"]
    assert column(spark, TEXTS, T.tokens(F.col("t"), accents=False, case_folding=False))[5] == ["Zena", "er", "no", "break", "here"]


def test_accents(spark):
    got = column(spark, ["Smørrebrød ÆRLIG Straße Þór ÐÐ Łódź İı Ÿ žĳ"], T.tokens(F.col("t"), accents=False))
    assert got == [["smorrebrod", "erlig", "strase", "tor", "dd", "lodz", "ii", "y", "zi"]]
    assert column(spark, ["ß Ø"], T.tokens(F.col("t"), case_folding=False, accents=False)) == [["S", "O"]]


def test_positions(spark):
    df = spark.createDataFrame([(1, "b a b", 5), (2, None, 5)], "doc_id bigint, text string, pos int")
    assert sorted(map(tuple, token_table(df).collect())) == [(1, 0, "b"), (1, 1, "a"), (1, 2, "b")]


# Words of invented kinds: order numbers, cell references, tags, what follows a colon, quantities.
PATTERNS = ["// what an order form holds", "", r"no\d+(?:/\d+)?", r"[a-z]\d+:[a-z]\d+", r"#[a-z]+", r"(?<=:)[a-z]+", "([", r"\d+kg"]


def split(text, patterns, punctuation=False):
    """By brute force, for one text."""
    compiled = [re.compile(p, re.ASCII) for p in patterns]
    plain = re.compile(r"(?:[^\W\d_]|[0-9])+" + (r"|[!-/:-@\[-`{-~]" if punctuation else ""))
    out = []
    for rest in re.findall(r"(?:[^\W\d_]|[!-~])+", (text or "").lower()):
        while rest:
            hit = next((m for p in compiled if (m := p.search(rest)) and m.group()), None)
            if not hit:
                out += plain.findall(rest)
                break
            out += [*plain.findall(rest[: hit.start()]), hit.group()]
            rest = rest[hit.end() :]
    return out


def test_patterns(spark):
    read = T.read_patterns(PATTERNS)
    assert len(read) == 4  # the malformed one ends the list
    texts = ["Send no12/7,no3 in A1:B22;#red-#blue colour:green :gold", "x#a#b##c:d:e no", "no1no2no3", "𝐀#tag:end", "", None, *TEXTS[2:4]]
    got = column(spark, texts, T.pattern_tokens(read)(F.col("t")))
    assert got[0] == ["send", "no12/7", "no3", "in", "a1:b22", "#red", "#blue", "colour", "green", "gold"]
    assert got[1:] == [split(t, read) for t in texts[1:]]
    assert column(spark, texts, T.pattern_tokens(read, punctuation=True)(F.col("t"))) == [split(t, read, True) for t in texts]
    assert column(spark, TEXTS, T.pattern_tokens([])(F.col("t"))) == column(spark, TEXTS, T.tokens(F.col("t")))
    with pytest.raises(ValueError, match="refer back"):
        T.pattern_tokens([r"(a)\1"])


def test_kgrams(spark):
    for k in (2, 3):
        words = ["", "a", "ab", "banana", "é"]
        got = column(spark, words, T.kgrams(F.col("t"), k))
        assert [sorted(g) for g in got] == [sorted(T.term_kgrams(w, k)) for w in words]
    assert T.term_kgrams("ab", 2) == ["^a", "ab", "b$"] and T.term_kgrams("a", 3) == ["a"][:0] + ["a"] * (len("a") == 1)


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] if x == y else min(last[j], row[j - 1]) + 1
    return row[-1]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=6), st.text("abcé", max_size=6)), min_size=8, max_size=8))
def test_indel_distance(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.d for r in df.select("i", T.indel_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == [indel(*p) for p in pairs]


def test_names(spark):
    names = ["dump/wiki/A b.f", "A.f", "x\\y", "", None]
    assert column(spark, names, T.base_name(F.col("t"))) == ["A b.f", "A.f", "y", None, None]
    assert column(spark, names, T.without_first_piece(F.col("t")))[:2] == ["wiki/A b.f", "A.f"]
    assert column(spark, ["a" * 51, "b"], T.shortened(F.col("t"))) == ["a" * 50 + "...", "b"]
