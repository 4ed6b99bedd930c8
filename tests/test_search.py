import math

import pytest
from pyspark.sql import functions as F

from siftwell.operators import feedback, retrieval, spelling, wildcard
from siftwell.operators.index import Index, append, compact, dense_ids
from siftwell.plans.search import Searcher, parse

DOCS = [
    (1, "the revenge of the queen of england"), (2, "Queen, queen! money"), (3, None), (4, ""), (5, "the queen of money of the color of money"),
    (6, "reve re"), (7, "colour of the queen"), (8, "moriarty moneyless mony"),
]


@pytest.fixture(scope="module", params=["built", "stored"])
def index(spark, request, tmp_path_factory):
    built = Index.build(spark.createDataFrame(DOCS, "doc_id bigint, text string"))
    if request.param == "built":
        return built.in_memory()
    path = str(tmp_path_factory.mktemp("index"))
    built.write(path)
    return Index.read(spark, path, in_memory=True)


@pytest.fixture(scope="module")
def engine(spark, index):
    ranks = spark.createDataFrame([(1, 0.5), (2, 0.25)], "doc_id bigint, rank double")
    edges = spark.createDataFrame([(1, 2), (5, 2), (2, 7)], "src bigint, dst bigint")
    titles = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 5, 7)], "node bigint, title string")
    return Searcher(spark, index, ranks, edges, titles, spark.createDataFrame([(i, f"t{i}") for i, _ in DOCS], "doc_id bigint, title string"))


def ids(df):
    return [r.doc_id for r in df.collect()]


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_boolean(engine):
    assert ids(engine.search("queen", "intersection")) == [1, 2, 5, 7]
    assert ids(engine.search("QUEEN of", "intersection")) == [1, 5, 7]
    assert ids(engine.search("queen nowhere", "intersection")) == []
    assert ids(engine.search("queen of", "phrase")) == [1, 5]
    assert ids(engine.search("queen queen", "phrase")) == [2]
    assert ids(engine.search("of the", "phrase")) == [1, 5, 7]
    assert ids(engine.search("", "intersection")) == []


def test_phrase_within_intersection_within_ranked(engine):
    for q in ("queen of", "of money", "the queen of england"):
        assert set(ids(engine.search(q, "phrase"))) <= set(ids(engine.search(q, "intersection"))) <= set(ids(engine.search(q)))


def test_tfidf(engine):
    got = scores(engine.search("queen money queen"))
    n, df = len(DOCS), {"queen": 4, "money": 2}
    want = {i: sum(w * t.lower().replace(",", "").replace("!", "").split().count(q) * math.log(n // df[q]) for q, w in (("queen", 2), ("money", 1))) / len(t.split()) for i, t in DOCS if t and ("queen" in t.lower() or "money" in t.split())}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert scores(engine.search("queen nowhere")) == {} and scores(engine.search("")) == {}


def test_ranked_by_links(engine):
    pr = scores(engine.search("queen", "ranked", "pagerank"))
    assert pr == {1: pytest.approx(2 / 3), 2: pytest.approx(1 / 3), 5: 0, 7: 0}
    assert abs(sum(scores(engine.search("queen money", "ranked", "combination")).values()) - 1) < 1e-9
    assert set(scores(engine.search("england", "ranked", "hits"))) == {1, 2}


def test_no_division_by_zero(engine):
    assert set(scores(engine.search("moriarty", "ranked", "pagerank")).values()) == {0.0}


def test_wildcards(engine, index):
    grams = index.kgrams()
    found = lambda p: sorted(r.term for r in wildcard.expand(grams, p).collect())
    assert found("mon*y") == ["money", "mony"] and found("re*re") == ["re"] and found("re*ve") == ["reve"] and found("*") == [] and found("co*r") == ["color", "colour"]
    assert ids(engine.search("mon*", "intersection")) == [2, 5, 8]
    assert ids(engine.search("col*r of", "intersection")) == [5, 7]
    assert ids(engine.search("col*r of", "phrase")) == [5, 7]
    assert set(ids(engine.search("mon*y queen"))) == {1, 2, 5, 7, 8}
    assert [r.term for r in wildcard.kgram_intersection(grams, ["^m", "ey"]).orderBy("term").collect()] == ["money", "moneyless"]


def test_spelling(spark, index, engine):
    got = {(r.term, r.edits) for r in spelling.candidates(spark, index.kgrams(), ["moneyy"]).collect()}
    assert got == {("money", 1), ("mony", 2)}
    assert [r.suggestion for r in engine.suggest("colr quen").collect()][:2] == ["color queen", "colour queen"]
    assert [r.suggestion for r in engine.suggest("zzzz quen").collect()] == ["zzzz queen"]
    assert [r.suggestion for r in engine.suggest("zzzz").collect()] == ["zzzz"]


def test_missing_terms(index):
    assert [r.term for r in retrieval.missing_terms(index, ["queen", "nowhere"]).collect()] == ["nowhere"]


def test_feedback(spark, index, engine):
    n, df = len(DOCS), {"queen": 4, "money": 2, "of": 3, "reve": 1, "re": 1}
    relevant = spark.createDataFrame([(6,), (6,), (2,)], "doc_id bigint")
    got = {r.term: r.weight for r in feedback.rocchio(spark, index, parse("queen of"), relevant).collect()}
    want = {"queen": (0.5 + 0.75 / 2 * 2) * math.log(n / 4), "of": 0.5 * math.log(n / df["of"]), "money": 0.75 / 2 * math.log(n / 2), "reve": 0.75 / 2 * math.log(n), "re": 0.75 / 2 * math.log(n)}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)
    none = {r.term for r in feedback.rocchio(spark, index, parse("queen nowhere"), relevant.limit(0)).collect()}
    assert none == {"queen"}
    assert 6 in ids(engine.with_feedback("queen", relevant))


def test_parts_append_and_compact(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    whole = sorted(map(tuple, Index.build(df).postings.select("term", "doc_id", "tf").collect()))
    for part in ("doc_id < 5", "doc_id >= 5"):
        append(Index.build(df.where(part)), str(tmp_path / "ix"))
    parts = Index.read(spark, str(tmp_path / "ix"))
    want = {t: (sum(t == w[0] for w in whole), sum(w[2] for w in whole if w[0] == t)) for t, _, _ in whole}
    assert {r.term: (r.df, r.cf) for r in parts.dictionary.collect()} == want
    assert {r.term: r.df for r in parts.kgrams().collect()} == {t: df for t, (df, _) in want.items()} and parts.kgrams().count() == parts.kgrams(2).distinct().count()
    done = compact(spark, str(tmp_path / "ix"), str(tmp_path / "whole"))
    assert sorted(map(tuple, done.postings.select("term", "doc_id", "tf").collect())) == whole and done.docs.count() == len(DOCS)
    assert [r.doc_id for r in done.lookup("queen").collect()] == [1, 2, 5, 7]


def test_dense_ids(spark):
    got = dense_ids(spark.createDataFrame([(x,) for x in "dbacfe"], "t string"), "t", "id").collect()
    assert {r.t: r.id for r in got} == {x: i for i, x in enumerate("abcdef")}
    assert dense_ids(spark.createDataFrame([], "t string"), "t", "id").count() == 0


def test_empty_collection(spark):
    index = Index.build(spark.createDataFrame([], "doc_id bigint, text string"))
    assert Searcher(spark, index).search("queen").count() == 0
    assert index.docs.where(F.col("length") > 0).count() == 0


def plan(df):
    return df._jdf.queryExecution().toString()


def test_searches_read_what_their_words_name(spark, tmp_path):
    """Filters on terms and k-grams reach the files of a stored index, through the sums over appended parts too."""
    path = str(tmp_path / "ix")
    Index.build(spark.createDataFrame(DOCS, "doc_id bigint, text string")).write(path)
    ix = Index.read(spark, path)
    slots = retrieval.literal_slots(spark, parse("queen money"))
    assert "In(term, [money,queen])" in plan(retrieval.matched(ix, slots, ["queen", "money"]))
    assert "StringStartsWith(term,mon)" in plan(retrieval.matched(ix, slots, within=wildcard.scan_filter(["mon*", "queen"])))
    assert wildcard.scan_filter(["*y", "queen"]) is None
    assert "In(term, [money,queen])" in plan(ix.terms.where(F.col("term").isin("queen", "money")))
    assert "In(kgram, [" in plan(spelling.overlaps(spark, ix.kgrams(), ["quen"]))
    assert "Exchange rangepartitioning" in plan(Index.build(spark.createDataFrame(DOCS, "doc_id bigint, text string")).token_rows.repartitionByRange("term", "doc_id"))
    assert Searcher.query_length("the queen") == 2
