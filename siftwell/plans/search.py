"""The search engine: one entry point over an index, link graph and page ranks. Ranked searches write the query's postings once, what they
return is lazy."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import feedback, graph, retrieval, spelling, wildcard
from siftwell.operators.index import Index
from siftwell.session import cut_lineage


class QueryType(Enum):
    INTERSECTION = "intersection"
    PHRASE = "phrase"
    RANKED = "ranked"


class Ranking(Enum):
    TFIDF = "tfidf"
    PAGERANK = "pagerank"
    COMBINATION = "combination"
    HITS = "hits"


def parse(query: str) -> list[tuple[str, float]]:
    """Lower-case words between blanks, weight 1 each."""
    return [(w, 1.0) for w in query.lower().split()]


@dataclass(frozen=True)
class Searcher:
    """pageranks is (doc_id, rank); edges (src, dst), titles (node, title) and docs' titles are only read for HITS."""

    spark: SparkSession
    index: Index
    pageranks: DataFrame | None = None
    edges: DataFrame | None = None
    titles: DataFrame | None = None
    doc_titles: DataFrame | None = None
    k: int = 2

    def slots(self, terms: list[tuple[str, float]]) -> tuple[DataFrame, list[str] | None]:
        """The query's slots, and its terms if none is a wildcard. A wildcard's slot holds the terms it stands for."""
        literal = [t for t, _ in terms if wildcard.WILD not in t]
        if len(literal) == len(terms):
            return retrieval.literal_slots(self.spark, terms), literal
        slots = retrieval.literal_slots(self.spark, [("", 0.0)]).where("false")
        grams = self.index.kgrams(self.k)
        for i, (t, w) in enumerate(terms):
            if wildcard.WILD in t:
                slots = slots.unionByName(wildcard.expand(grams, t, self.k).select(F.lit(i).alias("ord"), "term", F.lit(w).alias("weight")))
            else:
                slots = slots.unionByName(self.spark.createDataFrame([(i, t, w)], retrieval.SLOTS))
        return slots, None

    @staticmethod
    def query_length(query: str) -> int:
        """The number of a query's words."""
        return len(parse(query))

    def search(self, query: str, kind: QueryType | str = QueryType.RANKED, ranking: Ranking | str = Ranking.TFIDF) -> DataFrame:
        """(doc_id) by id for intersection and phrase, (doc_id, score) by score for ranked queries. An empty query finds
        nothing, and so does one with a word (not a wildcard) that no document has."""
        return self.search_terms(parse(query), kind, ranking)

    def search_terms(self, terms: list[tuple[str, float]], kind: QueryType | str = QueryType.RANKED, ranking: Ranking | str = Ranking.TFIDF) -> DataFrame:
        kind, ranking = QueryType(kind), Ranking(ranking)
        slots, literal = self.slots(terms)
        if kind is QueryType.RANKED and literal is None:
            slots = slots.groupBy("term").agg(F.lit(0).alias("ord"), F.lit(1.0).alias("weight"))  # one bag of all terms
        if literal is None:
            slots = cut_lineage(slots)  # read to check its size, and to join
        rows = retrieval.matched(self.index, slots, literal, wildcard.scan_filter([t for t, _ in terms]))
        if kind is QueryType.INTERSECTION:
            return retrieval.intersection(rows, len(terms))
        if kind is QueryType.PHRASE:
            return retrieval.phrase(rows, len(terms))
        rows = cut_lineage(rows.drop("positions"))  # the query's postings only; read for what is known, for df and to score
        rows = retrieval.if_all_known(rows, [t for t, _ in terms if wildcard.WILD not in t])
        return retrieval.by_score(self._ranked(rows, ranking, literal))

    def _ranked(self, rows: DataFrame, ranking: Ranking, literal: list[str] | None) -> DataFrame:
        if ranking is Ranking.TFIDF:
            return retrieval.tfidf(self.index, rows, literal=literal)
        if ranking is Ranking.PAGERANK:
            return retrieval.pagerank_ranking(self.index, rows, self.pageranks)
        if ranking is Ranking.COMBINATION:
            return retrieval.combination(self.index, rows, self.pageranks, literal=literal)
        return graph.hits_ranking(self.edges, self.titles, self.doc_titles, rows)

    def with_feedback(self, query: str, relevant: DataFrame) -> DataFrame:
        """(doc_id, score): the ranked search again, with weights learnt from documents marked as relevant (doc_id)."""
        weights = cut_lineage(feedback.rocchio(self.spark, self.index, parse(query), relevant))
        rows = cut_lineage(retrieval.matched(self.index, feedback.feedback_slots(weights)))
        return retrieval.by_score(retrieval.tfidf(self.index, rows))

    def suggest(self, query: str, limit: int = 10) -> DataFrame:
        """(suggestion, score) for a query that found nothing."""
        return spelling.suggest(self.spark, self.index.kgrams(self.k), [t for t, _ in parse(query)], limit, self.k)
