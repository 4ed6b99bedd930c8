"""Boolean, phrase and ranked retrieval over an Index.

A query is a table of slots (ord, term, weight): a slot is a word of the query, and may hold several terms where it stood
for a wildcard. A literal query's slots are made on the driver and are as few as its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.index import Index
from siftwell.operators.skew import checked_broadcast_join

SLOTS = "ord int, term string, weight double"
#: Share of the text score in the combined ranking.
TEXT_WEIGHT = 0.1


def literal_slots(spark: SparkSession, terms: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame([(i, t, float(w)) for i, (t, w) in enumerate(terms)], SLOTS)


def matched(index: Index, slots: DataFrame, literal: list[str] | None = None, within: Column | None = None) -> DataFrame:
    """Postings joined with slots. literal terms go down to the scan as a filter, else within, a condition on term that all
    terms of the slots meet."""
    postings = index.postings
    if literal is not None:
        postings = postings.where(F.col("term").isin(sorted(set(literal))))
        return postings.join(F.broadcast(slots), "term")  # as many slots as the query has words
    if within is not None:
        postings = postings.where(within)
    return checked_broadcast_join(postings, slots, ["term"])


def if_all_known(rows: DataFrame, literal: list[str]) -> DataFrame:
    """rows, or none of them if a term of the query has none."""
    wanted = sorted(set(literal))
    if not wanted:
        return rows
    known = rows.where(F.col("term").isin(wanted)).select("term").distinct()
    known = known.agg((F.count(F.lit(1)) == len(wanted)).alias("__known"))  # one row
    return rows.join(F.broadcast(known)).where("__known").drop("__known")


def missing_terms(index: Index, literal: list[str]) -> DataFrame:
    """The query's terms that no document has; spelling suggestions start from these."""
    spark = index.postings.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(set(literal))], "term string")
    have = index.terms.where(F.col("term").isin(sorted(set(literal)))).select("term")
    return wanted.join(have, "term", "left_anti")


def intersection(rows: DataFrame, n_slots: int) -> DataFrame:
    """Documents with a term of every slot, by id. One aggregation, whatever the number of slots."""
    return rows.groupBy("doc_id").agg(F.count_distinct("ord").alias("n")).where(F.col("n") == n_slots).select("doc_id").orderBy("doc_id")


def phrase(rows: DataFrame, n_slots: int) -> DataFrame:
    """Documents with the slots' terms in a row, by id: a phrase starts at position p if every slot i has a term at p + i."""
    places = rows.select("doc_id", "ord", F.explode("positions").alias("pos"))
    starts = places.groupBy("doc_id", (F.col("pos") - F.col("ord")).alias("start")).agg(F.count_distinct("ord").alias("n"))
    return starts.where(F.col("n") == n_slots).select("doc_id").distinct().orderBy("doc_id")


def _frequencies(index: Index, rows: DataFrame, literal: list[str] | None) -> DataFrame:
    """(term, df) of the query's terms: from a stored dictionary, else from the query's postings."""
    if index.dictionary is None:
        return rows.select("term", "doc_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if literal is not None:
        return index.terms.where(F.col("term").isin(sorted(set(literal))))
    return checked_broadcast_join(index.terms, rows.select("term").distinct(), ["term"], "left_semi")


def tfidf(index: Index, rows: DataFrame, exact_division: bool = False, literal: list[str] | None = None) -> DataFrame:
    """(doc_id, score): sum of weight * tf * ln(N / df) over the query, by the document's length; N / df is rounded down
    unless exact_division. Every document with a term comes out, at score 0 too."""
    n = F.broadcast(index.docs.agg(F.count(F.lit(1)).alias("n_docs")))  # one row
    ratio = F.col("n_docs") / F.col("df")
    idf = _frequencies(index, rows, literal).join(n).select("term", F.log(ratio if exact_division else F.floor(ratio).cast("double")).alias("idf"))
    rows = rows.select("term", "doc_id", "tf", "length", "weight")
    scored = rows.join(F.broadcast(idf), "term") if literal is not None else checked_broadcast_join(rows, idf, ["term"])  # a row for each word of the query
    out = scored.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("tf") * F.col("idf")).alias("total"), F.first("length").alias("length"))
    return out.select("doc_id", F.coalesce(F.try_divide(F.col("total"), F.col("length")), F.lit(0.0)).alias("score"))


def normalised(rows: DataFrame, score: str) -> DataFrame:
    """score divided by its sum over the rows, 0 where that is 0."""
    total = F.broadcast(rows.agg(F.sum(score).alias("__total")))  # one row
    share = F.coalesce(F.try_divide(F.col(score), F.col("__total")), F.lit(0.0))
    return rows.join(total).withColumn(score, share).drop("__total")


def pagerank_ranking(index: Index, rows: DataFrame, pageranks: DataFrame) -> DataFrame:
    """(doc_id, score): documents with any term by their page rank, as a share of the result's sum. pageranks is (doc_id, rank);
    a document without a rank has 0."""
    docs = rows.select("doc_id").distinct().join(pageranks.select("doc_id", "rank"), "doc_id", "left")
    return normalised(docs.select("doc_id", F.coalesce("rank", F.lit(0.0)).alias("score")), "score")


def combination(index: Index, rows: DataFrame, pageranks: DataFrame, text_weight: float = TEXT_WEIGHT, literal: list[str] | None = None) -> DataFrame:
    """(doc_id, score): text_weight of the text score's share and the rest of the page rank's."""
    both = tfidf(index, rows, literal=literal).join(pageranks.select("doc_id", F.col("rank").alias("pr")), "doc_id", "left").withColumn("pr", F.coalesce("pr", F.lit(0.0)))
    sums = F.broadcast(both.agg(F.sum("score").alias("__s"), F.sum("pr").alias("__p")))  # one row
    part = lambda x, total: F.coalesce(F.try_divide(F.col(x), F.col(total)), F.lit(0.0))
    return both.join(sums).select("doc_id", (text_weight * part("score", "__s") + (1 - text_weight) * part("pr", "__p")).alias("score"))


def by_score(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "doc_id")
