"""Relevance feedback: query weights moved towards documents marked as relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.index import Index
from siftwell.operators.retrieval import literal_slots
from siftwell.operators.skew import checked_broadcast_join
from siftwell.session import cut_lineage

ALPHA = 1.0
BETA = 0.75


def rocchio(spark: SparkSession, index: Index, terms: list[tuple[str, float]], relevant: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """(term, weight): (weight / n_terms) * alpha * ln(N / df) of the query's terms, plus beta / n_relevant * ln(N / df) for each
    occurrence in a relevant document (doc_id). Terms no document has add nothing; without relevant documents only the
    query's part is left."""
    n = F.broadcast(index.docs.agg(F.count(F.lit(1)).cast("double").alias("n_docs")))  # one row
    marked = relevant.select("doc_id").distinct()
    count = F.broadcast(marked.agg(F.count(F.lit(1)).alias("n_relevant")))  # one row
    asked = literal_slots(spark, terms).select("term", (F.col("weight") * F.lit(alpha / max(1, len(terms)))).alias("part"))
    seen = checked_broadcast_join(index.postings.select("term", "doc_id", "tf"), marked, ["doc_id"], "left_semi").groupBy("term").agg(F.sum("tf").alias("tf"))
    seen = seen.join(count).select("term", (F.lit(beta) * F.col("tf") / F.col("n_relevant")).alias("part"))
    parts = cut_lineage(asked.unionByName(seen).groupBy("term").agg(F.sum("part").alias("part")))
    return checked_broadcast_join(index.terms, parts, ["term"]).join(n).select("term", (F.col("part") * F.log(F.col("n_docs") / F.col("df"))).alias("weight"))


def feedback_slots(weights: DataFrame) -> DataFrame:
    """Weights as the slots of a ranked query."""
    return weights.select(F.lit(0).alias("ord"), "term", "weight")
