"""Spelling suggestions: candidates by shared k-grams, filtered by overlap and edit distance, ranked by overlap and frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import indel_distance, kgrams, term_kgrams
from siftwell.session import cut_lineage

LEAST_JACCARD = 0.4
MOST_EDITS = 2


def overlaps(spark: SparkSession, grams: DataFrame, words: list[str], k: int = 2) -> DataFrame:
    """(ord, word, term, df, jaccard) of terms that share a k-gram with a word of the query. grams is an index's (kgram, term, df,
    n_grams); only the query's k-grams are read."""
    queries = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "ord int, word string")
    asked = queries.select("ord", "word", F.explode(kgrams(F.col("word"), k)).alias("kgram"), F.size(kgrams(F.col("word"), k)).alias("n_word"))
    wanted = sorted({g for w in words for g in term_kgrams(w, k)})
    found = grams.where(F.col("kgram").isin(wanted)).select("kgram", "term", "df", "n_grams")
    shared = found.join(F.broadcast(asked), "kgram").groupBy("ord", "word", "term", "df", "n_word", "n_grams").agg(F.count(F.lit(1)).alias("n"))  # the query's k-grams
    jaccard = F.col("n") / (F.col("n_word") + F.col("n_grams") - F.col("n"))
    return shared.select("ord", "word", "term", "df", jaccard.alias("jaccard"))


def candidates(spark: SparkSession, grams: DataFrame, words: list[str], k: int = 2, least: float = LEAST_JACCARD, edits: int = MOST_EDITS) -> DataFrame:
    """(ord, word, term, df, jaccard, edits) within both limits. Levenshtein distance is never above the edit distance used
    here, and the JVM computes it with a bound, so it goes first."""
    near = overlaps(spark, grams, words, k).where(F.col("jaccard") >= least)
    near = near.where(F.levenshtein("word", "term", edits) >= 0)
    return near.withColumn("edits", indel_distance(F.col("word"), F.col("term"))).where(F.col("edits") <= edits)


def scored(found: DataFrame) -> DataFrame:
    """(ord, term, score): a candidate's shares of the overlap and of the document frequency among its word's candidates."""
    sums = found.groupBy("ord").agg(F.sum("jaccard").alias("sj"), F.sum("df").alias("sd"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return found.join(F.broadcast(sums), "ord").select("ord", "term", (share("jaccard", "sj") + share("df", "sd")).alias("score"))  # a row for each word


def suggest(spark: SparkSession, grams: DataFrame, words: list[str], limit: int = 10, k: int = 2) -> DataFrame:
    """(suggestion, score): the best corrections of a whole query. Scores of the words add up, so each word needs only its own
    limit best; a word without candidates stays as it is, at score 0."""
    each = cut_lineage(scored(cut_lineage(candidates(spark, grams, words, k))))
    out = None
    for i, word in enumerate(words):
        best = each.where(F.col("ord") == i).orderBy(F.desc("score"), "term").limit(limit).select("term", "score")
        asked = spark.createDataFrame([(word, 0.0)], "term string, score double")
        best = best.unionByName(asked.join(best.limit(1).select(F.lit(1).alias("__any")), how="left").where("__any is null").drop("__any"))
        if out is None:
            out = best.select(F.col("term").alias("suggestion"), "score")
        else:
            more = best.select("term", F.col("score").alias("more"))
            out = out.join(F.broadcast(more)).select(F.concat_ws(" ", "suggestion", "term").alias("suggestion"), (F.col("score") + F.col("more")).alias("score"))  # limit rows
            out = out.orderBy(F.desc("score"), "suggestion").limit(limit)
    return out.orderBy(F.desc("score"), "suggestion").limit(limit)
