"""Quality of rankings against graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_grades(run: DataFrame, judgements: DataFrame) -> DataFrame:
    """(query_id, doc, rank, grade) from a run (query_id, doc, score) and judgements (query_id, doc, grade). Ties go by doc, a
    document judged several times has its highest grade, one never judged 0; repeated documents of a run count once, with
    their highest score."""
    best = judgements.where(F.col("grade").isNotNull()).groupBy("query_id", "doc").agg(F.max("grade").alias("grade"))
    once = run.groupBy("query_id", "doc").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "doc")
    placed = once.withColumn("rank", F.row_number().over(order)).drop("score")
    return placed.join(best, ["query_id", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ndcg(ranked: DataFrame, depth: int | None = None) -> DataFrame:
    """(query_id, ndcg) with gain 2^grade - 1 and discount log2(rank + 1), over the same list in its best order; 0 if no
    document is relevant."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    if depth is not None:
        ranked = ranked.where(F.col("rank") <= depth)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    sums = ranked.withColumn("ideal", ideal).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(gain / F.log2(F.col("ideal") + 1)).alias("best"))
    return sums.select("query_id", F.coalesce(F.try_divide(F.col("dcg"), F.col("best")), F.lit(0.0)).alias("ndcg"))


def precision_recall(ranked: DataFrame, cutoffs: list[int], relevant: DataFrame | None = None, assumed: int | None = None) -> DataFrame:
    """(query_id, k, precision, recall) at each cutoff; grade 1 and above is relevant. Recall is over assumed documents if
    given, else over relevant (query_id, n), else over the relevant ones of the list itself."""
    hit = F.when(F.col("grade") >= 1, 1).otherwise(0)
    at = F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k")
    found = ranked.groupBy("query_id").agg(*[F.sum(F.when(F.col("rank") <= k, hit).otherwise(0)).alias(f"h{k}") for k in cutoffs], F.sum(hit).alias("in_list"))
    if relevant is not None:
        found = found.join(relevant.select("query_id", F.col("n").alias("n_relevant")), "query_id", "left")
    n = F.lit(assumed) if assumed is not None else F.col("n_relevant") if relevant is not None else F.col("in_list")
    hits = F.create_map(*[x for k in cutoffs for x in (F.lit(k), F.col(f"h{k}"))])
    rows = found.select("query_id", at, hits.alias("hits"), n.alias("n"))
    got = F.element_at("hits", F.col("k"))
    return rows.select("query_id", "k", (got / F.col("k")).alias("precision"), F.coalesce(F.try_divide(got, F.col("n")), F.lit(0.0)).alias("recall"))


def set_precision(judgements: DataFrame) -> DataFrame:
    """(query_id, judged, relevant, precision) of an unranked result: the share with grade 1 and above."""
    graded = judgements.where(F.col("grade").isNotNull()).groupBy("query_id", "doc").agg(F.max("grade").alias("grade"))
    hit = F.sum(F.when(F.col("grade") >= 1, 1).otherwise(0))
    return graded.groupBy("query_id").agg(F.count(F.lit(1)).alias("judged"), hit.alias("relevant"), (hit / F.count(F.lit(1))).alias("precision"))
