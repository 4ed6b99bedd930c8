"""One ranking from several scores of different scales, by robust rank aggregation.

Each score only gives an item's place among the group's items. The places of an item, divided by the group's size and
sorted, are held against those of an item ranked at random: the k-th least of n random places is below x with the
probability that a beta(k, n - k + 1) variable is, which is a binomial tail. The least of these probabilities, times n,
is the item's significance.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.skew import checked_broadcast_join
from siftwell.session import cut_lineage

#: Groups above max(HOT_ROWS, total / HOT_KEYS) items are ranked in parts, hence at most HOT_KEYS groups are.
HOT_ROWS = 200_000
HOT_KEYS = 5_000
#: Parts of a hot group, and the accuracy of the value limits that make them (not of the ranks, which are exact).
PARTS = 64
ACCURACY = 2_000


def beta_tail(x: Column, k: int, n: int) -> Column:
    """P(Beta(k, n - k + 1) <= x): at least k of n uniform places lie below x."""
    terms = [F.lit(float(comb(n, j))) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(n - j)) for j in range(k, n + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def significance(ordered: Column, n: int) -> Column:
    """The corrected minimum over an item's n places in (0, 1], ascending."""
    tails = [beta_tail(F.element_at(ordered, k), k, n) for k in range(1, n + 1)]
    return F.least(F.lit(1.0), (F.least(*tails) if n > 1 else tails[0]) * F.lit(float(n)))


def _places(long: DataFrame, limits: DataFrame | None) -> DataFrame:
    """long (group, item, size, score, v) to (group, item, place): (items with a greater v + half of the ties' others + 1) / size,
    1 where v is missing. Equal values are counted together first, so ties of any number are one row of the window."""
    there = long.where(F.col("v").isNotNull())
    values = there.groupBy("group", "score", "v").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    part = F.lit(0)
    if limits is not None:
        values = values.join(F.broadcast(limits), ["group", "score"], "left")
        part = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c >= F.col("v"))))
    values = values.withColumn("part", part)
    above = F.sum("n").over(Window.partitionBy("group", "score", "part").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("above", F.coalesce(above, F.lit(0)))
    if limits is not None:
        sizes = values.where("cuts is not null").groupBy("group", "score", "part").agg(F.sum("n").alias("m"))
        before = F.sum("m").over(Window.partitionBy("group", "score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        sizes = F.broadcast(sizes.select("group", "score", "part", before.alias("before")))  # PARTS rows for each score of a hot group
        values = values.join(sizes, ["group", "score", "part"], "left").withColumn("above", F.col("above") + F.coalesce("before", F.lit(0)))
    values = values.select("group", "score", "v", ((F.col("above") + (F.col("n") + 1) / 2) / F.col("size")).alias("place"))
    placed = there.select("group", "item", "score", "v").join(values, ["group", "score", "v"]).select("group", "item", "place")
    return placed.unionAll(long.where(F.col("v").isNull()).select("group", "item", F.lit(1.0).alias("place")))


def aggregate_rankings(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """One ranking of each group's items: (group, item, rho, mean_place).

    All scores weigh alike, greater is better, and only an item's place in its group counts. Equal scores share the mean
    of their places, a missing or NaN score takes the last place. Rows that repeat an item give it its greatest value of each
    score; rows with a null group or item are left out. Items are to be ordered by rho (the corrected minimum), then by mean
    place, then by id, as best_of_each does. A group above max(HOT_ROWS, total / HOT_KEYS) items is ranked in parts cut at
    its approximate quantiles, by counts of the parts above; of such groups there are at most HOT_KEYS.
    """
    cleaned = [F.max(F.when(~F.isnan(s), F.col(s).cast("double"))).alias(f"s{i}") for i, s in enumerate(scores)]
    items = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("group"), F.col(item).alias("item")).agg(*cleaned)
    items = cut_lineage(items)
    sizes = items.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("score"), F.col(f"s{i}").alias("v")) for i in range(len(scores))])).alias("x")
    long = checked_broadcast_join(items, sizes, ["group"]).select("group", "item", "size", each).select("group", "item", "size", "x.score", "x.v")
    limits = None
    if total > limit and (big := sizes.where(F.col("size") > limit).collect()):
        hot = df.sparkSession.createDataFrame([(b["group"],) for b in big], items.select("group").schema)
        at = F.array(*[F.lit(p / PARTS) for p in range(1, PARTS)])
        inside = long.join(F.broadcast(hot), "group", "left_semi")
        limits = cut_lineage(inside.groupBy("group", "score").agg(F.array_distinct(F.percentile_approx("v", at, F.lit(ACCURACY))).alias("cuts")))
    places = _places(long, limits).groupBy("group", "item").agg(F.collect_list("place").alias("places"))  # one of each score
    places = places.withColumn("places", F.array_sort("places"))
    mean = F.aggregate("places", F.lit(0.0), lambda a, x: a + x) / len(scores)
    return places.select("group", "item", significance(F.col("places"), len(scores)).alias("rho"), mean.alias("mean_place"))


def best_of_each(ranked: DataFrame, k: int) -> DataFrame:
    """The k best items of each group with their position."""
    order = Window.partitionBy("group").orderBy("rho", "mean_place", "item")
    return ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
