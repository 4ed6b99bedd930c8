"""Link analysis on edges (src, dst): degrees, PageRank by power iteration, and HITS on a whole or a query's graph.

Edges are distinct and without nulls; clean_edges makes them so. Iterations run as a driver loop over DataFrames; each one
writes its vector to the checkpoint folder, because the next reads it more than once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siftwell.operators.skew import checked_broadcast_join
from siftwell.session import cut_lineage, cut_lineage_in_place, shuffle_width

BORED = 0.15
#: Links of one node that stay together whatever the size of the graph.
HOT_LINKS = 100_000


def clean_edges(rows: DataFrame, src: Column, dst: Column) -> DataFrame:
    """Distinct (src, dst), self-loops kept, rows with a null end left out."""
    return rows.select(src.alias("src"), dst.alias("dst")).dropna().distinct()


def nodes(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(node) of either end, and of vertices (node) if there are nodes without links."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    return (ends if vertices is None else ends.unionAll(vertices.select("node").dropna())).distinct()


def out_degree(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(node, out) of all nodes, 0 for dangling ones. Counted with partial sums, so a source with most edges is no burden."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("n")).unionAll(edges.select(F.col("dst").alias("node"), F.lit(0).alias("n")))
    if vertices is not None:
        ends = ends.unionAll(vertices.select("node", F.lit(0).alias("n")).dropna())
    return ends.groupBy("node").agg(F.sum("n").alias("out"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@dataclass(frozen=True)
class PlacedLinks:
    """Links that stay where a join on one end needs them, step after step, sorted: only the vector is shuffled to them.

    A node with more than its share of links has these spread over several salts, and its score is repeated for each. Such
    nodes hold over total / (4 * partitions) links, so there are at most 4 * partitions of them.
    """

    links: DataFrame
    hot: DataFrame | None
    end: str

    @classmethod
    def by(cls, edges: DataFrame, end: str) -> PlacedLinks:
        width = shuffle_width(edges.sparkSession)
        other = "dst" if end == "src" else "src"
        counts = edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        limit = max(HOT_LINKS, -(-total // (4 * width)))
        hot = None
        links = edges.select(F.col(end).alias("node"), F.col(other).alias("other"))
        keys = ["node"]
        if total > limit and (found := counts.where(F.col("n") > limit).collect()):
            shape = StructType([StructField("node", edges.schema[end].dataType), StructField("salts", IntegerType())])
            hot = edges.sparkSession.createDataFrame([(r["node"], -(-r["n"] // limit)) for r in found], shape)
            links = links.join(F.broadcast(hot), "node", "left")
            keys = ["node", "salt"]
            links = links.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("other"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
        links = links.repartition(width, *keys).sortWithinPartitions(*keys)
        return cls(cut_lineage_in_place(links), hot, end)

    def carry(self, scores: DataFrame, score: str) -> DataFrame:
        """(node, score): the score of each link's end, at its other end."""
        scores, keys = scores.select("node", score), ["node"]
        if self.hot is not None:
            salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
            scores, keys = scores.join(F.broadcast(self.hot), "node", "left").select("node", F.explode(salts).alias("salt"), score), ["node", "salt"]
        return self.links.join(scores.hint("merge"), keys).select(F.col("other").alias("node"), score)


def pagerank(edges: DataFrame, iterations: int = 50, tolerance: float | None = None, bored: float = BORED, start: str = "first", vertices: DataFrame | None = None) -> DataFrame:
    """(node, rank), ranks sum to 1. A surfer jumps anywhere with probability bored and from a dangling node, else follows a
    link. start 'first' puts the surfer on the least node, 'uniform' anywhere. With a tolerance the loop ends once the
    Euclidean distance of two steps is within it, at the latest after iterations steps. vertices (node) adds nodes without links; no nodes give no rows."""
    edges = cut_lineage(edges)
    degrees = cut_lineage(out_degree(edges, vertices))
    size = degrees.agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).first()
    n = size["n"]
    if not n:
        return degrees.select("node", F.lit(0.0).alias("rank"))
    first = F.when(F.col("node") == F.lit(size["least"]), 1.0).otherwise(0.0) if start == "first" else F.lit(1.0 / n)
    ranks = degrees.select("node", "out", first.alias("rank"))
    links = PlacedLinks.by(edges, "src")
    for _ in range(iterations):
        sent = links.carry(ranks.where("out > 0").select("node", (F.col("rank") / F.col("out")).alias("share")), "share")
        none = F.lit(None)
        sent = sent.select("node", "share", none.cast("bigint").alias("out"), none.cast("double").alias("before"))
        own = ranks.select("node", F.lit(0.0).alias("share"), "out", F.col("rank").alias("before"))
        step = sent.unionAll(own).groupBy("node").agg(F.sum("share").alias("got"), F.max("out").alias("out"), F.max("before").alias("before"))
        lost = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0)).alias("lost")))  # one row
        rank = F.lit(bored / n) + (1 - bored) * (F.col("got") + F.col("lost") / n)
        step = cut_lineage(step.join(lost).select("node", "out", rank.alias("rank"), "before"))
        ranks = step.drop("before")
        if tolerance is not None:
            change = step.agg(F.sum(F.pow(F.col("rank") - F.col("before"), 2))).first()[0]
            if math.sqrt(change) <= tolerance:
                break
    return ranks.select("node", "rank")


def base_set(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(node): the root nodes, what they link to and what links to them."""
    root = root.select("node").distinct()
    ahead = checked_broadcast_join(edges, root.withColumnRenamed("node", "src"), ["src"], "left_semi").select(F.col("dst").alias("node"))
    behind = checked_broadcast_join(edges, root.withColumnRenamed("node", "dst"), ["dst"], "left_semi").select(F.col("src").alias("node"))
    return root.unionAll(ahead).unionAll(behind).distinct()


def hits(edges: DataFrame, base: DataFrame | None = None, iterations: int = 5, tolerance: float | None = None) -> DataFrame:
    """(node, hub, authority) of the base set, or of all nodes.

    Both scores of all nodes begin at 1. Each step takes the hub scores from the authorities and the authorities from the
    hubs of the step before, over the links of base nodes, and divides by the Euclidean length. So the first step counts a
    base node's links to and from any node, the later ones those within what the step before scored. A node without a
    score has 0. With a tolerance the loop ends once both changes add up to no more.
    """
    if base is None:
        ahead = behind = edges = cut_lineage(edges.select("src", "dst"))
        base = cut_lineage(nodes(edges))
    else:
        base = cut_lineage(base.select("node").distinct())
        ahead = cut_lineage(checked_broadcast_join(edges, base.withColumnRenamed("node", "src"), ["src"], "left_semi"))
        behind = cut_lineage(checked_broadcast_join(edges, base.withColumnRenamed("node", "dst"), ["dst"], "left_semi"))
    scores = None
    to_hubs, to_authorities = (PlacedLinks.by(ahead, "dst"), PlacedLinks.by(behind, "src")) if iterations > 1 else (None, None)
    for _ in range(iterations):
        zero, one = F.lit(0.0), F.lit(1.0)
        if scores is None:
            hubs, auths = ahead.select(F.col("src").alias("node"), one.alias("hub")), behind.select(F.col("dst").alias("node"), one.alias("authority"))
        else:
            hubs = to_hubs.carry(scores, "authority").withColumnRenamed("authority", "hub")
            auths = to_authorities.carry(scores, "hub").withColumnRenamed("hub", "authority")
        parts = hubs.select("node", "hub", zero.alias("authority")).unionAll(auths.select("node", zero, "authority")).unionAll(base.select("node", zero, zero))
        both = parts.groupBy("node").agg(F.sum("hub").alias("hub"), F.sum("authority").alias("authority"))
        lengths = F.broadcast(both.agg(F.sqrt(F.sum(F.col("hub") * F.col("hub"))).alias("lh"), F.sqrt(F.sum(F.col("authority") * F.col("authority"))).alias("la")))  # one row
        unit = lambda c, length: F.coalesce(F.try_divide(F.col(c), F.col(length)), F.lit(0.0)).alias(c)
        step = cut_lineage(both.join(lengths).select("node", unit("hub", "lh"), unit("authority", "la")))
        if tolerance is not None and scores is not None:
            old = scores.select("node", F.col("hub").alias("h0"), F.col("authority").alias("a0"))
            change = step.join(old, "node").agg(F.sqrt(F.sum(F.pow(F.col("hub") - F.col("h0"), 2))) + F.sqrt(F.sum(F.pow(F.col("authority") - F.col("a0"), 2)))).first()[0]
            scores = step
            if change is not None and change <= tolerance:
                break
        scores = step
    return scores


def hits_ranking(edges: DataFrame, titles: DataFrame, docs: DataFrame, rows: DataFrame, iterations: int = 5, compat: bool = False) -> DataFrame:
    """(doc_id, score): HITS of the base set around the documents with any of the query's terms.

    titles is (node, title), docs (doc_id, title). Documents without a node don't enter the root set, nodes without a
    document don't come out. score is the greater of hub and authority; compat gives 0 where they are equal.
    """
    titles, docs = titles.select("node", "title").distinct(), docs.select("doc_id", "title")
    root = cut_lineage(rows.select("doc_id").distinct().join(docs, "doc_id").join(titles, "title").select("node").distinct())
    edges = cut_lineage(edges)
    scores = hits(edges, base_set(edges, root), iterations)
    best = F.greatest("hub", "authority")
    best = F.when(F.col("hub") == F.col("authority"), 0.0).otherwise(best) if compat else best
    found = scores.join(titles, "node").join(docs, "title")
    return found.groupBy("doc_id").agg(F.max(best).alias("score"))


def top(scores: DataFrame, by: str, k: int = 30, key: str = "node") -> DataFrame:
    """The k greatest, ties by key."""
    return scores.orderBy(F.desc(by), key).limit(k)


def goodness(reference: DataFrame, estimate: DataFrame, k: int = 30) -> DataFrame:
    """One row: the sum of squared differences over the reference's k greatest ranks; both are (node, rank)."""
    best = top(reference.select("node", F.col("rank").alias("want")), "want", k)
    both = estimate.select("node", F.col("rank").alias("got")).join(F.broadcast(best), "node")  # k rows
    missed = F.broadcast(best.agg(F.sum(F.col("want") * F.col("want")).alias("all")))
    seen = both.agg(F.coalesce(F.sum(F.pow(F.col("want") - F.col("got"), 2) - F.col("want") * F.col("want")), F.lit(0.0)).alias("part"))
    return seen.join(missed).select((F.col("all") + F.col("part")).alias("goodness"))
