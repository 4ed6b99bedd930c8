"""Queries on the link graph, sparse matrices, vectors and rankings' quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import evaluate, graph, linalg, walks
from siftwell.operators.hotkeys import links_by_source
from siftwell.plans.records import base_name, node_id, table
from siftwell.session import cut_lineage, scratch_dir
from siftwell.sources.files import read_links, top_lines

#: Power iteration and HITS end once a step changes so little, within so many steps; their SQL unrolls some and stops by the same rule.
RANK_CHANGE, SCORE_CHANGE, MOST_STEPS = 1e-7, 1e-5, 1000
SQL_STEPS = 40
#: Random walks: as many from each node, at least so many together and of each node.
WALKS = 1_000_000
WALKS_PER_NODE = 20
CUTOFFS = [10, 20, 30, 40, 50]
ASSUMED_RELEVANT = 100
#: Squared differences between ranks by walks and by power iteration, far above what chance makes at WALKS walks.
WALKS_APART = 1e-4


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clean_edges(table(spark, sf_dir, "link_edges"), node_id("src"), node_id("dst"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links as a matrix of ones."""
    return edges(spark, sf_dir).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v"))


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degrees as a vector."""
    return graph.out_degree(edges(spark, sf_dir)).select(F.col("node").alias("i"), F.col("out").cast("double").alias("v"))


def _pagerank(e: DataFrame, start: str = "first") -> DataFrame:
    return graph.pagerank(e, iterations=MOST_STEPS, tolerance=RANK_CHANGE, start=start)


def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pagerank(edges(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


def graph_pagerank_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pagerank(edges(spark, sf_dir), "uniform").select("node", F.round("rank", 9).alias("rank"))


def graph_pagerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(_pagerank(edges(spark, sf_dir)), "rank", 30).select("node", F.round("rank", 9).alias("rank"))


def graph_pagerank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty best nodes as they are shown."""
    return top_lines(_pagerank(edges(spark, sf_dir)), "node", "rank")


def _titled(spark: SparkSession, sf_dir: str, ranks: DataFrame) -> DataFrame:
    titles = table(spark, sf_dir, "page_titles").select(node_id("node_id").alias("node"), "title").dropna().distinct()
    return ranks.join(titles, "node").groupBy("title").agg(F.max("rank").alias("rank"))


def graph_pagerank_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranks under the nodes' titles."""
    return _titled(spark, sf_dir, _pagerank(edges(spark, sf_dir))).select("title", F.round("rank", 9).alias("rank"))


def _scores(scores: DataFrame) -> DataFrame:
    return scores.select("node", F.round("hub", 7).alias("hub"), F.round("authority", 7).alias("authority"))


def graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(graph.hits(edges(spark, sf_dir), iterations=MOST_STEPS, tolerance=SCORE_CHANGE))


def graph_hits_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps, as many as a search takes."""
    return _scores(graph.hits(edges(spark, sf_dir), iterations=5))


def graph_base_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base set around the documents that users marked as relevant."""
    info = table(spark, sf_dir, "doc_info").select("doc_id", base_name("name").alias("title"))
    titles = table(spark, sf_dir, "page_titles").select(node_id("node_id").alias("node"), "title").distinct()
    marked = table(spark, sf_dir, "feedback_docs").select("doc_id").distinct()
    return graph.base_set(edges(spark, sf_dir), marked.join(info, "doc_id").join(titles, "title").select("node"))


def _enough(n_nodes: int) -> int:
    return walks.enough(n_nodes, WALKS, WALKS_PER_NODE)


def _walks(method: int):
    return lambda spark, sf_dir: walks.monte_carlo(edges(spark, sf_dir), _enough, method)


def graph_walks_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for the ranks of each kind of random walk: (method, nodes, total, near), near if the squared differences from power
    iteration over all nodes add up to WALKS_APART at most."""
    e = cut_lineage(edges(spark, sf_dir))
    reference = _pagerank(e).withColumnRenamed("rank", "want")
    both = walks.method_series(walks.Laid.of(e), lambda n, _: [_enough(n)], list(walks.METHODS)).join(reference, "node")
    near = (F.sum(F.pow(F.col("rank") - F.col("want"), 2)) <= WALKS_APART).alias("near")
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("rank"), 6).alias("total"), near)


def graph_goodness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a rank of two steps is from the converged one, over the latter's thirty best."""
    e = cut_lineage(edges(spark, sf_dir))
    return graph.goodness(_pagerank(e), graph.pagerank(e, iterations=2)).select(F.round("goodness", 9).alias("goodness"))


def graph_goodness_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The goodness of each kind of random walk against power iteration, over the sweep of numbers of walks: (method, walks, goodness)."""
    e = cut_lineage(edges(spark, sf_dir))
    return walks.goodness_series(cut_lineage(_pagerank(e)), walks.Laid.of(e), list(walks.METHODS))


def src_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as lines 'node;out,out,' and read again; a node with many links has several lines."""
    e = edges(spark, sf_dir).select(F.monotonically_increasing_id().alias("id"), "src", "dst")
    lines = links_by_source(e, "id", F.col("src"), F.col("dst")).select(F.concat(F.col("src").cast("string"), F.lit(";"), F.array_join(F.col("link").cast("array<string>"), ","), F.lit(",")).alias("value"))
    path = scratch_dir(spark) + "/lines"
    lines.write.text(path)
    return read_links(spark, path)[0]


def la_spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.spmv(matrix(spark, sf_dir), degrees(spark, sf_dir))


def la_left_spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.left_spmv(degrees(spark, sf_dir), matrix(spark, sf_dir))


def la_spmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = matrix(spark, sf_dir)
    return linalg.spmm(a, a)


def _with_transpose(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = matrix(spark, sf_dir)
        return f(a, linalg.transpose(a))

    return run


def la_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = matrix(spark, sf_dir)
    return linalg.distance(a, linalg.transpose(a)).select(F.round("distance", 6).alias("distance"))


def _normalised(norm: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        weighted = matrix(spark, sf_dir).withColumn("v", (F.col("j") % 7 + 1).cast("double"))
        return linalg.normalise_rows(weighted, norm).select("i", "j", F.round("v", 9).alias("v"))

    return run


def la_normalize_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.normalise_vector(degrees(spark, sf_dir)).select("i", F.round("v", 9).alias("v"))


def la_scale_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.total(linalg.scale(matrix(spark, sf_dir), 0.5))


def _similar(spark: SparkSession, sf_dir: str, unit: bool) -> DataFrame:
    """Every vector whose id is divisible by 20, a stated query set, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    found = linalg.vector_products(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", unit)
    return found.select("query", "vec_id", F.round("v", 5).alias("v"))


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    info = table(spark, sf_dir, "doc_info").select("doc_id", base_name("name").alias("doc"))
    run = table(spark, sf_dir, "run_scores").join(info, "doc_id").select("query_id", "doc", F.col("tfidf").alias("score"))
    judged = table(spark, sf_dir, "qrels").where("doc_name is not null").select("query_id", base_name("doc_name").alias("doc"), "grade")
    return run, judged


def eval_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ndcg(evaluate.ranked_grades(*_run(spark, sf_dir))).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def eval_ndcg_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ndcg(evaluate.ranked_grades(*_run(spark, sf_dir)), 50).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def _precision(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    found = evaluate.precision_recall(evaluate.ranked_grades(*_run(spark, sf_dir)), CUTOFFS, **how)
    return found.select("query_id", "k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def eval_set_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.set_precision(_run(spark, sf_dir)[1])
    return found.select("query_id", "judged", "relevant", F.round("precision", 6).alias("precision"))


QUERIES = {
    "graph_edges": edges, "graph_nodes": lambda s, d: graph.nodes(edges(s, d)), "graph_outdegree": lambda s, d: graph.out_degree(edges(s, d)), "graph_transpose": lambda s, d: graph.transpose(edges(s, d)),
    "graph_pagerank": graph_pagerank, "graph_pagerank_uniform": graph_pagerank_uniform, "graph_pagerank_top": graph_pagerank_top, "graph_pagerank_lines": graph_pagerank_lines,
    "graph_pagerank_titles": graph_pagerank_titles, "graph_hits": graph_hits, "graph_hits_steps": graph_hits_steps, "graph_base_set": graph_base_set,
    "graph_mc1": _walks(1), "graph_mc2": _walks(2), "graph_mc4": _walks(4), "graph_mc5": _walks(5), "graph_walks_near": graph_walks_near,
    "graph_goodness": graph_goodness, "graph_goodness_walks": graph_goodness_walks, "src_links": src_links,
    "la_spmv": la_spmv, "la_left_spmv": la_left_spmv, "la_spmm": la_spmm, "la_add": _with_transpose(linalg.add), "la_sub": _with_transpose(linalg.subtract), "la_distance": la_distance,
    "la_normalize_l1": _normalised("l1"), "la_normalize_l2": _normalised("l2"), "la_normalize_vector": la_normalize_vector, "la_scale_sum": la_scale_sum,
    "la_dot": lambda s, d: _similar(s, d, False), "la_cosine": lambda s, d: _similar(s, d, True),
    "eval_ndcg": eval_ndcg, "eval_ndcg_at": eval_ndcg_at, "eval_precision_recall": lambda s, d: _precision(s, d, assumed=ASSUMED_RELEVANT), "eval_precision_recall_list": _precision, "eval_set_precision": eval_set_precision,
}

_EDGES = """
WITH e AS MATERIALIZED (SELECT DISTINCT CAST(trim(src) AS BIGINT) AS src, CAST(trim(dst) AS BIGINT) AS dst FROM link_edges WHERE src IS NOT NULL AND dst IS NOT NULL),
deg AS MATERIALIZED (SELECT node, CAST(sum(n) AS BIGINT) AS out FROM (SELECT src AS node, 1 AS n FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY node),
m AS (SELECT src AS i, dst AS j, CAST(1 AS DOUBLE) AS v FROM e),
d AS (SELECT node AS i, CAST(out AS DOUBLE) AS v FROM deg)"""


def _ended(step: str, change: str, tolerance: float, first: int, steps: int) -> str:
    """CTE ended: the rows of the first of the steps whose change is within the tolerance."""
    changes = " UNION ALL ".join(f"SELECT {k} AS k, {change} AS c FROM {step}{k} b JOIN {step}{k - 1} a USING (node)" for k in range(first, steps))
    rows = " UNION ALL ".join(f"SELECT {k} AS k, * FROM {step}{k}" for k in range(first, steps))
    return f", changes AS MATERIALIZED ({changes}), ended AS MATERIALIZED (SELECT * FROM ({rows}) WHERE k = (SELECT min(k) FROM changes WHERE c <= {tolerance}))"


def _pagerank_sql(start: str = "first", steps: int = SQL_STEPS) -> str:
    first = "CASE WHEN node = (SELECT min(node) FROM deg) THEN 1.0 ELSE 0.0 END" if start == "first" else "1.0 / (SELECT count(*) FROM deg)"
    out = _EDGES + f", size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM deg), r0 AS MATERIALIZED (SELECT node, out, CAST({first} AS DOUBLE) AS rank FROM deg)"
    for k in range(1, steps):
        out += f""",
g{k} AS MATERIALIZED (SELECT dst AS node, sum(rank / out) AS got FROM e JOIN r{k - 1} r ON r.node = e.src GROUP BY dst),
r{k} AS MATERIALIZED (SELECT r.node, r.out, CAST(0.15 AS DOUBLE) / n + CAST(0.85 AS DOUBLE) * (coalesce(got, 0) + (SELECT sum(rank) FROM r{k - 1} WHERE out = 0) / n) AS rank FROM r{k - 1} r LEFT JOIN g{k} USING (node), size)"""
    return out + _ended("r", "sqrt(sum(pow(b.rank - a.rank, 2)))", RANK_CHANGE, 1, steps)


def _hits_sql(steps: int, ends: bool) -> str:
    out = _EDGES + ", raw0 AS MATERIALIZED (SELECT node, CAST(out AS DOUBLE) AS h, CAST(coalesce(n, 0) AS DOUBLE) AS a FROM deg LEFT JOIN (SELECT dst AS node, count(*) AS n FROM e GROUP BY dst) USING (node))"
    for k in range(steps):
        if k:
            out += f""",
raw{k} AS MATERIALIZED (SELECT node, coalesce(x.h, 0) AS h, coalesce(y.a, 0) AS a FROM deg LEFT JOIN (SELECT src AS node, sum(a) AS h FROM e JOIN v{k - 1} v ON v.node = dst GROUP BY src) x USING (node)
  LEFT JOIN (SELECT dst AS node, sum(h) AS a FROM e JOIN v{k - 1} v ON v.node = src GROUP BY dst) y USING (node))"""
        out += f", v{k} AS MATERIALIZED (SELECT node, h / (SELECT sqrt(sum(h * h)) FROM raw{k}) AS h, a / (SELECT sqrt(sum(a * a)) FROM raw{k}) AS a FROM raw{k})"
    if ends:
        out += _ended("v", "sqrt(sum(pow(b.h - a.h, 2))) + sqrt(sum(pow(b.a - a.a, 2)))", SCORE_CHANGE, 1, steps)
    return out + f" SELECT node, round(h, 7) AS hub, round(a, 7) AS authority FROM {'ended' if ends else f'v{steps - 1}'}"


_RANKED = """
WITH info AS (SELECT doc_id, regexp_replace(name, '^.*/', '') AS doc FROM doc_info),
run AS (SELECT query_id, doc, max(tfidf) AS score FROM run_scores JOIN info USING (doc_id) GROUP BY query_id, doc),
judged AS (SELECT query_id, regexp_replace(doc_name, '^.*/', '') AS doc, max(grade) AS grade FROM qrels WHERE doc_name IS NOT NULL AND grade IS NOT NULL GROUP BY ALL),
ranked AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc) AS rk, coalesce(grade, 0) AS grade FROM run LEFT JOIN judged USING (query_id, doc))"""


def _ndcg_sql(where: str = "") -> str:
    return (
        _RANKED
        + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rk) AS best FROM ranked {where})
SELECT query_id, round(coalesce(sum((pow(2, grade) - 1) / log2(rk + 1)) / nullif(sum((pow(2, grade) - 1) / log2(best + 1)), 0), 0), 6) AS ndcg FROM placed GROUP BY query_id"""
    )


def _precision_sql(n: str) -> str:
    cuts = ", ".join(f"({k})" for k in CUTOFFS)
    return (
        _RANKED
        + f""", c(k) AS (VALUES {cuts}), hits AS (SELECT query_id, k, count(*) FILTER (WHERE rk <= k AND grade >= 1) AS hits, count(*) FILTER (WHERE grade >= 1) AS listed FROM ranked, c GROUP BY query_id, k)
SELECT query_id, k, round(hits / k, 6) AS precision, round(coalesce(hits / nullif({n}, 0), 0), 6) AS recall FROM hits"""
    )


_COSINE = "SELECT a.vec_id AS query, b.vec_id, round({f}, 5) AS v FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"
_DOUBLE = "CAST({}.embedding AS DOUBLE[64])"

SQL = {
    "graph_edges": _EDGES + " SELECT src, dst FROM e",
    "src_links": _EDGES + " SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM e",
    "graph_nodes": _EDGES + " SELECT node FROM deg",
    "graph_outdegree": _EDGES + " SELECT node, out FROM deg",
    "graph_transpose": _EDGES + " SELECT dst AS src, src AS dst FROM e",
    "graph_pagerank": _pagerank_sql() + " SELECT node, round(rank, 9) AS rank FROM ended",
    "graph_pagerank_uniform": _pagerank_sql("uniform") + " SELECT node, round(rank, 9) AS rank FROM ended",
    "graph_pagerank_top": _pagerank_sql() + " SELECT node, round(rank, 9) AS rank FROM ended ORDER BY ended.rank DESC, node LIMIT 30",
    "graph_pagerank_lines": _pagerank_sql() + " SELECT CAST(row_number() OVER (ORDER BY rank DESC, node) AS INTEGER) AS place, printf('%d: %.5f', node, rank) AS line FROM ended ORDER BY rank DESC, node LIMIT 30",
    "graph_pagerank_titles": _pagerank_sql() + " SELECT title, round(max(rank), 9) AS rank FROM ended JOIN page_titles ON CAST(trim(node_id) AS BIGINT) = node GROUP BY title",
    "graph_hits": _hits_sql(SQL_STEPS, True),
    "graph_hits_steps": _hits_sql(5, False),
    "graph_walks_near": _EDGES + " SELECT method, count(*) AS nodes, CAST(1 AS DOUBLE) AS total, true AS near FROM deg, (VALUES (1), (2), (4), (5)) AS m(method) GROUP BY method",
    "graph_base_set": _EDGES
    + """, root AS (SELECT DISTINCT CAST(trim(node_id) AS BIGINT) AS node FROM feedback_docs JOIN doc_info USING (doc_id) JOIN page_titles ON title = regexp_replace(name, '^.*/', ''))
SELECT node FROM root UNION SELECT dst FROM e WHERE src IN (SELECT node FROM root) UNION SELECT src FROM e WHERE dst IN (SELECT node FROM root)""",
    "graph_goodness": _pagerank_sql() + " SELECT round(sum(pow(b.rank - a.rank, 2)), 9) AS goodness FROM (SELECT * FROM ended ORDER BY rank DESC, node LIMIT 30) b JOIN r2 a USING (node)",
    "la_spmv": _EDGES + " SELECT m.i, sum(m.v * d.v) AS v FROM m JOIN d ON d.i = m.j GROUP BY m.i",
    "la_left_spmv": _EDGES + " SELECT m.j AS i, sum(m.v * d.v) AS v FROM m JOIN d ON d.i = m.i GROUP BY m.j",
    "la_spmm": _EDGES + " SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY a.i, b.j",
    "la_add": _EDGES + " SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM m UNION ALL SELECT j, i, v FROM m) GROUP BY i, j",
    "la_sub": _EDGES + " SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM m UNION ALL SELECT j, i, -v FROM m) GROUP BY i, j",
    "la_distance": _EDGES + " SELECT round(sqrt(sum(v * v)), 6) AS distance FROM (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM m UNION ALL SELECT j, i, -v FROM m) GROUP BY i, j)",
    "la_normalize_l1": _EDGES + ", w AS (SELECT i, j, CAST(j % 7 + 1 AS DOUBLE) AS v FROM m) SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM w",
    "la_normalize_l2": _EDGES + ", w AS (SELECT i, j, CAST(j % 7 + 1 AS DOUBLE) AS v FROM m) SELECT i, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY i)), 9) AS v FROM w",
    "la_normalize_vector": _EDGES + " SELECT i, round(v / sqrt(sum(v * v) OVER ()), 9) AS v FROM d",
    "la_scale_sum": _EDGES + " SELECT sum(v * 0.5) AS total FROM m",
    "la_dot": _COSINE.format(f=f"array_inner_product({_DOUBLE.format('a')}, {_DOUBLE.format('b')})"),
    "la_cosine": _COSINE.format(f=f"array_cosine_similarity({_DOUBLE.format('a')}, {_DOUBLE.format('b')})"),
    "eval_ndcg": _ndcg_sql(),
    "eval_ndcg_at": _ndcg_sql("WHERE rk <= 50"),
    "eval_precision_recall": _precision_sql(str(ASSUMED_RELEVANT)),
    "eval_precision_recall_list": _precision_sql("listed"),
    "eval_set_precision": """WITH j AS (SELECT query_id, regexp_replace(doc_name, '^.*/', '') AS doc, max(grade) AS grade FROM qrels WHERE doc_name IS NOT NULL AND grade IS NOT NULL GROUP BY ALL)
SELECT query_id, count(*) AS judged, count(*) FILTER (WHERE grade >= 1) AS relevant, round(count(*) FILTER (WHERE grade >= 1) / count(*), 6) AS precision FROM j GROUP BY query_id""",
}
