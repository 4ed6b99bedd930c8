"""Queries on references and hot keys over link_edges, page_titles and qrels, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.hotkeys import exact_quantiles, heavy_sources, links_by_source
from siftwell.operators.orphans import Parents, References, numbered, orphan_references, orphan_report

#: Targets in one row of a link list.
LINK_CAPACITY = 1000
#: A source with this share of all links is reported as hot.
HOT_SHARE = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(c: str) -> Column:
    """A node id without blanks around and leading zeros; as a number, which all ids are; other text is null."""
    return F.trim(F.col(c)).try_cast("bigint")


def base_name(c: str) -> Column:
    """The piece behind the last slash."""
    return F.substring_index(c, "/", -1)


def _references(spark: SparkSession, sf_dir: str) -> tuple[list[References], list[Parents]]:
    titles = table(spark, sf_dir, "page_titles")
    links = References("link_edges", table(spark, sf_dir, "link_edges"), "edge_id", "dst", "seen_at", "node")
    judged = References("qrels", table(spark, sf_dir, "qrels"), "judgement_id", base_name("doc_name"), "judged_at", "title")
    judged, named = numbered(judged, Parents("title", titles, "title", "added_at", "deleted_at"))
    return [links, judged], [Parents("node", titles, "node_id", "added_at", "deleted_at"), named]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = _references(spark, sf_dir)
    return orphan_references(refs, parents)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = _references(spark, sf_dir)
    return orphan_report(orphan_references(refs, parents), refs)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_by_source(table(spark, sf_dir, "link_edges"), "edge_id", node_id("src"), node_id("dst"), LINK_CAPACITY)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of 1 % of the links or more, by exact selection over all links in the order of their sources."""
    return heavy_sources(table(spark, sf_dir, "link_edges"), "edge_id", node_id("src"), HOT_SHARE).select(F.col("src").cast("string").alias("src"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return links.select(F.col("src").cast("string").alias("src"), "out", "n_targets", "piece", F.array_join(F.col("link").cast("array<string>"), " ").alias("link"))


def p2_target_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "link_edges").select(node_id("src").alias("src"), node_id("dst").alias("dst"))
    found = exact_quantiles(edges, "src", "dst", [0.25, 0.5, 0.75, 1.0])
    return found.select(F.col("key").alias("src"), "prob", F.col("value").alias("dst"))


_ORPHANS = """
WITH refs AS (
  SELECT 'link_edges' AS ref_table, edge_id AS row_id, CAST(CAST(trim(dst) AS BIGINT) AS VARCHAR) AS k, seen_at AS t FROM link_edges WHERE dst IS NOT NULL
  UNION ALL
  SELECT 'qrels', judgement_id, regexp_replace(doc_name, '^.*/', ''), judged_at FROM qrels WHERE doc_name IS NOT NULL
), lives AS (
  SELECT 'link_edges' AS ref_table, CAST(CAST(trim(node_id) AS BIGINT) AS VARCHAR) AS k, added_at, deleted_at FROM page_titles
  UNION ALL
  SELECT 'qrels', title, added_at, deleted_at FROM page_titles
), orphans AS (
  SELECT DISTINCT r.ref_table, coalesce(strftime(r.t, '%Y-%m'), 'unknown') AS period, r.row_id FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.ref_table = r.ref_table AND l.k = r.k
    AND (r.t IS NULL OR ((l.added_at IS NULL OR l.added_at <= r.t) AND (l.deleted_at IS NULL OR l.deleted_at > r.t))))
)"""

_EDGES = """
WITH links AS (
  SELECT DISTINCT edge_id, CAST(trim(src) AS BIGINT) AS src, CAST(trim(dst) AS BIGINT) AS dst FROM link_edges
)"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_links": p2_links, "p2_target_quantiles": p2_target_quantiles}

SQL = {
    "p1_found": _ORPHANS + " SELECT ref_table, period, row_id FROM orphans",
    "p1_report": _ORPHANS
    + """, seen AS (SELECT DISTINCT ref_table, coalesce(strftime(t, '%Y-%m'), 'unknown') AS period, row_id FROM refs)
SELECT s.ref_table, s.period, count(*) AS n_refs, CAST(count(o.row_id) AS BIGINT) AS n_orphans
FROM seen s LEFT JOIN orphans o USING (ref_table, period, row_id) GROUP BY s.ref_table, s.period""",
    "p2_found": _EDGES
    + """ SELECT CAST(src AS VARCHAR) AS src FROM links WHERE src IS NOT NULL GROUP BY links.src
HAVING count(DISTINCT edge_id) >= 0.01 * (SELECT count(DISTINCT edge_id) FROM links)""",
    "p2_links": _EDGES
    + f""", outs AS (SELECT src, count(DISTINCT edge_id) AS out, count(DISTINCT dst) AS n_targets FROM links WHERE src IS NOT NULL GROUP BY src),
ranked AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // {LINK_CAPACITY} AS piece FROM (SELECT DISTINCT src, dst FROM links WHERE dst IS NOT NULL)),
pieces AS (SELECT src, piece, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS link FROM ranked GROUP BY src, piece)
SELECT CAST(o.src AS VARCHAR) AS src, o.out, o.n_targets, CAST(coalesce(p.piece, 0) AS BIGINT) AS piece, coalesce(p.link, '') AS link FROM outs o LEFT JOIN pieces p USING (src)""",
    "p2_target_quantiles": """
WITH e AS (SELECT CAST(trim(src) AS BIGINT) AS src, CAST(trim(dst) AS BIGINT) AS dst FROM link_edges WHERE src IS NOT NULL AND dst IS NOT NULL),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn, count(*) OVER (PARTITION BY src) AS n FROM e),
p(prob) AS (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(1.0 AS DOUBLE)))
SELECT src, prob, dst FROM r, p WHERE rn = greatest(1, CAST(ceil(prob * n) AS BIGINT))""",
}
