"""Every plain-text format written from the tables and read again, and the SQL of what must come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import graph
from siftwell.plans.graph_queries import edges
from siftwell.plans.records import base_name, node_id, table
from siftwell.session import scratch_dir
from siftwell.sources import files


def _again(rows: Callable[[SparkSession, str], DataFrame], write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_dir(spark) + "/lines"
        write(rows(spark, sf_dir), path)
        return read(spark, path)

    return run


def _lines(*columns: str, sep: str = ";") -> Callable[[DataFrame, str], None]:
    return lambda rows, path: files.write_lines(rows, path, *columns, sep=sep)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_titles").select(node_id("node_id").alias("node"), F.trim("title").alias("title")).dropna().distinct()


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qrels").select("query_id", F.trim(base_name("doc_name")).alias("doc_name"), "grade").dropna().where("doc_name <> ''").distinct()


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree(edges(spark, sf_dir)).select("node", F.col("out").cast("double").alias("rank"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_info").where("length is not null").select(F.col("doc_id").alias("n"), F.col("length").cast("double").alias("value"))


def src_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their own below folders of a language: the base name is the id."""
    path = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.base64(F.col("text").cast("binary")).alias("value"))
    docs.repartition(8, "doc_id").write.partitionBy("doc_id").text(f"{path}/docs")
    found = files.read_documents(spark, f"{path}/docs").where(F.col("name").endswith(".txt"))
    kept = F.unbase64(F.trim(F.regexp_replace("text", r"\s", "")))
    return found.select(F.regexp_extract("name", r"doc_id=(\d+)/", 1).cast("bigint").alias("doc_id"), F.md5(kept).alias("sum"))


def src_named_pageranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degrees of nodes under their titles, as written for page ranks; a node without a title is 'null'."""
    titles = _titles(spark, sf_dir).groupBy("node").agg(F.min("title").alias("title"))
    write = lambda rows, path: files.write_pageranks(rows, titles, path)
    return _again(_degrees, write, files.read_pageranks)(spark, sf_dir)


QUERIES = {
    "src_titles": _again(_titles, _lines("node", "title"), files.read_titles),
    "src_pageranks": _again(lambda s, d: table(s, d, "pageranks"), _lines("name", "rank"), files.read_pageranks),
    "src_reference": _again(_degrees, _lines("node", "rank"), files.read_reference),
    "src_doc_info": _again(lambda s, d: table(s, d, "doc_info"), files.write_doc_info, files.read_doc_info),
    "src_token_index": _again(lambda s, d: table(s, d, "token_index"), files.write_token_index, files.read_token_index),
    "src_judgements": _again(_judged, _lines("query_id", "doc_name", "grade", sep=" "), files.read_judgements),
    "src_series": _again(_lengths, files.write_goodness, files.read_series),
    "src_top": _again(_degrees, lambda rows, path: files.write_top(rows, "node", "rank", path, form="%s: %.3f"), lambda s, path: s.read.text(path).withColumnRenamed("value", "line")),
    "src_named_pageranks": src_named_pageranks, "src_documents": src_documents,
}

_NODES = """WITH e AS (SELECT DISTINCT CAST(trim(src) AS BIGINT) AS src, CAST(trim(dst) AS BIGINT) AS dst FROM link_edges WHERE src IS NOT NULL AND dst IS NOT NULL),
deg AS (SELECT node, CAST(sum(n) AS DOUBLE) AS rank FROM (SELECT src AS node, 1 AS n FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY node)"""

SQL = {
    "src_titles": "SELECT DISTINCT CAST(CAST(trim(node_id) AS BIGINT) AS VARCHAR) AS node, trim(title) AS title FROM page_titles WHERE node_id IS NOT NULL AND title IS NOT NULL",
    "src_pageranks": "SELECT name, rank FROM pageranks",
    "src_reference": _NODES + " SELECT node, rank FROM deg",
    "src_doc_info": "SELECT doc_id, name, length FROM doc_info",
    "src_token_index": "SELECT token AS term, token_id AS term_id FROM token_index",
    "src_judgements": "SELECT DISTINCT query_id, trim(regexp_replace(doc_name, '^.*/', '')) AS doc_name, grade FROM qrels WHERE query_id IS NOT NULL AND grade IS NOT NULL AND trim(regexp_replace(doc_name, '^.*/', '')) <> ''",
    "src_series": "SELECT doc_id AS n, CAST(length AS DOUBLE) AS value FROM doc_info WHERE length IS NOT NULL",
    "src_top": _NODES + " SELECT node || ': ' || printf('%.3f', rank) AS line FROM deg ORDER BY rank DESC, node LIMIT 30",
    "src_named_pageranks": _NODES + ", t AS (SELECT CAST(trim(node_id) AS BIGINT) AS node, min(trim(title)) AS title FROM page_titles WHERE title IS NOT NULL GROUP BY 1) SELECT coalesce(title, 'null') AS name, rank FROM deg LEFT JOIN t USING (node)",
    "src_documents": "SELECT doc_id, md5(text) AS sum FROM documents WHERE length(text) > 0",
}
