"""Readers and writers of the plain-text formats: documents, link graphs, titles, ranks, judgements, series and patterns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import read_patterns
from siftwell.operators.index import dense_ids


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, name, text): every file below folder as one UTF-8 text, files that can't be read left out; ids from 0 in the order
    of names. Spark's file sources pass over files of no bytes, so these don't come out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    files = reader.load(folder).select(F.col("path").alias("name"), F.col("content").cast("string").alias("text"))
    return dense_ids(files, "name", "doc_id").select("doc_id", "name", "text")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def read_links(spark: SparkSession, path: str, most_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines 'node;out,out,' as distinct edges (src, dst) and nodes (node) of either end; the list may be empty. most_nodes
    keeps the links of that many source nodes, the least ones."""
    parts = F.split("value", ";", 2)
    rows = _lines(spark, path).select(F.trim(parts[0]).alias("src"), F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: F.trim(x) != "").alias("dsts"))
    if most_nodes is not None:
        rows = rows.orderBy("src").limit(most_nodes)
    edges = rows.select("src", F.explode("dsts").alias("dst")).select("src", F.trim("dst").alias("dst")).distinct()
    nodes = rows.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()
    return edges, nodes


def _pairs(spark: SparkSession, path: str, sep: str, first: str, second: str) -> DataFrame:
    parts = F.split("value", sep, 2)
    return _lines(spark, path).select(F.trim(parts[0]).alias(first), F.trim(F.get(parts, F.lit(1))).alias(second))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """'id;title' as (node, title); the title may hold further semicolons."""
    return _pairs(spark, path, ";", "node", "title")


def read_pageranks(spark: SparkSession, path: str) -> DataFrame:
    """'name;score' as (name, rank); the score stands behind the last semicolon."""
    last = F.length("value") - F.length(F.substring_index("value", ";", -1))
    return _lines(spark, path).select(F.substr("value", F.lit(1), last - 1).alias("name"), F.substring_index("value", ";", -1).try_cast("double").alias("rank"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """'node;score' as (node BIGINT, rank)."""
    return read_pageranks(spark, path).select(F.col("name").try_cast("bigint").alias("node"), "rank")


def read_doc_info(spark: SparkSession, path: str) -> DataFrame:
    """'id;name;length' as (doc_id, name, length)."""
    parts = F.regexp_extract("value", r"^(\d+);(.*);(\d*)$", 2)
    return _lines(spark, path).select(F.substring_index("value", ";", 1).try_cast("bigint").alias("doc_id"), parts.alias("name"), F.substring_index("value", ";", -1).try_cast("int").alias("length"))


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """'token id' as (term, term_id)."""
    return _pairs(spark, path, " ", "term", "id").select("term", F.col("id").try_cast("int").alias("term_id"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """'query document grade' as (query_id, doc_name, grade); names may hold blanks."""
    line = r"^(\d+) (.*) (\d+)$"
    piece = lambda i: F.regexp_extract(F.trim("value"), line, i)
    rows = _lines(spark, path).where(F.trim("value").rlike(line))
    return rows.select(piece(1).cast("int").alias("query_id"), piece(2).alias("doc_name"), piece(3).cast("int").alias("grade"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """'n,value' as (n, value)."""
    return _pairs(spark, path, ",", "n", "value").select(F.col("n").try_cast("double").cast("bigint").alias("n"), F.col("value").try_cast("double").alias("value"))


def read_pattern_file(path: str) -> list[str]:
    return read_patterns(Path(path).read_text(encoding="utf-8").splitlines())


def find_document(docs: DataFrame, name: str) -> DataFrame:
    """The documents whose path ends in a name."""
    from siftwell.functions.text import base_name

    return docs.where(base_name(F.col("name")) == name)


def write_lines(rows: DataFrame, path: str, *columns, sep: str = ";") -> None:
    """Text files of the columns; what is null is written as 'null'."""
    text = [F.coalesce(c.cast("string"), F.lit("null")) for c in (F.col(x) if isinstance(x, str) else x for x in columns)]
    rows.select(F.concat_ws(sep, *text).alias("value")).write.mode("overwrite").text(path)


def write_pageranks(ranks: DataFrame, titles: DataFrame, path: str) -> None:
    """'title;score' of each node of (node, rank); a node without a title is written as null."""
    named = ranks.join(titles.select("node", "title"), "node", "left")
    write_lines(named, path, "title", "rank")


def write_doc_info(docs: DataFrame, path: str) -> None:
    """'id;name;length' of (doc_id, name, length); a null length is left empty."""
    write_lines(docs, path, "doc_id", "name", F.coalesce(F.col("length").cast("string"), F.lit("")))


def write_token_index(terms: DataFrame, path: str) -> None:
    """'token id' of (token, token_id)."""
    write_lines(terms, path, "token", "token_id", sep=" ")


def write_goodness(rows: DataFrame, path: str) -> None:
    """'n,value' of a series."""
    write_lines(rows, path, "n", "value", sep=",")


def top_lines(scores: DataFrame, key: str, value: str, k: int = 30, form: str = "%s: %.5f") -> DataFrame:
    """The k greatest as lines (place, line) in a printf form."""
    best = scores.orderBy(F.desc(value), key).limit(k)
    placed = best.select(F.struct(F.col(value).alias("v"), F.col(key).alias("k")).alias("x")).agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).when(a["k"] < b["k"], -1).otherwise(1)).alias("xs"))
    return placed.select(F.posexplode("xs").alias("place", "x")).select((F.col("place") + 1).alias("place"), F.format_string(form, F.col("x.k").cast("string"), F.col("x.v")).alias("line"))


def write_top(scores: DataFrame, key: str, value: str, path: str, k: int = 30, form: str = "%s: %.5g") -> None:
    top_lines(scores, key, value, k, form).orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(path)  # k lines
