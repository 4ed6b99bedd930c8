"""Results known from elsewhere. Files are named by the environment, 'a:b:c', and a test without its files is skipped."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import evaluate, graph
from siftwell.sources import files


def named(variable):
    paths = os.environ.get(variable, "").split(":")
    if not all(os.path.isfile(p) for p in paths):
        pytest.skip(f"${variable} names no files")
    return paths


def test_tokens_of_a_file(spark):
    """$SIFTWELL_GOLDEN_TOKENS: text, patterns, expected tokens one a line."""
    text, patterns, expected = named("SIFTWELL_GOLDEN_TOKENS")
    df = spark.createDataFrame([(Path(text).read_text(encoding="utf-8"),)], "text string")
    got = df.select(T.pattern_tokens(files.read_pattern_file(patterns))(F.col("text")).alias("w")).first().w
    assert got == Path(expected).read_text(encoding="utf-8").split("\n")[: len(got)] and len(got) == len(Path(expected).read_text(encoding="utf-8").split())


def test_pageranks_of_a_file(spark):
    """$SIFTWELL_GOLDEN_RANKS: links, expected 'node: rank' of the thirty best. 28 steps from the least node agree in every digit."""
    links, expected = named("SIFTWELL_GOLDEN_RANKS")
    edges, nodes = files.read_links(spark, links)
    number = lambda c: F.col(c).cast("bigint").alias(c)
    ranks = graph.pagerank(edges.select(number("src"), number("dst")), iterations=28, vertices=nodes.select(number("node")))
    got = [r.line for r in files.top_lines(ranks, "node", "rank").orderBy("place").collect()]
    assert got == Path(expected).read_text(encoding="utf-8").split("\n")[:30]


def test_precision_of_a_judgement_file(spark):
    """$SIFTWELL_GOLDEN_JUDGEMENTS: lines 'query document grade' of one query, 17 of whose 22 documents are relevant."""
    (path,) = named("SIFTWELL_GOLDEN_JUDGEMENTS")
    found = evaluate.set_precision(files.read_judgements(spark, path).withColumnRenamed("doc_name", "doc")).first()
    assert (found.relevant, found.judged) == (17, 22)
