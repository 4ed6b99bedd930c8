"""Command line: python -m siftwell {tokens,index,search,suggest,kgrams,pagerank,hits,walks} ..., see --help of each."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import graph, walks, wildcard
from siftwell.operators.index import Index, token_table
from siftwell.plans.search import QueryType, Ranking, Searcher
from siftwell.session import local_session
from siftwell.sources import files


def _words(spark: SparkSession, a: argparse.Namespace):
    if a.patterns:
        return T.pattern_tokens(files.read_pattern_file(a.patterns), not a.keep_case, a.keep_punctuation)(F.col("text"))
    return T.tokens(F.col("text"), not a.keep_case, not a.remove_accents, a.keep_punctuation)


def _graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return files.read_links(spark, path)


def _named(spark: SparkSession, scores: DataFrame, titles: str | None) -> DataFrame:
    """scores with titles in place of node ids where there are any."""
    if not titles:
        return scores
    named = scores.join(files.read_titles(spark, titles), "node", "left")
    return named.withColumn("node", F.coalesce("title", "node")).drop("title")


def _show(scores: DataFrame, by: str, k: int) -> None:
    for row in files.top_lines(scores, "node", by, k).orderBy("place").collect():  # k rows
        print(row["line"])


def tokens(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = token_table(files.read_documents(spark, a.path), words=_words(spark, a)).orderBy("doc_id", "pos")
    for row in rows.select("term").toLocalIterator():
        print(row["term"])


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    Index.build(files.read_documents(spark, a.path), name="name", words=_words(spark, a)).write(a.out)


def _searcher(spark: SparkSession, a: argparse.Namespace) -> Searcher:
    ix = Index.read(spark, a.index)
    titles = ix.docs.select("doc_id", T.base_name(F.col("name")).alias("title"))
    ranks = edges = nodes = None
    if a.pageranks:
        ranks = titles.join(files.read_pageranks(spark, a.pageranks).withColumnRenamed("name", "title"), "title").select("doc_id", "rank")
    if a.links:
        edges = _graph(spark, a.links)[0]
        nodes = files.read_titles(spark, a.titles)
    return Searcher(spark, ix, ranks, edges, nodes, titles)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    engine, began = _searcher(spark, a), time.time()
    found = engine.search(a.query, a.type, a.ranking).join(engine.index.docs.select("doc_id", "name"), "doc_id")
    scored = "score" in found.columns
    found = found.orderBy(*([F.desc("score")] if scored else []), "doc_id").offset(a.skip).limit(a.top)
    for place, row in enumerate(found.collect(), a.skip):  # top rows
        print(f"{place}. {row['name']}" + (f"   {row['score']:.5f}" if scored else ""))
    print(f"{time.time() - began:.2f} s")


def suggest(spark: SparkSession, a: argparse.Namespace) -> None:
    for row in Searcher(spark, Index.read(spark, a.index)).suggest(a.query, a.top).collect():  # top rows
        print(f"{row['suggestion']}   {row['score']:.5f}")


def kgrams(spark: SparkSession, a: argparse.Namespace) -> None:
    terms = wildcard.kgram_intersection(Index.read(spark, a.index).kgrams(a.k), a.kgram)
    print(f"{terms.count()} terms")
    for row in terms.orderBy("term").limit(10).collect():
        print(row["term"])


def pagerank(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, nodes = _graph(spark, a.links)
    ranks = graph.pagerank(edges, a.iterations, a.tolerance, vertices=nodes)
    if a.out:
        files.write_lines(_named(spark, ranks, a.titles), a.out, "node", "rank")
    _show(_named(spark, ranks, a.titles), "rank", a.top)


def hits(spark: SparkSession, a: argparse.Namespace) -> None:
    scores = _named(spark, graph.hits(_graph(spark, a.links)[0], iterations=a.iterations, tolerance=a.tolerance), a.titles)
    for by in ("hub", "authority"):
        print(by)
        _show(scores, by, a.top)


def walk(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, nodes = _graph(spark, a.links)
    _show(_named(spark, walks.monte_carlo(edges, a.walks, a.method, vertices=nodes), a.titles), "rank", a.top)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        one = sub.add_parser(name)
        one.set_defaults(run=run)
        for x in positional:
            one.add_argument(x)
        one.add_argument("--top", type=int, default=30 if name in ("pagerank", "hits", "walks") else 10)
        return one

    for name, run, args in (("tokens", tokens, ["path"]), ("index", index, ["path", "out"])):
        one = command(name, run, *args)
        one.add_argument("--patterns")
        for flag in ("--keep-case", "--keep-punctuation", "--remove-accents"):
            one.add_argument(flag, action="store_true")
    one = command("search", search, "index", "query")
    one.add_argument("--type", choices=[t.value for t in QueryType], default="ranked")
    one.add_argument("--ranking", choices=[r.value for r in Ranking], default="tfidf")
    one.add_argument("--skip", type=int, default=0)
    for flag in ("--pageranks", "--links", "--titles"):
        one.add_argument(flag)
    command("suggest", suggest, "index", "query")
    one = command("kgrams", kgrams, "index")
    one.add_argument("kgram", nargs="+")
    one.add_argument("-k", type=int, default=2)
    for name, run, steps, tolerance in (("pagerank", pagerank, 1000, 1e-7), ("hits", hits, 1000, 1e-5)):
        one = command(name, run, "links")
        one.add_argument("--titles")
        one.add_argument("--out")
        one.add_argument("--iterations", type=int, default=steps)
        one.add_argument("--tolerance", type=float, default=tolerance)
    one = command("walks", walk, "links")
    one.add_argument("--titles")
    one.add_argument("--walks", type=int, default=1_000_000)
    one.add_argument("--method", type=int, choices=sorted(walks.METHODS), default=4)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.getActiveSession() or local_session(), a)


if __name__ == "__main__":
    main()
