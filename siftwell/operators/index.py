"""The positional inverted index as DataFrames: tokens, postings, documents and dictionary, kept as Parquet."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import kgrams, tokens
from siftwell.session import cut_lineage


def token_table(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: Column | None = None) -> DataFrame:
    """(doc_id, pos, term): each token with its place from 0. words is the tokenizer's array, standard tokens by default."""
    return documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(words if words is not None else tokens(F.col(text))).alias("pos", "term"))


def postings_of(token_rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions, length), positions ascending, from (doc_id, pos, term, length). The document's length stands
    beside each posting, so a ranking needs no join with the documents. One shuffle by (term, doc_id): a common term is
    spread over its documents."""
    grouped = token_rows.groupBy("term", "doc_id")
    return grouped.agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("length").alias("length"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def dense_ids(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with ids 0, 1, 2... in the order of by, whose values are distinct. Ranges are numbered in parallel; only the number of
    rows of each range reaches the driver."""
    spark = df.sparkSession
    parts = cut_lineage(df.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "__part int, __start bigint")
    rn = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return parts.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + rn - 1).drop("__part", "__start")


def kgram_index(terms: DataFrame, k: int = 2) -> DataFrame:
    """(kgram, term, df, n_grams) from distinct (term, df); n_grams is the term's number of k-grams."""
    grams = kgrams(F.col("term"), k)
    return terms.select("term", "df", grams.alias("grams")).select(F.explode("grams").alias("kgram"), "term", "df", F.size("grams").alias("n_grams"))


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf, positions, length) and docs(doc_id, name, length); all lazy, built or read.

    A stored index also has its dictionary(term, df, cf) and grams(kgram, term, df, n_grams) of k characters, sorted, so what a
    query's words name is found by the files' statistics; otherwise both are derived from the postings.
    """

    postings: DataFrame
    docs: DataFrame
    dictionary: DataFrame | None = None
    grams: DataFrame | None = None
    k: int = 2
    token_rows: DataFrame | None = None

    @classmethod
    def build(cls, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str | None = None, words: Column | None = None) -> Index:
        """documents need distinct ids; documents without text are in docs with length 0."""
        array = words if words is not None else tokens(F.col(text))
        label = F.col(name) if name else F.concat(F.lit("docs/"), F.col(doc_id).cast("string"))
        docs = documents.select(F.col(doc_id).alias("doc_id"), label.alias("name"), F.size(array).alias("length"))
        words_of = documents.select(F.col(doc_id).alias("doc_id"), array.alias("w"))
        rows = words_of.select("doc_id", F.size("w").alias("length"), F.posexplode("w").alias("pos", "term"))
        return cls(postings_of(rows), docs, token_rows=rows)

    @property
    def terms(self) -> DataFrame:
        """(term, df) of each term."""
        return document_frequency(self.postings) if self.dictionary is None else self.dictionary.select("term", "df")

    def kgrams(self, k: int = 2) -> DataFrame:
        """(kgram, term, df, n_grams), as stored where k is the stored length."""
        return self.grams if self.grams is not None and k == self.k else kgram_index(self.terms, k)

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Parquet: postings sorted by term and document, dictionary by term, k-grams by k-gram. The tokens of an index that is being
        built are placed by ranges of (term, doc_id) at once, so grouping them needs no shuffle of its own."""
        keys = ["term", "doc_id"]
        rows = self.postings.repartitionByRange(*keys) if self.token_rows is None else postings_of(self.token_rows.repartitionByRange(*keys))
        rows.sortWithinPartitions(*keys).write.mode(mode).parquet(f"{path}/postings")
        self.docs.write.mode(mode).parquet(f"{path}/docs")
        spark = self.docs.sparkSession
        # the part just written; earlier ones of an appended index are counted already
        fresh = self.postings if mode == "append" else spark.read.parquet(f"{path}/postings")
        words = fresh.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        words.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")
        words = spark.read.parquet(f"{path}/terms") if mode != "append" else words
        kgram_index(words, self.k).repartitionByRange("kgram", "term").sortWithinPartitions("kgram", "term").write.mode(mode).parquet(f"{path}/kgrams")

    @classmethod
    def read(cls, spark: SparkSession, path: str, in_memory: bool = False) -> Index:
        """A stored index, from its files or kept in memory once read. Parts that were appended are added up; filters on terms and
        k-grams still reach the files."""
        words = spark.read.parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        grams = spark.read.parquet(f"{path}/kgrams").groupBy("kgram", "term", "n_grams").agg(F.sum("df").alias("df"))
        found = cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), words, grams.select("kgram", "term", "df", "n_grams"))
        return found.in_memory() if in_memory else found

    def in_memory(self) -> Index:
        """The index kept by the executors' block managers, for many searches in a row."""
        kept = {c: getattr(self, c).cache() for c in ("postings", "docs", "dictionary", "grams") if getattr(self, c) is not None}
        return replace(self, **kept, token_rows=None)

    def merged(self, other: Index) -> Index:
        """Two partial indexes over different documents; postings are flat, so merging is a union."""
        return Index(self.postings.unionByName(other.postings), self.docs.unionByName(other.docs))

    def lookup(self, term: str) -> DataFrame:
        """A term's postings by document; none if the term is unknown."""
        return self.postings.where(F.col("term") == term).select("doc_id", "tf", "positions").orderBy("doc_id")


def append(index: Index, path: str) -> None:
    """Add a partial index to the one at path, as further files."""
    index.write(path, "append")


def compact(spark: SparkSession, path: str, to: str) -> Index:
    """Rewrite an index of many appended parts into one sorted one at another path, and read that."""
    Index.read(spark, path).write(to)
    return Index.read(spark, to)
