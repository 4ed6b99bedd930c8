"""Frequencies of terms and how distinctive a term is of a record, over postings (term id, record id, occurrences)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.skew import checked_broadcast_join

#: Record ids in one container, and in one word of a bitmap. A container holds offsets of two bytes.
CONTAINER = 4096
WORD_BITS = 64


def valid_rows(postings: DataFrame, token_index: DataFrame, doc_info: DataFrame) -> DataFrame:
    """(token, doc_id, tf): postings whose token_id is in token_index and whose doc_id is in doc_info. Rows that repeat count once;
    a token of several ids may have several rows for a document. Rows with a null id, and tokens that are null, are left
    out; a null tf counts 0."""
    names = token_index.select("token", "token_id").dropna().distinct()
    known = doc_info.select("doc_id").dropna().distinct()
    rows = postings.select("token_id", "doc_id", "tf").dropna(subset=["token_id", "doc_id"]).distinct()
    rows = checked_broadcast_join(rows, names, ["token_id"])
    rows = checked_broadcast_join(rows, known, ["doc_id"], "left_semi")
    return rows.select("token", "doc_id", F.coalesce("tf", F.lit(0)).alias("tf"))


def valid_postings(postings: DataFrame, token_index: DataFrame, doc_info: DataFrame) -> DataFrame:
    """(token, doc_id, tf): valid_rows with one row for each token and document and the sum of tf."""
    return valid_rows(postings, token_index, doc_info).groupBy("token", "doc_id").agg(F.sum("tf").alias("tf"))


def term_containers(postings: DataFrame, term: str = "token", record: str = "doc_id", count: str = "tf") -> DataFrame:
    """The vertical layout: a row for each term and each CONTAINER record ids in which it has any: (term, container, kind, offsets, runs,
    words, records, occurrences).

    Containers grow where the postings are and merge by union, before and after the shuffle, the occurrences beside them; a
    record that comes again, under another id of the term or in another part, is held once. records is the cardinality.
    Each container is kept in the smallest of three forms, kind says which, and the other two are null: 'array', the
    ascending offsets, 2 bytes each; 'run', first and last offsets of runs, 4 bytes a run; 'bitmap', a bit for each id.
    Rows with a null term or record are left out; a null count is 0.
    """
    record_id = F.col(record).cast("bigint")
    offset = F.pmod(record_id, F.lit(CONTAINER)).cast("smallint")
    held = postings.where(F.col(term).isNotNull() & record_id.isNotNull()).groupBy(F.col(term).alias("term"), F.floor(record_id / F.lit(CONTAINER)).alias("container"))
    held = held.agg(F.sort_array(F.collect_set(offset)).alias("held"), F.sum(F.coalesce(F.col(count).cast("bigint"), F.lit(0))).alias("occurrences"))
    first = F.filter("held", lambda x, i: (i == 0) | (F.get("held", i - 1) < x - 1))
    last = F.filter("held", lambda x, i: (i == F.size("held") - 1) | (F.get("held", i + 1) > x + 1))
    bits = lambda w: F.aggregate(
        F.filter("held", lambda x: x.cast("int").bitwiseAND(F.lit(CONTAINER - WORD_BITS)) == w * WORD_BITS), F.lit(0).cast("bigint"),
        lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.cast("int").bitwiseAND(F.lit(WORD_BITS - 1)))),
    )
    n, by_runs = 2 * F.size("held"), 4 * F.size(first)
    kind = F.when((n <= by_runs) & (n <= CONTAINER // 8), "array").when(by_runs <= CONTAINER // 8, "run").otherwise("bitmap")
    return held.withColumn("kind", kind).select(
        "term", "container", "kind",
        F.when(F.col("kind") == "array", F.col("held")).alias("offsets"),
        F.when(F.col("kind") == "run", F.arrays_zip(first.alias("first"), last.alias("last"))).alias("runs"),
        F.when(F.col("kind") == "bitmap", F.transform(F.sequence(F.lit(0), F.lit(CONTAINER // WORD_BITS - 1)), bits)).alias("words"),
        F.size("held").cast("bigint").alias("records"), "occurrences",
    )


def record_count(postings: DataFrame, record: str = "doc_id") -> DataFrame:
    """One row (total): the records with any term, from the union of all bitmaps."""
    record_id = F.col(record).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(record_id, F.lit(WORD_BITS)).cast("int"))
    union = postings.where(record_id.isNotNull()).groupBy(F.floor(record_id / F.lit(WORD_BITS)).alias("word_no")).agg(F.bit_or(bit).alias("word"))
    return union.agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).alias("total"))


def term_frequencies(containers: DataFrame, total: DataFrame, rare_records: int = 1, common_share: float = 0.6) -> DataFrame:
    """(term, occurrences, records, mark): records is the cardinality of the term's containers. mark is 'rare' up to rare_records
    records, 'common' above common_share of the total records (one row), 'rare' if both, else 'useful'. No postings give
    no rows."""
    each = containers.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("total"), "common").otherwise("useful")
    return each.join(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))  # total is one row


def distinctiveness(postings: DataFrame, records: DataFrame | None = None, term: str = "token", record: str = "doc_id", count: str = "tf") -> DataFrame:
    """How characteristic each term is of each record, by residual inverse document frequency.

    (record, term, tf, df, cf, ridf, residual, score): df is the number of records with the term, cf its occurrences, N the
    number of records with any term. A term whose cf occurrences fell on records at random would stand in
    N * (1 - exp(-cf / N)) of them. residual is the observed inverse frequency N / df minus the one so expected, 0 at
    least, and score = tf * residual. ridf is the difference of the two logarithms, the usual form, for
    comparison: where records are in several languages it isn't fit for the score, as the common words of one language
    stand in much fewer records than chance has it and outweigh rare terms by their number in a record.

    postings has one row for each term and record; records (a set of ids in its first column) limits the records that come
    out, not those counted. Occurrences below 1 count 0; a term in all records scores 0.
    """
    rows = postings.select(F.col(term).alias("term"), F.col(record).alias("record"), F.greatest(F.coalesce(F.col(count), F.lit(0)), F.lit(0)).cast("bigint").alias("tf"))
    rows = rows.where(F.col("term").isNotNull() & F.col("record").isNotNull() & (F.col("tf") > 0))
    n = F.broadcast(rows.select("record").distinct().agg(F.count(F.lit(1)).cast("double").alias("n")))  # one row
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).join(n)
    observed, expected = F.col("n") / F.col("df"), -1 / F.expm1(-F.col("cf") / F.col("n"))
    residual = F.greatest(observed - expected, F.lit(0.0))
    terms = terms.select("term", "df", "cf", (F.log2(observed) - F.log2(expected)).alias("ridf"), residual.alias("residual"))
    if records is not None:
        wanted = records.select(F.col(records.columns[0]).alias("record")).dropna().distinct()
        rows = checked_broadcast_join(rows, wanted, ["record"], "left_semi")
    scored = checked_broadcast_join(rows, terms, ["term"])
    return scored.select("record", "term", "tf", "df", "cf", "ridf", "residual", (F.col("tf") * F.col("residual")).alias("score"))


def most_distinctive(scores: DataFrame, k: int = 1) -> DataFrame:
    """The k highest scores of each record, ties by term."""
    best = F.row_number().over(Window.partitionBy("record").orderBy(F.desc("score"), "term"))
    return scores.withColumn("place", best).where(F.col("place") <= k)
