"""References to records that do not exist.

Parents are lives of keys: (key, from, to). In the order of (key, time) a life is an interval, and a key that has always
been there and is never removed reaches exactly to the next key. So sorted lives collapse into few runs: 4, 5 and 6, always
there, become the single run from 4 to 7. A reference is one point (key, time); it is matched as-of to the last run that
starts at or before it, and is an orphan if it lies beyond that run's end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.index import dense_ids
from siftwell.operators.skew import checked_broadcast_join
from siftwell.session import cut_lineage

#: Consecutive integer keys that share a bucket; runs are built and searched within a bucket.
BUCKET_KEYS = 4096
#: Buckets of keys that aren't integers.
TEXT_BUCKETS = 1 << 16
#: Buckets of references above max(HOT_ROWS, total / HOT_SHARE) are split, hence at most HOT_SHARE buckets are.
HOT_ROWS = 500_000
HOT_SHARE = 2000

#: Text keys that are broadcast at most, as they may be long.
NAMES = 50_000

_BEGIN = "timestamp_ntz'0001-01-01 00:00:00'"
_LAST_KEY = 9223372036854775807


@dataclass(frozen=True)
class References:
    """One referring table: its name in the report, its row id, key and time columns, and the parents its keys live in."""

    table: str
    rows: DataFrame
    row_id: str
    key: str | Column
    time: str
    parents: str


@dataclass(frozen=True)
class Parents:
    """One referred table: its name, key column, and the columns of a life's first and first missing moment."""

    name: str
    rows: DataFrame
    key: str | Column
    added: str
    deleted: str


def numbered(refs: References, parents: Parents) -> tuple[References, Parents]:
    """refs and parents with the parents' text keys numbered 0, 1, 2... in their order, so that keys have neighbours and runs hold many.

    Keys compare as they are spelt. A reference whose key no parent has gets no number and stays an orphan; a null key stays
    null. Keys are numbered in ranges, and hot keys are spread in the joins that put the numbers to the rows.
    """
    rows = parents.rows.select(_col(parents.key).alias("name"), _col(parents.added).alias("added"), _col(parents.deleted).alias("deleted"))
    numbers = dense_ids(rows.select("name").dropna().distinct(), "name", "number").select("name", F.col("number").cast("string").alias("number"))
    numbers = cut_lineage(numbers)
    lives = checked_broadcast_join(rows, numbers, ["name"], bound=NAMES)
    points = refs.rows.select(_col(refs.key).alias("name"), _col(refs.row_id).alias("row_id"), _col(refs.time).alias("time"))
    points = checked_broadcast_join(points, numbers, ["name"], "left", NAMES)
    key = F.coalesce("number", F.concat(F.lit("?"), F.col("name")))
    return References(refs.table, points, "row_id", key, "time", refs.parents), Parents(parents.name, lives, "number", "added", "deleted")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _int_part(key: Column) -> Column:
    """Keys of up to 18 digits are integers whatever blanks and zeros stand before them; others sort behind, by text."""
    return F.when(key.rlike(r"^\s*[0-9]{1,18}\s*$"), key.try_cast("bigint")).otherwise(F.lit(_LAST_KEY))


def _keyed(df: DataFrame, key: Column, keep: list[Column]) -> DataFrame:
    """keep plus k (integer part), s (text part) and the bucket. All three compare as the key does."""
    df = df.select(_int_part(key).alias("k"), key.alias("raw"), *keep).where(F.col("raw").isNotNull())
    text = F.when(F.col("k") == _LAST_KEY, F.col("raw")).otherwise(F.lit(""))
    bucket = F.when(F.col("k") == _LAST_KEY, F.pmod(F.xxhash64("raw"), F.lit(TEXT_BUCKETS))).otherwise(F.expr(f"k div {BUCKET_KEYS}"))
    return df.withColumn("s", text).withColumn("bucket", bucket).drop("raw")


def _point(k: Column, s: Column, t: Column) -> Column:
    return F.struct(k.alias("k"), s.alias("s"), t.alias("t"))


def parent_runs(parents: list[Parents]) -> DataFrame:
    """Runs (dom, bucket, start, stop) over all parents. Of each table there are two domains: name + '@' holds the lives,
    name + '#' holds each key for all times, for references without a time.

    Lives with a null key or with deleted <= added are void; repeated and overlapping lives merge. Merging goes in two
    steps, first by year of the start, so that a key with very many lives is first thinned out in parallel.
    """
    lives = None
    for p in parents:
        one = _keyed(p.rows, _col(p.key), [_col(p.added).cast("timestamp_ntz").alias("a"), _col(p.deleted).cast("timestamp_ntz").alias("z")])
        kinds = F.explode(F.array(F.lit("@"), F.lit("#"))).alias("kind")
        one = one.select("k", "s", "bucket", "a", "z", kinds)
        known = F.col("kind") == "@"
        one = one.select(
            F.concat(F.lit(p.name), F.col("kind")).alias("dom"), "bucket", "k", "s",
            F.when(known, F.col("a")).alias("a"), F.when(known, F.col("z")).alias("z"),
        ).distinct()
        lives = one if lives is None else lives.unionAll(one)
    begin = F.expr(_BEGIN)
    starts = F.coalesce(F.col("a"), begin)
    lives = lives.where(F.col("z").isNull() | (starts < F.col("z")))
    next_k = F.when(F.col("k") == _LAST_KEY, F.col("k")).otherwise(F.col("k") + 1)
    next_s = F.when(F.col("k") == _LAST_KEY, F.concat("s", F.lit("\0"))).otherwise(F.lit(""))
    stop = F.when(F.col("z").isNull(), _point(next_k, next_s, begin)).otherwise(_point(F.col("k"), F.col("s"), F.col("z")))
    runs = lives.select("dom", "bucket", F.year(starts).alias("slot"), _point(F.col("k"), F.col("s"), starts).alias("start"), stop.alias("stop"))
    for by in (["dom", "bucket", "slot"], ["dom", "bucket"]):
        runs = _merged(runs, by)
    return runs


def _merged(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs of one group that touch or overlap become one."""
    order = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    runs = runs.withColumn("__opens", opens).withColumn("__run", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__run")


def orphan_references(references: list[References], parents: list[Parents]) -> DataFrame:
    """Each reference that no parent covers: (ref_table, period, row_id), distinct.

    A life covers a time t if added is null or <= t, and deleted is null or > t. A reference without a time is an orphan
    only if its key has no row at all. References with a null key are no references and never come out. period is 'YYYY-MM'
    of the time or 'unknown'. Rows that repeat come out once; a reference into a table without rows is an orphan; other
    columns of the inputs don't matter. Keys compare without blanks around and, if digits, without leading zeros.

    One shuffle of the references: buckets of the key order with more than their share of references are split by salt,
    and the (few, merged) runs of such a bucket are repeated for each split.
    """
    runs = parent_runs(parents)
    points = None
    for r in references:
        one = _keyed(r.rows, _col(r.key), [_col(r.row_id).cast("bigint").alias("row_id"), _col(r.time).cast("timestamp_ntz").alias("t")])
        dom = F.when(F.col("t").isNull(), F.lit(r.parents + "#")).otherwise(F.lit(r.parents + "@"))
        one = one.select(F.lit(r.table).alias("ref_table"), dom.alias("dom"), "bucket", "k", "s", "t", "row_id")
        points = one if points is None else points.unionAll(one)
    spark = runs.sparkSession
    counts = points.groupBy("dom", "bucket").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    target = max(HOT_ROWS, -(-total // HOT_SHARE))
    slots = F.lit(1)
    if total > target:
        hot = counts.where(F.col("count") > target).collect()  # at most HOT_SHARE rows, as each holds over total / HOT_SHARE
        if hot:
            size = spark.createDataFrame([(h["dom"], h["bucket"], -(-h["count"] // target) * 2) for h in hot], "dom string, bucket bigint, slots bigint")
            points = points.join(F.broadcast(size), ["dom", "bucket"], "left")
            runs = runs.join(F.broadcast(size), ["dom", "bucket"], "left")
            slots = F.coalesce(F.col("slots"), F.lit(1))
    begin = F.expr(_BEGIN)
    salt = F.pmod(F.xxhash64("row_id", "t"), slots)
    points = points.select(
        "dom", "bucket", salt.alias("salt"), _point(F.col("k"), F.col("s"), F.coalesce(F.col("t"), begin)).alias("at"),
        F.lit(1).alias("is_ref"), F.lit(None).cast(runs.schema["stop"].dataType).alias("stop"), "ref_table", "row_id", "t",
    )
    runs = runs.select(
        "dom", "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), (slots - 1).cast("bigint"))).alias("salt"), F.col("start").alias("at"),
        F.lit(0).alias("is_ref"), "stop", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("bigint").alias("row_id"), F.lit(None).cast("timestamp_ntz").alias("t"),
    )
    order = Window.partitionBy("dom", "bucket", "salt").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = points.unionByName(runs).withColumn("run_stop", F.last("stop", ignorenulls=True).over(order))
    missing = F.col("run_stop").isNull() | (F.col("at") >= F.col("run_stop"))
    period = F.coalesce(F.date_format("t", "yyyy-MM"), F.lit("unknown"))
    return matched.where((F.col("is_ref") == 1) & missing).select("ref_table", period.alias("period"), "row_id").distinct()


def orphan_report(orphans: DataFrame, references: list[References]) -> DataFrame:
    """Per referring table and period: (ref_table, period, n_refs, n_orphans). n_refs counts distinct row ids with a key."""
    seen = None
    for r in references:
        one = r.rows.select(F.lit(r.table).alias("ref_table"), F.coalesce(F.date_format(_col(r.time).cast("timestamp_ntz"), "yyyy-MM"), F.lit("unknown")).alias("period"), _col(r.row_id).alias("row_id"), _col(r.key).alias("k"))
        one = one.where(F.col("k").isNotNull()).select("ref_table", "period", "row_id").distinct()
        seen = one if seen is None else seen.unionAll(one)
    both = seen.withColumn("o", F.lit(0)).unionAll(orphans.select("ref_table", "period", "row_id").withColumn("o", F.lit(1)))
    return both.groupBy("ref_table", "period").agg(F.sum(1 - F.col("o")).alias("n_refs"), F.sum("o").cast("bigint").alias("n_orphans"))
