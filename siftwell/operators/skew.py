"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import shuffle_width

#: A side is only broadcast when it was counted and holds at most this many narrow rows.
BROADCAST_ROWS = 500_000
#: Rows of one key that stay together whatever the size of the join.
HOT_ROWS = 100_000


def is_small(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most bound rows; reads no further than bound + 1 rows."""
    return df.limit(bound + 1).count() <= bound


def checked_broadcast_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", bound: int = BROADCAST_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Join on equal names; how is inner, left, left_semi or left_anti.

    Up to bound rows, small is broadcast and big isn't shuffled. Beyond, the keys that hold more than their share of big's
    rows are spread over salts, as many as their rows ask for, and small's rows of these keys alone are repeated for each;
    all other keys meet plainly. A hot key holds over total / (4 * partitions) rows, so there are at most 4 * partitions of
    them. counts (on, n) says how many rows of big each key has, where that is known. Rows with a null key match nothing
    and are spread too. Salts are hashes of the row and its partition, so a task that runs again gives the same.
    """
    if is_small(small, bound):
        return big.join(F.broadcast(small), on, how)
    spark = big.sparkSession
    width = shuffle_width(spark)
    if counts is None:
        counts = big.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, -(-total // (4 * width)))
    found = counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("__salts")).collect() if total > limit else []
    if not found and how in ("inner", "left_semi"):
        return big.join(small, on, how)
    hot = F.broadcast(spark.createDataFrame(found, T.StructType([*(T.StructField(c, big.schema[c].dataType) for c in on), T.StructField("__salts", T.IntegerType())])))
    none = F.greatest(*(F.col(c).isNull().cast("int") for c in on), F.lit(0)) == 1
    mix = F.xxhash64(*(c for c in big.columns if not isinstance(big.schema[c].dataType, T.MapType)), F.spark_partition_id())
    salts = F.when(none, F.lit(width)).otherwise(F.coalesce(F.col("__salts"), F.lit(1)))
    spread = big.join(hot, on, "left").withColumn("__salt", F.pmod(mix, salts).cast("int")).drop("__salts")
    copies = small.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")


def product_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join on one column of which both sides have many rows: a key makes as many rows as both sides' product. Keys that make
    more than their share are spread over salts: the side with more rows of the key is dealt out, the other repeated. There are at
    most 4 * partitions such keys."""
    if is_small(right):
        return left.join(F.broadcast(right), on)
    spark, width = left.sparkSession, shuffle_width(left.sparkSession)
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("nl")).join(right.groupBy(on).agg(F.count(F.lit(1)).alias("nr")), on)
    counts = counts.withColumn("p", F.col("nl").cast("double") * F.col("nr"))
    limit = max(float(HOT_ROWS), (counts.agg(F.sum("p")).first()[0] or 0.0) / (4 * width))
    found = counts.where(F.col("p") > limit).select(on, F.ceil(F.col("p") / F.lit(limit)).cast("int").alias("__salts"), (F.col("nl") >= F.col("nr")).alias("__deal_left")).collect()
    if not found:
        return left.join(right, on)
    hot = F.broadcast(spark.createDataFrame(found, T.StructType([T.StructField(on, left.schema[on].dataType), T.StructField("__salts", T.IntegerType()), T.StructField("__deal_left", T.BooleanType())])))

    def salted(side: DataFrame, dealt: bool) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64(*side.columns, F.spark_partition_id()), F.col("__salts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("__salts") - 1)
        salts = F.when(F.col("__salts").isNull(), F.array(F.lit(0))).when(F.col("__deal_left") == dealt, one).otherwise(every)
        return side.join(hot, on, "left").withColumn("__salt", F.explode(salts)).drop("__salts", "__deal_left")

    return salted(left, True).join(salted(right, False), [on, "__salt"]).drop("__salt")
