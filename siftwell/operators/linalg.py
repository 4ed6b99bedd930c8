"""Sparse linear algebra: matrices are (i, j, v), vectors (i, v); cells that aren't there are 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.skew import checked_broadcast_join, product_join
from siftwell.session import ship_package

#: Vectors in a block of a matrix product.
BLOCK_VECTORS = 1024


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """matrix * vector, (i, v)."""
    x = vector.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return checked_broadcast_join(matrix, x, ["j"]).groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def left_spmv(vector: DataFrame, matrix: DataFrame) -> DataFrame:
    """vector * matrix, (i, v)."""
    return spmv(transpose(matrix), vector)


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """a * b without cells that are 0."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return product_join(left, right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")).where("v <> 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """a + factor * b, with every cell of either."""
    both = a.select("i", "j", "v").unionAll(b.select("i", "j", (F.col("v") * factor).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1.0)


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * factor)


def total(a: DataFrame) -> DataFrame:
    """One row: the sum of all cells, 0 for an empty matrix."""
    return a.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the Euclidean distance of two matrices."""
    return subtract(a, b).agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("distance"))


def normalise_rows(a: DataFrame, norm: str = "l1") -> DataFrame:
    """Rows divided by the sum of their cells' sizes (l1) or their Euclidean length (l2); rows of 0 stay 0."""
    size = F.sum(F.abs("v")) if norm == "l1" else F.sqrt(F.sum(F.col("v") * F.col("v")))
    sizes = a.groupBy("i").agg(size.alias("size"))
    return a.join(sizes, "i").select("i", "j", F.coalesce(F.try_divide(F.col("v"), F.col("size")), F.lit(0.0)).alias("v"))


def normalise_vector(a: DataFrame, norm: str = "l2") -> DataFrame:
    """A vector divided by its length; a vector of 0 stays 0."""
    size = F.sum(F.abs("v")) if norm == "l1" else F.sqrt(F.sum(F.col("v") * F.col("v")))
    length = F.broadcast(a.agg(size.alias("size")))  # one row
    return a.join(length).select("i", F.coalesce(F.try_divide(F.col("v"), F.col("size")), F.lit(0.0)).alias("v"))


def filled(spark, m: int, n: int, value: float) -> DataFrame:
    """An m by n matrix of one value."""
    return spark.range(m * n).select(F.expr(f"id div {n}").alias("i"), F.expr(f"id % {n}").alias("j"), F.lit(float(value)).alias("v"))


def dot(a: Column, b: Column) -> Column:
    """The product of two dense vectors (arrays)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """dot over both lengths; null where one is 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _blocks(vectors: DataFrame, key: str, vector: str, ids: str, values: str) -> DataFrame:
    """Rows of at most BLOCK_VECTORS vectors or so; a block is a hash of the key, so no number of vectors is collected in one."""
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and v is not null")
    n = max(1, -(-rows.count() // BLOCK_VECTORS))
    block = F.pmod(F.xxhash64("k"), F.lit(n)).alias("b")
    return rows.groupBy(block).agg(F.collect_list(F.struct("k", "v")).alias("x")).select(F.col("x.k").alias(ids), F.col("x.v").alias(values))


def vector_products(queries: DataFrame, vectors: DataFrame, key: str, vector: str, unit: bool = False) -> DataFrame:
    """(query, key, v): the dot product of each query's vector with each vector, or with unit the cosine (null where a length is 0).

    A block of queries meets a block of vectors and one matrix product gives all their values, so neither side is broadcast or held whole
    and a task holds two blocks. Rows with a null key or vector are left out; all vectors need one length.
    """
    ship_package(vectors.sparkSession)
    pairs = _blocks(queries, key, vector, "q_ids", "q").crossJoin(_blocks(vectors, key, vector, "ids", "x"))  # a row for each two blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids = batch.column(0)[i].values, batch.column(2)[i].values
                q, x = (np.array(batch.column(c)[i].values.flatten()).reshape(len(n), -1) for c, n in ((1, q_ids), (3, ids)))
                v = q @ x.T
                if unit:
                    lengths = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
                    v = np.divide(v, lengths, out=np.full_like(v, np.nan), where=lengths > 0)
                for r in range(len(q_ids)):
                    columns = [pa.array(q_ids).take(pa.array(np.full(len(ids), r))), ids, pa.array(v[r], mask=np.isnan(v[r]) if unit else None)]
                    yield pa.RecordBatch.from_arrays(columns, ["query", key, "v"])

    kind = vectors.schema[key].dataType.simpleString()
    return pairs.mapInArrow(run, f"query {kind}, {key} {kind}, v double")
