"""An index that grows with a stream of documents: each micro-batch is a partial index, appended; compaction merges them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftwell.operators.index import Index


def document_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def index_stream(documents: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a partial index of every micro-batch below path, one folder for each, so that a batch that runs again replaces
    itself. once: take what is there and end; else go on."""

    def write(batch: DataFrame, number: int) -> None:
        index = Index.build(batch)
        index.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_stream_index(spark: SparkSession, path: str) -> Index:
    """The index of all batches so far."""
    return Index(spark.read.parquet(f"{path}/postings").drop("batch"), spark.read.parquet(f"{path}/docs").drop("batch"))


def counts_by_window(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Arrivals per window and key of a stream, with late rows let in until the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).count()
