"""Blocks that arrive as files, recovered document by document.

An extension: recovery rules need all pages of a document, so files of whole
documents are the unit of work.  Each micro-batch is recovered like a table and
written under its batch number, so that a batch that runs again replaces its
own output.  Arrival counts use event time and a watermark.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.recovery import Recovery


def read_blocks(spark: SparkSession, folder: str, schema: StructType, *, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def recover_stream(stream: DataFrame, doc_ir: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Elements of the documents of each batch, in a folder for each batch; runs until what is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        Recovery(batch, doc_ir, **options).elements.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, *, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Blocks that arrived per site and day; rows later than the watermark are left out of closed days."""
    return stream.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window), "site").agg(F.count("block_id").alias("blocks"), F.approx_count_distinct("doc_id").alias("documents"))
