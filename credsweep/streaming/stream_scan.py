"""Continuous scanning of arriving documents with Structured Streaming.

Every document is scanned as a whole (all of its lines, split values and
neighbours are inside the document), so a micro-batch can be scanned with
the batch plan and no state is carried between batches.  Output is written
per epoch with overwrite, so a replayed batch after a failure replaces its
own output (effectively exactly-once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scan import scan

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("filename", T.StringType()),
                           T.StructField("text", T.StringType())])


def scan_stream(spark: SparkSession, input_path: str, output_path: str, checkpoint_location: str, fmt: str = "parquet",
                schema: T.StructType = DOC_SCHEMA, available_now: bool = True, **scan_options):
    """Start a streaming scan of (doc_id, filename, text) files under ``input_path``.

    Findings land in ``output_path/epoch=<n>/``.  A restart must name the same
    ``checkpoint_location``: it then goes on with the next epoch, so there is no
    default.  Returns the StreamingQuery.
    """
    stream = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true").load(input_path)
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        found = scan(batch, **scan_options)
        found.write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/epoch={epoch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_findings(spark: SparkSession, output_path: str) -> DataFrame:
    """All findings written by :func:`scan_stream` (``epoch`` column included)."""
    return spark.read.parquet(output_path).withColumn("epoch", F.col("epoch").cast("long"))
