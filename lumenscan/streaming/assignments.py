"""Scans of a growing folder of texts: the batch operators on a stream. An extension; a tree is a batch otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenscan.operators import keys


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(rel, text) rows of Parquet files as they land in path."""
    return spark.readStream.schema("rel string, text string").parquet(path)


def scan_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the key-named assignments of each micro-batch to out, exactly once by batch folder; all that has landed is read, then the query ends."""

    def write(batch: DataFrame, epoch: int) -> None:
        keys.assignments(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
