"""Call lists that arrive over time, read as a stream and merged into a table of distinct calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lociforge.sources.files import _stem

WATERMARK = "7 days"


def stream_call_lists(spark: SparkSession, folder: str) -> DataFrame:
    """``(seq_id, marker, arrived)`` of the call files that appear in a folder, ``arrived`` being the file's time."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_modification_time").alias("arrived"), _stem(F.col("_metadata.file_path")).alias("seq_id"), F.btrim(F.get(F.split("value", "\t"), F.lit(0))).alias("marker"))
    return lines.filter("marker <> ''")


def distinct_calls(calls: DataFrame, time: str = "arrived", watermark: str = WATERMARK) -> DataFrame:
    """Each call once within the watermark; the state of calls older than that is dropped, so it doesn't grow for ever."""
    return calls.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["seq_id", "marker"])


def keep_calls(calls: DataFrame, table_path: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Append each batch to a Parquet table, one folder a batch, so that a repeated batch replaces itself.

    ``after`` gets the whole table after each batch, for instance to cluster again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        if after is not None:
            after(batch.sparkSession.read.parquet(table_path))

    writer = calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
