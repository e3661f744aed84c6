"""Resumable runs as streams: new files in, each content processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_per_content(stream: DataFrame, content: str, stamp: str, late: str = "30 days") -> DataFrame:
    """The first delivery of every content within the lateness allowed.

    Deliveries arrive days or weeks late; state is kept by hash and forgotten
    once the watermark has passed, so it does not grow for ever.
    """
    keyed = stream.withColumns({"content_hash": F.sha2(F.coalesce(F.col(content), F.lit("")), 256), stamp: F.col(stamp).cast("timestamp")})
    return keyed.withWatermark(stamp, late).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(stream: DataFrame, stamp: str, key: str, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """``start, key, rows`` of tumbling windows, each given out once its lateness has passed."""
    timed = stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    return timed.groupBy(F.window(stamp, width).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), key, "rows")


def run_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and write it under its number, until no input is left.

    A batch that is repeated after a failure overwrites its own folder, so the
    output holds every batch once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
