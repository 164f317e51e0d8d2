"""Structured Streaming forms of two operators (an extension): first event per key, and windowed counts with late data.

Both give their batch equivalents' rows once all files are read with availableNow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The files of a table in a folder, as a stream of its schema."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def first_per_key(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """One event per key; state older than the watermark is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window and key; a window is final once the watermark passes its end."""
    counts = events.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), *by, "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives once all that is available has been read: files in the shared folder, exactly once."""
    spark = stream.sparkSession
    base = shared_folder(spark, f"stream-{name}")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    # A source without files starts no batch: the result is empty, not missing.
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/epoch=-1")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
