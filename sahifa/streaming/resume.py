"""A stream of records into a table that holds each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls


def read_articles(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def keep_new(stream: DataFrame, key: str, time: str | None = None, late: str = "30 days") -> DataFrame:
    """Rows whose normal address was not seen. With an event time the state is dropped when rows cannot be that late any more; without one it is kept for good."""
    keyed = stream.withColumn("key", urls.normalize(F.col(key))).where("key is not null")
    if time is None:
        return keyed.dropDuplicates(["key"])
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["key"])


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch as JSON lines once: a batch that is run again after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, time: str, late: str = "2 hours") -> DataFrame:
    """Records per hour of an event time, late ones within the watermark counted where they belong."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("records"))
