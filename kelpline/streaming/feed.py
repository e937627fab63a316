"""A change feed as a stream: micro-batches applied to a keyed table, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpline.operators.change_feed import KeyedTable


def read_feed(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_stream(feed: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch as one commit. A batch that is replayed after a failure changes nothing the
    second time, as the newest change of a key stays the same; so the result is exact with at-least-once batches."""
    def batch(df: DataFrame, _: int) -> None:
        table.apply(df)

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_rates(feed: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Inserts and deletes per shard and window of arrival; rows later than ``late`` fall out of the state.
    Rows without an arrival time are in no window."""
    timed = feed.where("arrived_at IS NOT NULL").withColumn("at", F.col("arrived_at").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", window), "shard").agg(
        F.count_if(~F.coalesce("is_delete", F.lit(False))).alias("n_puts"), F.count_if("is_delete").alias("n_deletes"))
