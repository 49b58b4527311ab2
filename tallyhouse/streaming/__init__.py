"""Structured Streaming forms of the monitoring buckets and of the merge by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def volume_buckets(events: DataFrame, time: str, key: str, width: str = "1 day", max_late_seconds: int = 86400, slide: str | None = None) -> DataFrame:
    """(relation, bucket, n) by tumbling (or sliding) windows; the watermark is the measured lateness.

    Works on a stream and on a table alike.
    """
    source = events.withWatermark(time, f"{max_late_seconds} seconds") if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return source.groupBy(window.alias("w"), F.col(key).alias("relation")).agg(F.count("*").alias("n")).select("relation", F.col("w.start").alias("bucket"), "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", max_late_seconds: int = 86400) -> DataFrame:
    """(key, started, ended, n): session windows by key."""
    source = events.withWatermark(time, f"{max_late_seconds} seconds") if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, batch by batch, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def upsert_sink(path: str, keys: list[str], sequence: str) -> Callable[[DataFrame, int], None]:
    """A sink that merges each batch by key into versions of a Parquet table: ``<path>/v=<batch>``.

    A replayed batch writes its version again, so results are exact after a failure.
    """
    from ..operators.relops import last_wins, merge_by_key

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        incoming = last_wins(batch, keys, sequence)
        if epoch:
            incoming = merge_by_key(spark.read.parquet(f"{path}/v={epoch - 1}"), incoming, keys)
        incoming.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return merge
