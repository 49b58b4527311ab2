"""Late and repeated data: streams whose watermark waits as long as rows were measured to be late.

``measured_delay`` is the most seconds that any row of a table arrived after its own time (``quality.lateness``), rounded
up. A watermark that trails the newest row time by that much never passes a row that is still to come, so nothing is
dropped; state for a bucket or an identifier is kept that long and no longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quality import lateness
from ..session import shared_folder
from . import drain
from .merge import Folder


def measured_delay(rows: DataFrame, event: str, arrival: str) -> int:
    """Seconds, at least 1, that a watermark on ``event`` has to wait for the rows of this table."""
    late = lateness(rows, event, arrival).first()["max_late_seconds"]
    return max(1, (late or 0) + 1)


def in_arrivals(rows: DataFrame, arrival: str, n: int, handle: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Play a table as a stream: its rows land in ``n`` equal spans of arrival time, and after each span the stream is drained.

    All drains share one checkpoint, so state goes on from one to the next as after a restart.
    """
    spark = rows.sparkSession
    folder, state = shared_folder(spark, "landing"), shared_folder(spark, "stream-state")
    lo, hi = rows.agg(F.min(F.unix_micros(arrival)), F.max(F.unix_micros(arrival))).first()
    if lo is None:
        return
    span = F.least(F.floor((F.unix_micros(arrival) - lo) * n / (hi - lo + 1)), F.lit(n - 1))
    landing = Folder(spark, folder)
    for k in range(n):
        rows.where(span == k).write.mode("append").parquet(folder)
        drain(handle(spark.readStream.schema(rows.schema).parquet(folder)), sink, state, mode)
    landing.delete("")
    Folder(spark, state).delete("")


def without_redelivery(stream: DataFrame, event: str, identity: list[str], delay: int) -> DataFrame:
    """The first delivery of each identity. An identity is forgotten ``delay`` seconds of row time after its row."""
    return stream.withWatermark(event, f"{delay} seconds").dropDuplicatesWithinWatermark(identity)


def closed_buckets(stream: DataFrame, event: str, key: str, width: str) -> DataFrame:
    """(relation, bucket, n) of buckets that no row can reach any more; the watermark must be set. A table closes all of its buckets."""
    counted = stream.groupBy(F.window(event, width).alias("w"), F.col(key).alias("relation")).agg(F.count("*").alias("n"))
    return counted.select("relation", F.col("w.start").alias("bucket"), "n")


class _PunctualityOfBucket(StatefulProcessor):
    """For each (key, bucket): rows, and rows that arrived after the bucket's end; told once, when the watermark has passed the end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, late long, worst long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, late, worst = self.seen.get() if self.seen.exists() else (0, 0, 0)
        for some in rows:
            if some.empty:
                continue
            wait = (some["arrival_s"] - int(key[1])).clip(lower=0)
            n, late, worst = n + len(some), late + int((wait > 0).sum()), max(worst, int(wait.max()))
        new = not self.seen.exists()
        self.seen.update((n, late, worst))
        if new:
            self.handle.registerTimer(int(key[1]) * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, late, worst = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"relation": [key[0]], "ends": [int(key[1])], "n": [n], "n_late": [late], "worst_seconds": [worst]})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this block keep their state in RocksDB, outside the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def punctuality(stream: DataFrame, event: str, arrival: str, key: str, seconds: int) -> DataFrame:
    """(relation, ends, n, n_late, worst_seconds) of each bucket of ``seconds``, once its end is behind the watermark.

    ``ends`` is the end in seconds (columns of the processor must not begin with an underscore); a row is late if it arrived after it. State is three numbers for each open bucket.
    The watermark must be set on ``event``; needs the RocksDB state store.
    """
    ends = (F.floor(F.unix_seconds(event) / seconds) + 1) * seconds
    rows = stream.withColumns({"ends_s": ends, "arrival_s": F.unix_seconds(arrival)}).select(event, F.col(key).alias("key_of"), "ends_s", "arrival_s")
    return rows.groupBy("key_of", "ends_s").transformWithStateInPandas(
        statefulProcessor=_PunctualityOfBucket(), outputStructType="relation string, ends long, n long, n_late long, worst_seconds long", outputMode="Append", timeMode="EventTime"
    )
