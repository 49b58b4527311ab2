"""Sharding by sampled splitters (DataFrame functions only).

Records are ordered by (hash of the text, doc_id), so equal texts are neighbours. A size-weighted
sample of the hashes gives quantile boundaries; records are range-partitioned by them; ranges that
hold more than twice their share (a hot group of equal texts) are subdivided by a hash of doc_id.
Exact byte counts of the ranges, a table bounded by the number of ranges, turn each range's own
running sum into a position on the byte axis, which is cut into equal shards.

Law ``bytes``: shard sizes differ from the mean by about one document or 1 % of a shard at most.

Defined results: a null text has size 1 and the checksum of the empty text; repeated rows are placed
one by one; a null doc_id sorts first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Bytes that one range may hold at most on average, so that a range always fits one task.
RANGE_BYTES = 64 << 20
LEAST_RANGES, MOST_RANGES, DRAWS_PER_RANGE = 512, 65536, 32


def splitters(light: DataFrame, total: int, ranges: int, seed: int = 17) -> list[int]:
    """Quantile boundaries of ``h`` from a size-weighted sample of about ``DRAWS_PER_RANGE * ranges`` draws."""
    expected = F.col("size") * F.lit(ranges * DRAWS_PER_RANGE / total)
    uniform = F.shiftrightunsigned(F.xxhash64("h", "doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = light.select("h", (F.floor(expected) + (uniform < expected - F.floor(expected)).cast("int")).alias("draws")).where("draws > 0")
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = drawn.agg(F.percentile("h", at, F.col("draws")).alias("q")).first()["q"]
    return sorted({int(x) for x in found or []})


def _with_range(light: DataFrame, bounds: list[int]) -> DataFrame:
    """Column ``range``: the number of bounds at most ``h``, found in a cell table of fixed size."""
    cells, k = [], 0
    for cell in range(-2048, 2048):
        top, base = (cell + 1) << 52, k
        while k < len(bounds) and bounds[k] < top:
            k += 1
        cells.append((cell, base, bounds[base:k]))
    table = light.sparkSession.createDataFrame(cells, "cell int, base int, inner array<bigint>")
    placed = light.join(F.broadcast(table), F.shiftright("h", 52).cast("int") == F.col("cell"))
    return placed.withColumn("range", F.col("base") + F.size(F.filter("inner", lambda x: x <= F.col("h")))).drop("cell", "base", "inner")


def assign_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = materialize(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h")),
        "shard-keys",
    )
    total = light.agg(F.sum("size")).first()[0]
    law = F.lit("bytes").alias("law")
    if not total:
        return light.select("doc_id", "size", "text_crc32", law, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-total // RANGE_BYTES)))
    ranged = _with_range(light, splitters(light, total, ranges))
    spark = docs.sparkSession

    # Overfull ranges are subdivided: both tables below have a few rows for each range at most.
    share = total / ranges
    heavy = [(r["range"], int(r["b"] // share)) for r in ranged.groupBy("range").agg(F.sum("size").alias("b")).where(F.col("b") > 2 * share).collect()]
    subs = spark.createDataFrame(heavy, "range int, parts int")
    cut = ranged.join(F.broadcast(subs), "range", "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    before, rows, offsets = 0, 0, []
    for r in sorted(cut.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect(), key=lambda r: (r["range"], r["sub"])):
        offsets.append((r["range"], r["sub"], before, rows))
        before, rows = before + r["b"], rows + r["n"]
    own = Window.partitionBy("range", "sub").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "sub", "h")
    placed = (
        cut.join(F.broadcast(spark.createDataFrame(offsets, "range int, sub int, byte_off bigint, row_off bigint")), ["range", "sub"])
        .withColumn("from", F.col("byte_off") + F.sum("size").over(own) - F.col("size"))
        .withColumn("row", F.col("row_off") + F.count("*").over(own) - 1)
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_from", F.min("from").over(group))
    )
    # A small group of equal texts goes where its middle lies; a larger one is cut row by row.
    whole = F.col("group_bytes") * 100 * n_shards <= F.lit(total)
    twice = F.when(whole, 2 * F.col("group_from") + F.col("group_bytes")).otherwise(2 * F.col("from") + F.col("size"))
    shard = F.least(F.floor(twice.cast("decimal(38,0)") * n_shards / (2 * total)), F.lit(n_shards - 1)).cast("int")
    placed = materialize(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"), "shards")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", law, "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Store ``docs`` as one folder a shard. ``doc_id`` must be unique here."""
    docs.join(assigned.select("doc_id", "shard"), "doc_id").write.partitionBy("shard").parquet(path)
