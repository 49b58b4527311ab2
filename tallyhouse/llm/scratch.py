"""Shared scratch tables: the way this subpackage cuts lineage.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir`` (a folder that every
executor shares), so that a lost executor costs a re-read and never a recomputation of the plan.
"""

from __future__ import annotations

import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

_WRITTEN: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder named by the session; a private one only where none is set (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes: texts are long, and the default of 10,000 rows a batch is not a bound on memory.

    Also makes sure that Python workers can import this package.
    """
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        told = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        now = int(told[1]) if told else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


#: With this setting Spark removes an execution's shuffle files when it ends, and not only when the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions in this block leave no shuffle files behind. For results that are stored or collected once."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, label: str, compression: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with the same schema. ``scratch_path`` of the result is for ``release``."""
    spark = df.sparkSession
    path = f"{root(spark)}/scratch-{label}-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.options(compression=compression, **options or {}).parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def written() -> list[str]:
    """Paths of all scratch tables and files that are still there, in the order of writing."""
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch tables (all, or those named). Call it once the results that read them are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for one in written() if paths is None else paths:
        if one in _WRITTEN:
            _WRITTEN.remove(one)
            path = jvm.org.apache.hadoop.fs.Path(one)
            path.getFileSystem(conf).delete(path, True)
    tidy(spark)


_BROADCASTS: list = []


def share_value(spark: SparkSession, value: object):
    """Broadcast a value of bounded size; ``destroy_shared`` gives its memory back everywhere."""
    _BROADCASTS.append(spark.sparkContext.broadcast(value))
    return _BROADCASTS[-1]


def shared() -> list:
    """The values that are broadcast at present."""
    return list(_BROADCASTS)


def destroy_shared(values: list | None = None) -> None:
    """Remove broadcast values (all, or those given) from driver and executors. Call it once the results that read them are stored."""
    for one in shared() if values is None else values:
        if one in _BROADCASTS:
            _BROADCASTS.remove(one)
            if one._sc._jsc is not None:  # a stopped application has none left
                one.destroy()


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now: it acts when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def tidy_executors(spark: SparkSession) -> None:
    """Let every executor collect its garbage, which gives unused heap and dropped buffers back to the system.

    A heap grows to what the greediest step needed and stays so; the next step's Python workers need that memory. There
    is a task for each core, so that every executor takes some.
    """
    tasks = spark.sparkContext.defaultParallelism
    collect = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, tasks, 1, tasks).select(collect.alias("done")).write.format("noop").mode("overwrite").save()


@contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """In this block tables are read in batches of ``READ_ROWS`` rows at most: of long texts the usual 4,096 take tens of megabytes of heap a task."""
    before = spark.conf.get(_READ)
    spark.conf.set(_READ, str(min(int(before), READ_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(_READ, before)


#: Rows up to which a batch of a Parquet file is read at once, and Spark's setting for it.
READ_ROWS, _READ = 512, "spark.sql.parquet.columnarReaderBatchSize"
#: Rows of ids up to which a list of ids is broadcast (8 MB); longer ones are joined by shuffle.
BROADCAST_IDS = 1_000_000


def row_key() -> Column:
    """A row's identity: doc_id and text. Rows may share a doc_id."""
    return F.xxhash64("doc_id", "text")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``rows.row``. The keys are counted before they are broadcast."""
    gone = materialize(rows.select(F.col("row").alias("__gone_row")).distinct(), "gone-rows")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.withColumn("__gone_row", row_key()).join(side, "__gone_row", "left_anti").select(*docs.columns)


def key_bitmap(keys: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """One-hash membership bitmap of a column of 64-bit hashes: ``2**bits`` bits at most, whatever the input.

    The bitmap is OR-ed by a partial aggregate, so at most ``2**bits / 64`` rows reach the driver.
    It has no false negatives; the share of false positives is its fill, (distinct keys) / 2**bits at most, and every
    caller follows it by an exact join, so a full bitmap costs time and never changes a result.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    with brief_shuffles(keys.sparkSession):
        words = keys.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return _folded(out, bits)


def _folded(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap with as few bits as keep its fill at 1/128 or less: what is broadcast follows the keys, up to the bound."""
    used = np.flatnonzero(bitmap)
    n = int(np.bitwise_count(bitmap[used]).sum())
    small = max(12, int(n * 128).bit_length())
    if small >= bits:
        return bitmap
    word, bit = np.nonzero(np.unpackbits(bitmap[used].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    place = (used[word] * 64 + bit) >> (bits - small)
    out = np.zeros(1 << (small - 6), dtype=np.uint64)
    np.bitwise_or.at(out, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Boolean array: which of the uint64 ``hashes`` may be members."""
    bits = int(np.log2(len(bitmap))) + 6
    slot = hashes >> np.uint64(64 - bits)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


_ON_EXECUTORS: set[tuple[str, str]] = set()


def ship(spark: SparkSession, content: bytes, label: str) -> str:
    """Put a file of bounded size into the shared folder and on every executor; returns its name for ``SparkFiles.get``.

    The copy in the shared folder stays as long as the application: an executor that starts later fetches
    every file that was added. Equal content is sent once.
    """
    name = f"{label}-{hashlib.sha256(content).hexdigest()[:24]}"
    if (spark.sparkContext.applicationId, name) in _ON_EXECUTORS:
        return name
    path = f"{root(spark)}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    spark.sparkContext.addFile(path if "://" in path or path.startswith("file:") else "file://" + path)
    _ON_EXECUTORS.add((spark.sparkContext.applicationId, name))
    return name
