"""A stage of the pipeline starts on heaps without the garbage of what ran before, and reads long texts in small batches."""

import corpus_pipeline
from tallyhouse.llm import scratch


def _collections(spark) -> int:
    """Collections of the whole heap so far; in local mode the executor is this JVM."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_a_stage_starts_after_a_collection(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, rows = _collections(spark), spark.conf.get(scratch._READ)
    corpus_pipeline.language(spark, docs, data)
    assert _collections(spark) > before
    assert spark.conf.get(scratch._READ) == rows


def test_small_reads_are_never_larger_than_asked_for(spark):
    before = spark.conf.get(scratch._READ)
    try:
        for now, most in (("4096", "512"), ("100", "100")):
            spark.conf.set(scratch._READ, now)
            with scratch.small_reads(spark):
                assert spark.conf.get(scratch._READ) == most
            assert spark.conf.get(scratch._READ) == now
    finally:
        spark.conf.set(scratch._READ, before)
