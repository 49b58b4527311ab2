"""Volume, cadence, staleness and coverage of relations over time."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def latest_buckets(volumes: DataFrame) -> DataFrame:
    """relation, bucket, n out of re-recorded buckets (relation, bucket, n, updated_at): the newest record of each counts."""
    window = Window.partitionBy("relation", "bucket").orderBy(F.col("updated_at").desc(), F.col("n").desc())
    return volumes.withColumn("k", F.row_number().over(window)).where("k = 1").drop("k", "updated_at")


def volume_change(buckets: DataFrame) -> DataFrame:
    """relation, buckets, last_n, prior_n, change (signed share), state: ``one_bucket`` is no answer."""
    window = Window.partitionBy("relation").orderBy(F.col("bucket").desc())
    ranked = buckets.withColumn("k", F.row_number().over(window)).withColumn("buckets", F.count("*").over(Window.partitionBy("relation")))
    told = ranked.where("k <= 2").groupBy("relation").agg(F.max("buckets").alias("buckets"), F.max(F.when(F.col("k") == 1, F.col("n"))).alias("last_n"), F.max(F.when(F.col("k") == 2, F.col("n"))).alias("prior_n"))
    change = F.when(F.col("prior_n") > 0, (F.col("last_n") - F.col("prior_n")) / F.col("prior_n"))
    return told.withColumn("change", change).withColumn("state", F.when(F.col("buckets") == 1, "one_bucket").otherwise("compared"))


def cadence(writes: DataFrame, share: float = 0.9, least_gaps: int = 3) -> DataFrame:
    """relation, n_gaps, p90_days, stale_after: gaps between distinct write days, the p90 by the rank ceil(0.9 (n - 1)).

    ``stale_after`` is at least one day (``floored``), and NULL where fewer than ``least_gaps`` gaps are known.
    """
    days = writes.select("relation", F.to_date("written_at").alias("day")).distinct()
    by_day = Window.partitionBy("relation").orderBy("day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(by_day))).where("gap is not null")
    ranked = gaps.withColumn("rank", F.row_number().over(Window.partitionBy("relation").orderBy("gap", "day")) - 1).withColumn("n_gaps", F.count("*").over(Window.partitionBy("relation")))
    # The rank in whole numbers: ceil(9 (n - 1) / 10).
    tenths = round(share * 10)
    at = F.floor((F.lit(tenths) * (F.col("n_gaps") - 1) + 9) / 10)
    told = ranked.groupBy("relation", "n_gaps").agg(F.max(F.when(F.col("rank") == at, F.col("gap"))).alias("p90_days"))
    known = F.when(F.col("n_gaps") >= least_gaps, F.col("p90_days"))
    return told.select("relation", "n_gaps", known.alias("p90_days"), F.when(known.isNotNull(), F.greatest(F.lit(1), known)).alias("stale_after"), (known < 1).alias("floored"))


def stale(latest: DataFrame, cadences: DataFrame, now) -> DataFrame:
    """relation, days_old, stale_after, is_stale: NULL where no cadence is known."""
    met = latest.join(cadences.select("relation", "stale_after"), "relation", "left")
    old = F.datediff(F.lit(now).cast("date"), F.to_date("last_at"))
    return met.select("relation", old.alias("days_old"), "stale_after", (old > F.col("stale_after")).alias("is_stale"))


def test_coverage(declared: DataFrame, results: DataFrame) -> DataFrame:
    """n_declared, n_ran, n_never_run, n_skipped_last, n_failing_last out of tests (test_id) and results (test_id, status, ran_at)."""
    window = Window.partitionBy("test_id").orderBy(F.col("ran_at").desc(), F.col("status"))
    last = results.withColumn("k", F.row_number().over(window)).where("k = 1").select("test_id", "status")
    met = declared.select("test_id").distinct().join(last, "test_id", "left")
    return met.agg(
        F.count("*").alias("n_declared"),
        F.count("status").alias("n_ran"),
        F.count(F.when(F.col("status").isNull(), 1)).alias("n_never_run"),
        F.count(F.when(F.col("status") == "skipped", 1)).alias("n_skipped_last"),
        F.count(F.when(F.col("status").isin("fail", "error"), 1)).alias("n_failing_last"),
    )


def monitor_state(results: DataFrame, now, stale_days: int) -> DataFrame:
    """monitor, runs, last_run, state: never_run, live or abandoned."""
    told = results.groupBy("monitor").agg(F.count("run_at").alias("runs"), F.max("run_at").alias("last_run"))
    old = F.datediff(F.lit(now).cast("date"), F.to_date("last_run"))
    return told.withColumn("state", F.when(F.col("runs") == 0, "never_run").when(old > stale_days, "abandoned").otherwise("live"))


def coverage_closure(nodes: DataFrame, edges: DataFrame, levels: int | None = None) -> DataFrame:
    """node, covered: monitored or a seed, or all parents covered (and at least one parent).

    Walks until nothing more is covered, with lineage cut at each level; raises where a given number of levels does not reach that.
    """
    covered = cut(nodes.select("node", (F.col("monitored") | F.col("is_seed")).alias("covered")))
    n = covered.where("covered").count()
    for level in count(1):
        by_parents = edges.join(covered, edges["src"] == covered["node"]).groupBy("dst").agg(F.bool_and("covered").alias("all_parents"))
        covered = cut(covered.join(by_parents, covered["node"] == by_parents["dst"], "left").select("node", (F.col("covered") | F.coalesce("all_parents", F.lit(False))).alias("covered")))
        before, n = n, covered.where("covered").count()
        if n == before:
            return covered
        if levels is not None and level > levels:
            raise RuntimeError(f"the graph is deeper than {levels} levels")
