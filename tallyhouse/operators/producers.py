"""Facts for the named checks, measured on relations: what ``checks`` filters is counted here.

Each producer makes a table that ``checks.run_all`` takes (``incrementals``, ``hops``, ``reach``). What cannot be
measured is NULL, and the checks take NULL for not proven.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, monitor, quality

#: Names of columns that loaders write when a row arrives.
ARRIVAL_NAMES = """
_loaded_at loaded_at _etl_loaded_at inserted_at _inserted_at _airbyte_extracted_at _airbyte_emitted_at _fivetran_synced
_sdc_batched_at _sdc_received_at _dlt_loaded_at ingested_at _ingested_at received_at _received_at arrived_at load_ts
""".split()


def arrival_column(columns: Sequence[str], judged: dict[str, float] | None = None, least: float = 0.6) -> str | None:
    """The column that says when a row arrived: by its name, else the likeliest of the judged ones if it is at least ``least`` likely."""
    for name in columns:
        if name.lower() in ARRIVAL_NAMES:
            return name
    likely = {c: p for c, p in (judged or {}).items() if c in columns and p >= least}
    return min(likely, key=lambda c: (-likely[c], c)) if likely else None


@dataclass(frozen=True)
class Incremental:
    """How a relation is loaded in parts. ``batch`` tells apart what one run brings; ``arrival`` is found by name if it is not given."""

    node: str
    relation: DataFrame
    strategy: str
    unique_key: tuple[str, ...] = ()
    filter_column: str | None = None
    subtracts: bool = False
    lookback_seconds: int | None = None
    batch: Column | None = None
    arrival: str | None = None
    columns_before: tuple[str, ...] | None = None


def incremental_facts(loads: list[Incremental]) -> DataFrame:
    """node, strategy, unique_key, filter_column, subtracts, lookback_seconds, max_late_seconds, n_repeated, columns_now, columns_before.

    Lateness is counted where a row says when it arrived; repeated keys where a batch is told and there is a key.
    """
    none = F.lit(None).cast("long")

    def one(load: Incremental) -> DataFrame:
        df, columns = load.relation, load.relation.columns
        arrival = load.arrival or arrival_column(columns)
        late = quality.lateness(df, load.filter_column, arrival).select("max_late_seconds") if arrival and load.filter_column else df.sparkSession.range(1).select(none.alias("max_late_seconds"))
        repeated = df.sparkSession.range(1).select(none.alias("n_repeated"))
        if load.unique_key and load.batch is not None:
            repeated = quality.unique_per_batch(df.withColumn("__batch", load.batch), "__batch", list(load.unique_key)).agg(F.coalesce(F.sum("n_repeated"), F.lit(0)).alias("n_repeated"))
        text = lambda names: F.array(*map(F.lit, sorted(n.lower() for n in names))).cast("array<string>")
        return late.withColumn("one", F.lit(1)).join(repeated.withColumn("one", F.lit(1)), "one").select(
            F.lit(load.node).alias("node"), F.lit(load.strategy).alias("strategy"), F.lit(",".join(load.unique_key) or None).cast("string").alias("unique_key"), F.lit(load.filter_column).cast("string").alias("filter_column"),
            F.lit(load.subtracts).alias("subtracts"), F.lit(load.lookback_seconds).cast("long").alias("lookback_seconds"), "max_late_seconds", "n_repeated",
            text(columns).alias("columns_now"), text(columns if load.columns_before is None else load.columns_before).alias("columns_before"),
        )

    return reduce(DataFrame.union, map(one, loads))


@dataclass(frozen=True)
class Hop:
    """A child that reads a parent: by an inner join on ``keys`` (parent's, child's), with values carried by ``expression`` of ``source``."""

    name: str
    parent: DataFrame
    child: DataFrame
    keys: tuple[tuple[str, str], ...]
    source: str | None = None
    expression: Column | None = None


def hop_facts(hops: list[Hop]) -> DataFrame:
    """hop, ratio (rows of the join for each parent row), kept (child rows for each parent row), lost, lost_share (present values turned NULL)."""

    def one(hop: Hop) -> DataFrame:
        size = quality.join_size(hop.parent, hop.child, list(hop.keys)).select("ratio")
        rows = quality.row_loss(hop.parent, hop.child, hop.name).select("hop", "kept")
        lost = hop.parent.sparkSession.range(1).select(F.lit(None).cast("long").alias("lost"), F.lit(None).cast("double").alias("lost_share"))
        if hop.source is not None:
            lost = quality.value_loss(hop.parent, hop.name, hop.source, hop.expression).select("lost", F.col("share").alias("lost_share"))
        parts = [x.withColumn("one", F.lit(1)) for x in (rows, size, lost)]
        return reduce(lambda a, b: a.join(b, "one"), parts).select("hop", "ratio", "kept", "lost", "lost_share")

    return reduce(DataFrame.union, map(one, hops))


def row_loss_candidates(reads: DataFrame) -> DataFrame:
    """(node, parent) hops where fewer rows than the parent's would not be declared behaviour.

    ``reads``: node, parent, join_kind, pre_aggregated, driving, filters_rows, aggregates, readable. A node that filters, groups or cannot
    be read declares or hides its losses; a parent that is aggregated before, or read by an outer or cross join, cannot lose its rows; and
    where a driving parent is known, the others are not judged.
    """
    driven = reads.groupBy("node").agg(F.max("driving").alias("has_driving"))
    open_nodes = reads.where(~(F.col("filters_rows") | F.col("aggregates")) & F.col("readable") & ~F.col("pre_aggregated"))
    inner = open_nodes.where(F.coalesce(F.upper("join_kind"), F.lit("")).isin("", "INNER"))
    return inner.join(driven, "node").where(F.col("driving") | ~F.col("has_driving")).select("node", "parent")


def unmonitored_sources(nodes: DataFrame, edges: DataFrame, watched: DataFrame) -> DataFrame:
    """node, marts, via of each source without a monitor from which a mart can be reached past no watched model, by marts reached.

    Walks from the open sources and stops at watched nodes, which would catch the change.
    """
    open_sources = nodes.where("kind = 'source'").join(watched.select("node"), "node", "left_anti").select("node")
    met = graph.reach(open_sources, edges, watched).join(nodes.select(F.col("node").alias("reached"), "kind"), "reached")
    by_kind = lambda kind: F.sort_array(F.collect_set(F.when(kind, F.col("reached"))))
    out = met.groupBy("node").agg(by_kind(F.col("kind") == "mart").alias("marts"), by_kind(F.col("kind") == "model").alias("via"))
    return out.where(F.size("marts") > 0).orderBy(F.size("marts").desc(), "node")


def reach_facts(nodes: DataFrame, edges: DataFrame, watched: DataFrame) -> DataFrame:
    """node, kind, marts, watched: marts behind each source and model, and whether it is watched itself or through all that it reads."""
    covered = monitor.coverage_closure(nodes.join(watched.select("node", F.lit(True).alias("monitored")), "node", "left").select("node", F.coalesce("monitored", F.lit(False)).alias("monitored"), (F.col("kind") == "seed").alias("is_seed")), edges)
    up = graph.reach(nodes.where("kind = 'mart'").select("node"), graph.reversed_edges(edges)).groupBy(F.col("reached").alias("node")).agg(F.count("*").alias("marts"))
    return nodes.select("node", "kind").join(covered, "node").join(up, "node", "left").select("node", "kind", F.coalesce("marts", F.lit(0).cast("long")).alias("marts"), F.col("covered").alias("watched"))
