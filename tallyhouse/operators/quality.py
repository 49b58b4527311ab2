"""The counting layer: what keys, joins and hops do to rows and values.

Each operator is one aggregation over the relation. A thing that was not counted is reported as
``unknown`` or ``uncounted``; it never passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extremes that usually stand for a missing number.
SENTINELS = (-9999.0, -999.0, -1.0, 9999.0, 99999.0, -99999.0)
#: Texts that stand for a missing value, in upper case.
EMPTY_TEXTS = ("", "NA", "N/A", "NULL", "NONE", "NAN")
#: Up to so many distinct counts share one scan; each costs a copy of the rows in one shuffle.
DISTINCTS_AT_ONCE = 8


def key_status(n: Column, non_null: Column, distinct: Column) -> Column:
    """unknown, has_nulls (before duplicates), has_duplicates or unique."""
    return (
        F.when(n.isNull() | non_null.isNull() | distinct.isNull(), "unknown")
        .when(non_null < n, "has_nulls")
        .when(distinct < non_null, "has_duplicates")
        .otherwise("unique")
    )


def _unpivot(counted: DataFrame, relation: str, columns: list[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"nn_{k}").alias("non_null"), F.col(f"d_{k}").alias("distinct_ct")) for k, c in enumerate(columns)]))
    flat = counted.select(F.col("n").alias("row_count"), rows.alias("r")).select(F.lit(relation).alias("relation"), "r.column_name", "row_count", "r.non_null", "r.distinct_ct")
    return flat.withColumn("status", key_status(F.col("row_count"), F.col("non_null"), F.col("distinct_ct")))


def key_scan(df: DataFrame, relation: str, columns: list[str]) -> DataFrame:
    """relation, column_name, row_count, non_null, distinct_ct, status of each column. Columns that do not exist are left out."""
    columns = [c for c in columns if c in df.columns]
    parts = []
    for at in range(0, len(columns), DISTINCTS_AT_ONCE):
        some = columns[at : at + DISTINCTS_AT_ONCE]
        counts = [x for k, c in enumerate(some) for x in (F.count(c).alias(f"nn_{k}"), F.countDistinct(c).alias(f"d_{k}"))]
        parts.append(_unpivot(df.agg(F.count("*").alias("n"), *counts), relation, some))
    return reduce(DataFrame.union, parts)


def key_scan_batch(relations: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Key scans of many relations as one result; a relation that cannot be read counts as ``unknown``."""
    return reduce(DataFrame.union, [key_scan(df, name, columns) for name, (df, columns) in relations.items()])


def unread(df: DataFrame, relation: str, columns: list[str]) -> DataFrame:
    """The rows of a scan that failed: every count NULL, status ``unknown``."""
    none = F.lit(None).cast("long")
    rows = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
    return df.sparkSession.range(1).select(F.lit(relation).alias("relation"), rows, none.alias("row_count"), none.alias("non_null"), none.alias("distinct_ct"), F.lit("unknown").alias("status"))


def settled_unique(scan: DataFrame, sampled: bool = False) -> DataFrame:
    """Column ``is_key``: unique, and not only on a sample."""
    return scan.withColumn("is_key", (F.col("status") == "unique") & F.lit(not sampled))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, lo, hi, n of ``try_cast(column as double)``."""
    kinds = dict(df.dtypes)

    def number(c: str) -> Column:
        """One cast a value; a text without a digit is a number only if it says so, and is not tried otherwise."""
        cast = F.col(c).try_cast("double")
        return F.when(F.col(c).rlike("(?i)[0-9]|inf|nan"), cast) if kinds[c] == "string" else cast

    cast = df.select(*[number(c).alias(f"v_{k}") for k, c in enumerate(columns)])
    aggs = [x for k in range(len(columns)) for x in (F.min(f"v_{k}").alias(f"lo_{k}"), F.max(f"v_{k}").alias(f"hi_{k}"), F.count(f"v_{k}").alias(f"n_{k}"))]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"lo_{k}").alias("lo"), F.col(f"hi_{k}").alias("hi"), F.col(f"n_{k}").alias("n")) for k, c in enumerate(columns)]))
    return cast.agg(*aggs).select(rows.alias("r")).select("r.*")


def sentinel_extremes(profiled: DataFrame) -> DataFrame:
    """Extremes that equal a sentinel: column_name, extreme, value."""
    ends = F.explode(F.array(F.struct(F.lit("min").alias("extreme"), F.col("lo").alias("value")), F.struct(F.lit("max").alias("extreme"), F.col("hi").alias("value"))))
    return profiled.select("column_name", ends.alias("e")).select("column_name", "e.extreme", "e.value").where(F.col("value").isin(*SENTINELS))


def unit_conflicts(profiled: DataFrame, bounds: DataFrame) -> DataFrame:
    """Columns whose range breaks the bound of their declared unit: above the bound, or negative where the unit forbids it.

    ``bounds``: column_name, unit, bound, may_be_negative.
    """
    met = profiled.join(bounds, "column_name")
    problem = F.when(F.col("hi") > F.col("bound"), "above_bound").when((F.col("lo") < 0) & ~F.col("may_be_negative"), "negative")
    return met.withColumn("conflict", problem).where("conflict is not null").select("column_name", "unit", "lo", "hi", "conflict")


def distinct_tuples(*columns: str) -> Column:
    """COUNT(DISTINCT (a, b)): tuples with NULLs count."""
    return F.countDistinct(F.struct(*columns))


def join_key_unique(df: DataFrame, relation: str, keys: list[str]) -> DataFrame:
    """relation, n, d, fans_out: does a join onto these keys multiply rows? An empty relation is not proven."""
    counted = df.agg(F.count("*").alias("n"), distinct_tuples(*keys).alias("d"))
    return counted.select(F.lit(relation).alias("relation"), "n", "d", (~((F.col("n") > 0) & (F.col("d") >= F.col("n")))).alias("fans_out"))


def grain_verdict(df: DataFrame, relation: str, keys: list[str]) -> DataFrame:
    """relation, n, d, verdict: holds, fails, or empty (which is not holding)."""
    counted = df.agg(F.count("*").alias("n"), distinct_tuples(*keys).alias("d"))
    verdict = F.when(F.col("n").isNull(), "uncounted").when(F.col("n") == 0, "empty").when(F.col("d") < F.col("n"), "fails").otherwise("holds")
    return counted.select(F.lit(relation).alias("relation"), "n", "d", verdict.alias("verdict"))


def minimality(df: DataFrame, keys: list[str]) -> DataFrame:
    """column_name, full, without, minimality: a key column is ``carried`` if the others alone tell as many rows apart."""
    if len(keys) < 2:
        return df.sparkSession.createDataFrame([], "column_name string, full long, without long, minimality string")
    keyed = df.groupBy(*keys).agg(F.lit(1).alias("one"))  # distinct keys first: the copies below cost one row a key
    subsets = [distinct_tuples(*[k for k in keys if k != out]).alias(f"w_{i}") for i, out in enumerate(keys)]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("column_name"), F.col(f"w_{i}").alias("without")) for i, k in enumerate(keys)]))
    flat = keyed.agg(F.count("*").alias("full"), *subsets).select("full", rows.alias("r")).select("r.column_name", "full", "r.without")
    return flat.withColumn("minimality", F.when(F.col("full") == F.col("without"), "carried").otherwise("adds"))


def key_histogram(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def join_size(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """n_left, n_joined, ratio of an equi-join, from key histograms; the join itself is never made."""
    a = key_histogram(left, [k for k, _ in keys], "__nl")
    b = key_histogram(right, [k for _, k in keys], "__nr")
    met = a.join(b, reduce(lambda x, y: x & y, [a[k] == b[j] for k, j in keys]), "left")
    rows = F.col("__nl") * (F.coalesce("__nr", F.lit(1)) if how == "left" else F.coalesce("__nr", F.lit(0)))
    out = met.agg(F.coalesce(F.sum("__nl"), F.lit(0)).alias("n_left"), F.coalesce(F.sum(rows), F.lit(0)).alias("n_joined"))
    return out.withColumn("ratio", F.when(F.col("n_left") > 0, F.col("n_joined") / F.col("n_left")))


def row_loss(parent: DataFrame, child: DataFrame, hop: str, threshold: float = 0.8) -> DataFrame:
    """hop, n_parent, n_child, kept, drops_most: the child keeps less than 1 - threshold of the parent's rows."""
    both = parent.agg(F.count("*").alias("n_parent")).crossJoin(child.agg(F.count("*").alias("n_child")))  # one row each
    kept = F.when(F.col("n_parent") > 0, F.col("n_child") / F.col("n_parent"))
    return both.select(F.lit(hop).alias("hop"), "n_parent", "n_child", kept.alias("kept"), F.coalesce(kept < 1 - threshold, F.lit(False)).alias("drops_most"))


def is_present(column: Column) -> Column:
    """Holds a value: not NULL and not one of the texts for missing."""
    return column.isNotNull() & ~F.upper(F.trim(column.cast("string"))).isin(*EMPTY_TEXTS)


def value_loss(df: DataFrame, hop: str, source: str, expression: Column) -> DataFrame:
    """hop, present, lost, share, base: source values that the expression turns into NULL."""
    has = is_present(F.col(source))
    counted = df.agg(F.count(F.when(has, 1)).alias("present"), F.count(F.when(has & expression.isNull(), 1)).alias("lost"))
    share = F.when(F.col("present") > 0, F.col("lost") / F.col("present"))
    return counted.select(F.lit(hop).alias("hop"), "present", "lost", share.alias("share"), F.when((share >= 0.05) | (F.col("lost") >= 1000), 3).otherwise(2).alias("base"))


def default_share(df: DataFrame, expression: Column, default) -> DataFrame:
    """n, n_default, share: how often a COALESCE's literal wins."""
    counted = df.agg(F.count("*").alias("n"), F.count(F.when(expression.eqNullSafe(F.lit(default)), 1)).alias("n_default"))
    return counted.withColumn("share", F.when(F.col("n") > 0, F.col("n_default") / F.col("n")))


def lateness(df: DataFrame, event: str, arrival: str) -> DataFrame:
    """max_late_seconds, rows_read."""
    late = F.unix_seconds(F.col(arrival).cast("timestamp")) - F.unix_seconds(F.col(event).cast("timestamp"))
    return df.agg(F.max(late).alias("max_late_seconds"), F.count("*").alias("rows_read"))


def unique_per_batch(df: DataFrame, batch: str, keys: list[str]) -> DataFrame:
    """batch, n_keys, n_repeated: keys that one batch brings more than once."""
    per_key = df.groupBy(batch, *keys).agg(F.count("*").alias("n"))
    return per_key.groupBy(F.col(batch).alias("batch")).agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"))


def key_drift(observed: DataFrame) -> DataFrame:
    """Changes between the last two observations of a key that were not sampled.

    ``observed``: relation, column_name, observed_at, status, minimality, sampled.
    """
    window = Window.partitionBy("relation", "column_name").orderBy(F.col("observed_at").desc())
    last = observed.where(~F.coalesce("sampled", F.lit(False))).withColumn("k", F.row_number().over(window)).where("k <= 2")
    pair = last.groupBy("relation", "column_name").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{name}") for k, name in ((1, "now"), (2, "was")) for c in ("status", "minimality")])
    broken = lambda c: F.col(c).isin("has_nulls", "has_duplicates")
    change = (
        F.when((F.col("status_was") == "unique") & broken("status_now"), "key_stopped_holding")
        .when(broken("status_was") & (F.col("status_now") == "unique"), "key_started_holding")
        .when((F.col("minimality_was") == "carried") & (F.col("minimality_now") == "adds"), "key_column_started_mattering")
        .when((F.col("minimality_was") == "adds") & (F.col("minimality_now") == "carried"), "key_column_stopped_mattering")
    )
    return pair.withColumn("change", change).where("change is not null").select("relation", "column_name", "change")


def probe_order(targets: DataFrame, observed: DataFrame) -> DataFrame:
    """Targets (relation, reach) in the order of probing: never observed first, by reach; then the oldest observation."""
    seen = observed.groupBy("relation").agg(F.max("observed_at").alias("last_at"))
    met = targets.join(seen, "relation", "left")
    return met.orderBy(F.col("last_at").asc_nulls_first(), F.col("reach").desc(), "relation")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """n_checked, n_orphans: non-null child keys without a parent row."""
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("k")).distinct().withColumn("there", F.lit(True))
    met = keys.join(known, "k", "left")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))


def accepted_values(df: DataFrame, column: str) -> DataFrame:
    """column_name, n_values, longest, proposes: 2 to 20 distinct texts of at most 40 characters make a list worth testing."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    told = values.agg(F.count("*").alias("n_values"), F.max(F.length("v")).alias("longest"))
    return told.select(F.lit(column).alias("column_name"), "n_values", "longest", (F.col("n_values").between(2, 20) & (F.col("longest") <= 40)).alias("proposes"))


def failing_rows(tests: dict[str, tuple[DataFrame, Column]], limit: int = 5) -> DataFrame:
    """test, n_failed of each test with failures; ``sample_failing`` shows rows."""
    parts = [df.agg(F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("n_failed")).select(F.lit(name).alias("test"), "n_failed") for name, (df, ok) in tests.items()]
    return reduce(DataFrame.union, parts).where("n_failed > 0")


def sample_failing(df: DataFrame, ok: Column, limit: int = 5) -> DataFrame:
    return df.where(~F.coalesce(ok, F.lit(False))).limit(limit)


def variant_columns(schema: DataFrame) -> DataFrame:
    """Columns x with a sibling x__v_<type>: (relation, column_name, variant) out of (relation, column_name, is_read)."""
    base = schema.select("relation", "column_name", "is_read")
    variants = schema.where(F.col("column_name").contains("__v_") & ~F.col("is_read")).select("relation", F.substring_index("column_name", "__v_", 1).alias("column_name"), F.col("column_name").alias("variant"))
    return base.where("is_read").join(variants, ["relation", "column_name"]).select("relation", "column_name", "variant")
