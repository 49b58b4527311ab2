"""Laws of relational operators, counted on data: each check returns one row (rule, premise, conclusion, violated).

A law is violated if its premise holds and its conclusion does not. A premise that does not hold is told, not hidden.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relops import merge_by_key, pick
from .quality import join_size


def defined(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_repeated: defined keys that more than one row holds. Keys with a NULL are exempt."""
    return df.where(defined(keys)).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"))


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg(F.count(F.when(~defined(keys), 1)).alias("n_null"))


def _row(rule: str, premise: list[DataFrame], conclusion: list[DataFrame]) -> DataFrame:
    """Each part is a one-row count of exceptions; all must be 0."""
    total = lambda parts, name: reduce(DataFrame.union, [p.toDF("x") for p in parts]).agg(F.sum("x").alias(name))
    met = total(premise, "p").crossJoin(total(conclusion, "c"))  # one row each
    return met.select(F.lit(rule).alias("rule"), (F.col("p") == 0).alias("premise"), (F.col("c") == 0).alias("conclusion"), ((F.col("p") == 0) & (F.col("c") != 0)).alias("violated"))


def inner_join_no_fanout(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    size = join_size(left, right, keys).select(F.greatest(F.col("n_joined") - F.col("n_left"), F.lit(0)))
    return _row("inner_join_no_fanout", [repeated_keys(right, [b for _, b in keys])], [size])


def left_join_preserves_rows(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    size = join_size(left, right, keys, "left").select(F.abs(F.col("n_joined") - F.col("n_left")))
    return _row("left_join_preserves_rows", [repeated_keys(right, [b for _, b in keys])], [size])


def _joined(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str) -> DataFrame:
    return left.join(right, reduce(lambda x, y: x & y, [left[a] == right[b] for a, b in keys]), how)


def grain_through_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], grain: list[str], how: str = "inner") -> DataFrame:
    premise = [repeated_keys(left, grain), null_keys(left, grain), repeated_keys(right, [b for _, b in keys])]
    return _row(f"grain_through_{how}_join", premise, [repeated_keys(_joined(left, right, keys, how), grain)])


def not_null_through_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], columns: list[str], how: str = "inner") -> DataFrame:
    return _row(f"not_null_through_{how}_join", [null_keys(left, columns)], [null_keys(_joined(left, right, keys, how), columns)])


def filter_preserves_unique(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    return _row("filter_preserves_unique", [repeated_keys(df, keys)], [repeated_keys(df.where(condition), keys)])


def not_null_through_filter(df: DataFrame, columns: list[str], condition: Column) -> DataFrame:
    return _row("not_null_through_filter", [null_keys(df, columns)], [null_keys(df.where(condition), columns)])


def group_by_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    none = df.sparkSession.range(1).select(F.lit(0))
    return _row("group_by_unique", [none], [repeated_keys(df.groupBy(*keys).agg(F.count("*").alias("n_rows")), keys)])


def not_null_through_group_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return _row("not_null_through_group_by", [null_keys(df, keys)], [null_keys(df.groupBy(*keys).agg(F.count("*").alias("n_rows")), keys)])


def pick_unique(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    none = df.sparkSession.range(1).select(F.lit(0))
    return _row("pick_unique", [none], [repeated_keys(pick(df, partition, order), partition)])


def not_null_through_pick(df: DataFrame, partition: list[str], order: list[str], columns: list[str]) -> DataFrame:
    return _row("not_null_through_pick", [null_keys(df, columns)], [null_keys(pick(df, partition, order), columns)])


def pick_is_order_independent(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """A total order picks the same rows however the input is dealt out."""
    names = [o.split()[0] for o in order]
    tied = df.groupBy(*partition, *names).agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)))
    one, two = pick(df, partition, order), pick(df.repartition(7), partition, order)
    apart = one.exceptAll(two).agg(F.count("*"))
    return _row("pick_is_order_independent", [tied], [apart])


def join_onto_grouped(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    grouped = right.groupBy(*[b for _, b in keys]).agg(F.count("*").alias("n_rows"))
    none = left.sparkSession.range(1).select(F.lit(0))
    return _row("join_onto_grouped", [none], [join_size(left, grouped, keys).select(F.greatest(F.col("n_joined") - F.col("n_left"), F.lit(0)))])


def join_onto_picked(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], order: list[str]) -> DataFrame:
    picked = pick(right, [b for _, b in keys], order)
    none = left.sparkSession.range(1).select(F.lit(0))
    return _row("join_onto_picked", [none], [join_size(left, picked, keys).select(F.greatest(F.col("n_joined") - F.col("n_left"), F.lit(0)))])


def incremental_equals_full_refresh(first: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Merging a batch by key gives the table that a full rebuild (batch rows before old ones) gives, where keys are unique in both."""
    merged = merge_by_key(first, batch, keys)
    both = first.withColumn("__b", F.lit(0)).unionByName(batch.withColumn("__b", F.lit(1)))
    full = pick(both, keys, ["__b desc"]).drop("__b")
    apart = merged.exceptAll(full).agg(F.count("*")), full.exceptAll(merged).agg(F.count("*"))
    return _row("incremental_equals_full_refresh", [repeated_keys(first, keys), repeated_keys(batch, keys), null_keys(first, keys), null_keys(batch, keys)], list(apart))
