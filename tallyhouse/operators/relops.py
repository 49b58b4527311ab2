"""Relational operators with explicit NULL and order semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_keys(*keys: str) -> list[Column]:
    """Sort keys like ``"a"``, ``"a desc"`` or ``"a desc nulls first"``; NULLs come last unless told otherwise."""
    out = []
    for key in keys:
        name, *rest = key.split()
        low = " ".join(rest).lower()
        column = F.col(name)
        first = "nulls first" in low
        if "desc" in low.split():
            out.append(column.desc_nulls_first() if first else column.desc_nulls_last())
        else:
            out.append(column.asc_nulls_first() if first else column.asc_nulls_last())
    return out


def pick(df: DataFrame, partition: list[str], order: list[str], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each partition. ``order`` must be total for a repeatable result (see ``ties``)."""
    window = Window.partitionBy(*partition).orderBy(*order_keys(*order))
    return df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= k).drop("__rn")


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DISTINCT ON (keys) ... ORDER BY keys, order."""
    return pick(df, keys, order)


def ties(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Groups of rows that an order cannot tell apart: a pick among them is arbitrary."""
    names = [o.split()[0] for o in order]
    return df.groupBy(*partition, *names).agg(F.count("*").alias("n")).where("n > 1")


def with_neighbours(df: DataFrame, partition: list[str], order: list[str], column: str) -> DataFrame:
    """Columns ``prev_<column>`` and ``next_<column>``."""
    window = Window.partitionBy(*partition).orderBy(*order_keys(*order))
    return df.withColumn(f"prev_{column}", F.lag(column).over(window)).withColumn(f"next_{column}", F.lead(column).over(window))


def union_by_name(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION [ALL] BY NAME: columns meet by name, missing ones are NULL."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.distinct() if distinct else out


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def merge_by_key(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows whose key is in the batch are replaced by the batch's rows (NULL equals NULL in keys)."""
    incoming = batch.select(*keys).distinct()
    kept = target.alias("t").join(incoming.alias("b"), reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def last_wins(batch: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row a key: the one that came last in the batch."""
    return pick(batch, keys, [f"{sequence} desc"]).drop(sequence)


def merge_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join; on clashing names the left value wins, and where it is NULL the right one stands."""
    condition = reduce(lambda a, b: a & b, [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in keys])
    joined = left.alias("l").join(right.alias("r"), condition, how)
    columns = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) if c in right.columns else F.col(f"l.{c}") for c in left.columns]
    return joined.select(*columns, *[F.col(f"r.{c}") for c in right.columns if c not in left.columns])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """As-of join: for each left row the values of the latest right row at or before its time.

    One sort of the union by (keys, time) instead of a range join; skewed keys are the caller's to salt.
    """
    a = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.struct(*values).alias("__v")).withColumn("__side", F.lit(0))
    window = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__v", ignorenulls=True).over(window))
    return both.where("__side = 1").select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows whose point lies in [low, high]: an equi-join on buckets of ``width``, then the exact test."""
    points = left.withColumn("__b", F.floor(F.col(point) / width))
    spans = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.join(spans, "__b").where(F.col(point).between(F.col(low), F.col(high))).drop("__b")


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways: all columns and ``side`` ('only_a' or 'only_b')."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).union(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    return bag_difference(a, b).isEmpty()
