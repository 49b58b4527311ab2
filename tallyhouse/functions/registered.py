"""Functions of our own for SQL, where no built-in one fits: a grouped aggregate and a table function.

``register`` makes both known to a session:

* ``quantile_bin(bin, n, p)``: of a histogram's bins, the one that holds the value of ceil rank, and how many values lie
  before it. A group has ``BINS`` rows at most, because rows are counted by bin first.
* ``spaced(TABLE(t) PARTITION BY k ORDER BY seconds, gap)``: rows that are ``gap`` or more after the last row that was kept.
  Each choice depends on the one before, which a window cannot say. State is one number; rows stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, pandas_udf, udtf
from pyspark.sql import types as T

from ..session import cut, ship_package

#: Bins of a pass; a pass leaves a group with the values of one of them.
BINS = 1024


@pandas_udf(T.ArrayType(T.LongType()))
def quantile_bin(bins: pd.Series, n: pd.Series, rank: pd.Series) -> list[int]:
    """[bin, values before it]"""
    order = np.argsort(bins.to_numpy(), kind="stable")
    total = np.cumsum(n.to_numpy()[order])
    at = int(np.searchsorted(total, rank.iloc[0]))
    return [int(bins.iloc[order[at]]), int(total[at] - n.iloc[order[at]])]


@udtf
class Spaced:
    def __init__(self) -> None:
        self.kept: float | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, seconds: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=table.dataType)

    def eval(self, table: Row, seconds: str, gap: float) -> Iterator[tuple]:
        now = table[seconds]
        if now is not None and (self.kept is None or now - self.kept >= gap):
            self.kept = now
            yield tuple(table)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.udf.register("quantile_bin", quantile_bin)
    spark.udtf.register("spaced", Spaced)


def spaced(df: DataFrame, keys: list[str], seconds: str, gap: float) -> DataFrame:
    """Of each key's rows in the order of ``seconds``, those that are ``gap`` or more after the last one kept. Rows without a time go; ties keep one."""
    register(df.sparkSession)
    view = f"spaced_{abs(hash((tuple(df.columns), tuple(keys), seconds)))}"
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"select * from spaced(table({view}) partition by ({', '.join(keys)}) order by ({seconds}), '{seconds}', {float(gap)}D)")


def ceil_rank(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """keys, n, value: the ceil(p n)-th smallest value of each group, exactly. NULL and NaN do not count; a group without values is left out.

    Each pass counts a group's remaining values in ``BINS`` equal bins between their extremes and keeps the bin that holds
    the rank, until all that remain are equal. A group of any size is shuffled as its bins only.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = cut(counted.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p))).cast("long")))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    while not state.where("lo < hi").isEmpty():
        open_groups = state.where("lo < hi")
        met = rows.alias("r").join(open_groups.alias("s"), same).where("v between lo and hi")
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        binned = met.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "n", "rank", place.alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        binned = cut(binned)
        chosen = binned.groupBy(*keys, "rank").agg(quantile_bin("bin", "m", "rank").alias("q")).select(*keys, F.col("q")[0].alias("bin"), F.col("q")[1].alias("before"))
        both = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        narrowed = binned.alias("b").join(chosen.alias("c"), [*both, F.col("b.bin") == F.col("c.bin")]).select(*[f"b.{k}" for k in keys], "n", "b.lo", "b.hi", (F.col("rank") - F.col("before")).alias("rank"))
        state = cut(state.where("lo = hi").union(narrowed.select(*state.columns)))
    return state.select(*keys, "n", F.col("lo").alias("value"))
