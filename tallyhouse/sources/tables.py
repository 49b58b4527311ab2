"""Scans, samples and schema reads of relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Read:
    """The outcome of a read: ``status`` says what happened. Its truth is not defined, so a failure cannot pass for empty."""

    status: str
    frame: DataFrame | None = None
    reason: str | None = None

    def __bool__(self) -> bool:
        raise TypeError("ask for .status: a failed read is not an empty one")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``; the last part of a dotted name counts. An unknown relation raises."""
    return spark.read.parquet(f"{folder}/{name.rpartition('.')[2]}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in names}


def try_table(spark: SparkSession, folder: str, name: str) -> Read:
    try:
        return Read("ok", table(spark, folder, name))
    except AnalysisException as problem:
        return Read("unreachable", None, str(problem).split("\n")[0])


def values(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A literal table: whole numbers are long, truths boolean, all else text; a column of NULLs is long, or text if named s or w_s."""

    def kind(k: int) -> str:
        seen = [r[k] for r in rows if r[k] is not None]
        if not seen:
            return "string" if columns[k] in ("s", "w_s") else "long"
        return "boolean" if all(isinstance(v, bool) for v in seen) else "long" if all(isinstance(v, int) for v in seen) else "string"

    return spark.createDataFrame(rows, ", ".join(f"`{c}` {kind(k)}" for k, c in enumerate(columns)))


def schema_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """(relation, column_name, position, type) of all relations, from their schemas: nothing is scanned."""
    rows = [(r, f.name, k, f.dataType.simpleString()) for r, df in frames.items() for k, f in enumerate(df.schema)]
    return next(iter(frames.values())).sparkSession.createDataFrame(rows, "relation string, column_name string, position int, type string")


def column_sample(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    return df.select(*columns).limit(n)


def percentage_sample(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """About ``percent`` of the rows; what is counted on it is marked as sampled."""
    return df.sample(fraction=percent / 100, seed=seed)


def stringify_batch(parts: dict[str, DataFrame]) -> DataFrame:
    """(label, row): rows of different shapes as JSON under one roof."""
    out = None
    for label, df in parts.items():
        one = df.select(F.lit(label).alias("label"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.union(one)
    return out
