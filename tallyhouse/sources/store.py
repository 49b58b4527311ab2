"""Append-only tables on Parquet: append, upsert by key, export and re-import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relops import last_wins, merge_by_key, pick


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """``stored`` with the batch's rows; inside the batch the last row of a key wins."""
    return merge_by_key(stored, last_wins(batch, keys, sequence), keys)


def rewrite(df: DataFrame, path: str, old: str | None = None) -> None:
    """Write a new version of a table beside the old one; the caller switches over once it is there."""
    df.write.mode("errorifexists").parquet(path)


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key; ties fall to the largest values of all other columns."""
    rest = [f"`{c}` desc" for c in df.columns if c not in keys and c != at]
    return pick(df, keys, [f"{at} desc", *[r.replace("`", "") for r in rest]])


def to_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def to_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a fixed order."""
    df.orderBy(*order).write.json(path)


def reimport(spark: SparkSession, path: str, schema: StructType, stored: DataFrame) -> tuple[DataFrame, dict]:
    """Rows of a CSV that the table lacks, cast to its types, and counts: in_file, added, ignored columns."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    ignored = sorted(set(raw.columns) - set(schema.names))
    typed = raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    new = typed.subtract(stored.select(*schema.names))
    return new, {"in_file": typed.count(), "added": new.count(), "ignored": ignored}
