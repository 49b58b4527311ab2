"""Readers of a compiled project's JSON files, as node, edge, column, test and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def nodes(spark: SparkSession, manifest: str) -> DataFrame:
    """node, kind, name, path, description, materialized, access, sql, physical_name of models, seeds, tests, sources and exposures."""
    text = _json(spark, manifest)
    parts = []
    for where in ("$.nodes", "$.sources", "$.exposures"):
        rows = text.select(F.explode_outer(F.from_json(F.get_json_object("value", where), "map<string,string>")).alias("node", "j")).where("node is not null")
        field = lambda path: F.get_json_object("j", path)
        parts.append(
            rows.select(
                "node", F.coalesce(field("$.resource_type"), F.lit(where[2:-1])).alias("kind"), field("$.name").alias("name"), field("$.original_file_path").alias("path"), field("$.description").alias("description"),
                field("$.config.materialized").alias("materialized"), field("$.access").alias("access"), F.coalesce(field("$.compiled_code"), field("$.raw_code")).alias("sql"),
                F.concat_ws(".", field("$.schema"), F.coalesce(field("$.alias"), field("$.identifier"), field("$.name"))).alias("physical_name"), field("$.tags").alias("tags"),
            )
        )
    return parts[0].union(parts[1]).union(parts[2]).withColumn("tags", F.from_json("tags", "array<string>"))


def edges(spark: SparkSession, manifest: str) -> DataFrame:
    """(src, dst) from the parent lists."""
    text = _json(spark, manifest)
    return text.select(F.explode(F.from_json(F.get_json_object("value", "$.parent_map"), "map<string,array<string>>")).alias("dst", "parents")).select(F.explode("parents").alias("src"), "dst")


def catalog_columns(spark: SparkSession, catalog: str) -> DataFrame:
    """(node, column_name, type, position) of a catalog file."""
    text = _json(spark, catalog)
    parts = []
    for where in ("$.nodes", "$.sources"):
        rows = text.select(F.explode_outer(F.from_json(F.get_json_object("value", where), "map<string,struct<columns:map<string,struct<name:string,type:string,index:int>>>>")).alias("node", "t")).where("node is not null")
        parts.append(rows.select("node", F.explode("t.columns").alias("k", "c")).select("node", F.col("c.name").alias("column_name"), F.lower("c.type").alias("type"), F.col("c.index").alias("position")))
    return parts[0].union(parts[1])


def declared_columns(spark: SparkSession, manifest: str) -> DataFrame:
    """(node, column_name, description) as documented."""
    text = _json(spark, manifest)
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", "$.nodes"), "map<string,string>")).alias("node", "j"))
    return rows.select("node", F.explode(F.from_json(F.get_json_object("j", "$.columns"), "map<string,struct<name:string,description:string>>")).alias("k", "c")).select("node", F.col("c.name").alias("column_name"), "c.description")


def tests(spark: SparkSession, manifest: str) -> DataFrame:
    """(test_id, node, column_name, kind) of declared tests."""
    text = _json(spark, manifest)
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", "$.nodes"), "map<string,string>")).alias("test_id", "j"))
    field = lambda path: F.get_json_object("j", path)
    return rows.where(field("$.resource_type") == "test").select("test_id", field("$.attached_node").alias("node"), field("$.column_name").alias("column_name"), field("$.test_metadata.name").alias("kind"))


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """(test_id, status, ran_at, failures) of a results file. An unreadable file raises."""
    rows = _json(spark, path).select(F.get_json_object("value", "$.metadata.generated_at").alias("at"), F.explode(F.from_json(F.get_json_object("value", "$.results"), "array<struct<unique_id:string,status:string,failures:long>>")).alias("r"))
    return rows.select(F.col("r.unique_id").alias("test_id"), F.lower("r.status").alias("status"), F.to_timestamp("at").alias("ran_at"), F.col("r.failures").alias("failures"))


def freshness(spark: SparkSession, path: str) -> DataFrame:
    """(node, status, max_loaded_at) of a freshness file."""
    rows = _json(spark, path).select(F.explode(F.from_json(F.get_json_object("value", "$.results"), "array<struct<unique_id:string,status:string,max_loaded_at:string>>")).alias("r"))
    return rows.select(F.col("r.unique_id").alias("node"), F.lower("r.status").alias("status"), F.to_timestamp("r.max_loaded_at").alias("max_loaded_at"))


def sql_files(spark: SparkSession, glob: str) -> DataFrame:
    """(model, sql) of SQL files outside of the project."""
    return spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("model"), F.col("value").alias("sql"))


def commits(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A history that the caller read: (sha, committed_at, subject, files)."""
    found = spark.createDataFrame(rows, "sha string, committed_at timestamp, subject string, files array<string>")
    models = F.transform(F.filter("files", lambda f: f.endswith(".sql")), lambda f: F.regexp_extract(f, r"([^/]+)\.sql$", 1))
    return found.withColumn("models", models)
