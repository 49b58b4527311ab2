"""Edge cases of the operators: statuses, NULL keys, cycles, streams, stores and project files."""

import json

import pytest
from pyspark.sql import functions as F

from tallyhouse import functions as fn
from tallyhouse import streaming
from tallyhouse.operators import analytics, checks, graph, monitor, quality, relops
from tallyhouse.plans import digest
from tallyhouse.sources import project, store, tables


def rows(df, *columns):
    return sorted([tuple(r) for r in (df.select(*columns) if columns else df).collect()], key=repr)


def test_key_status_ladder(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 2), (3, 2, 2)], "a int, b int, c int")
    told = dict(rows(quality.key_scan(df, "x", ["a", "b", "c", "absent"]), "column_name", "status"))
    assert told == {"a": "unique", "b": "has_duplicates", "c": "has_nulls"}  # NULLs count before duplicates
    assert rows(quality.unread(df, "x", ["a"]), "status") == [("unknown",)]
    assert rows(quality.settled_unique(quality.key_scan(df, "x", ["a"]), sampled=True), "is_key") == [(False,)]
    wide = spark.range(5).select(*[F.col("id").alias(f"c{k}") for k in range(20)])
    assert quality.key_scan(wide, "w", wide.columns).where("status = 'unique'").count() == 20


def test_empty_is_not_proven(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert rows(quality.grain_verdict(empty, "e", ["k"]), "verdict") == [("empty",)]
    assert rows(quality.join_key_unique(empty, "e", ["k"]), "fans_out") == [(True,)]
    assert rows(quality.row_loss(empty, empty, "h"), "kept", "drops_most") == [(None, False)]
    assert quality.minimality(empty, ["k"]).count() == 0


def test_tuples_with_nulls_count(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (None, None), (1, 1)], "a int, b int")
    assert df.agg(quality.distinct_tuples("a", "b")).first()[0] == 4


def test_join_size_is_the_join(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (3,), (None,)], "j int")
    for how in ("inner", "left"):
        assert quality.join_size(left, right, [("k", "j")], how).first()["n_joined"] == left.join(right, F.col("k") == F.col("j"), how).count()


def test_value_loss_knows_missing_texts(spark):
    df = spark.createDataFrame([("1",), ("x",), (" na ",), ("",), (None,), ("null",)], "s string")
    assert rows(quality.value_loss(df, "h", "s", F.col("s").try_cast("int")), "present", "lost") == [(2, 1)]


def test_merge_and_last_wins(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    batch = spark.createDataFrame([(None, "B", 1), (2, "x", 1), (2, "C", 2)], "k int, v string, seq int")
    assert rows(store.upserted(old, batch, ["k"], "seq")) == sorted([(1, "a"), (None, "B"), (2, "C")], key=repr)


def test_pick_nulls_last_and_ties(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, 7), (2, 7)], "k int, v int")
    assert rows(relops.pick(df, ["k"], ["v"])) == [(1, 5), (2, 7)]
    assert rows(relops.ties(df, ["k"], ["v"])) == [(2, 7, 2)]
    assert relops.same_bag(df, df.orderBy("v")) and not relops.same_bag(df, df.distinct())


def test_as_of_takes_the_latest_before(spark):
    a = spark.createDataFrame([("x", 1), ("x", 5), ("y", 2)], "k string, t int")
    b = spark.createDataFrame([("x", 1, "p"), ("x", 4, "q"), ("y", 3, "r")], "k string, u int, w string")
    assert rows(relops.as_of(a, b, ["k"], "t", "u", ["w"])) == [("x", 1, "p"), ("x", 5, "q"), ("y", 2, None)]


def test_graph_with_a_cycle(spark):
    nodes = spark.createDataFrame([(x, "model", "view") for x in "abcde"], "node string, kind string, materialized string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "src string, dst string")
    assert rows(graph.closure(edges), "node", "reached") == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "e")]
    assert dict(rows(graph.components(nodes, edges))) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert dict(rows(graph.levels(nodes, edges))) == {"a": None, "b": None, "c": None, "d": 0, "e": 1}
    with pytest.raises(ValueError):
        graph.select_nodes(nodes.withColumn("path", F.lit("")).withColumn("tags", F.array()), edges, "owner:me")


def test_cadence_needs_gaps(spark):
    days = spark.createDataFrame([("a", f"2024-01-{d:02d}") for d in (1, 2, 4, 9)] + [("b", "2024-01-01"), ("b", "2024-01-02")], "relation string, written_at string")
    told = {r["relation"]: r for r in monitor.cadence(days).collect()}
    assert told["a"]["p90_days"] == 5 and told["b"]["p90_days"] is None and told["b"]["stale_after"] is None


def test_thresholds_are_a_whitelist(spark):
    assert spark.createDataFrame([(0.8,)], "p double").select(analytics.threshold("p >= 0.7 and not (p > 0.9)")).first()[0] is True
    for bad in ("drop", "p >= length('x')", "__import__"):
        with pytest.raises(ValueError):
            analytics.threshold(bad)


def test_scalars(spark):
    one = spark.createDataFrame([(-7, 2, float("nan")), (7, 0, 1.0)], "a int, b int, x double")
    assert [tuple(r) for r in one.select(fn.int_div(F.col("a"), F.col("b")), fn.int_mod(F.col("a"), F.col("b")), fn.finite(F.col("x"))).collect()] == [(-3, -1, None), (None, None, 1.0)]
    assert spark.range(1).select(fn.full_match(F.lit("abc"), "b")).first()[0] is False


def test_failed_read_is_not_empty(spark, tmp_path):
    read = tables.try_table(spark, str(tmp_path), "raw.nothing")
    assert read.status == "unreachable"
    with pytest.raises(TypeError):
        bool(read)


def test_streams_and_upserts(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    sink = streaming.upsert_sink(str(tmp_path / "out"), ["k"], "seq")
    streaming.drain(streaming.event_stream(spark, source, events.schema), sink, str(tmp_path / "cp"))
    spark.createDataFrame([(2, "B", 2), (3, "c", 2)], events.schema).write.mode("append").parquet(source)
    streaming.drain(streaming.event_stream(spark, source, events.schema), sink, str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out/v=1")), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_stream_buckets_equal_the_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    source = str(tmp_path / "ev")
    events.write.parquet(source)
    out = str(tmp_path / "buckets")
    stream = streaming.volume_buckets(streaming.event_stream(spark, source, events.schema).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    streaming.drain(stream, lambda df, _: df.write.mode("overwrite").parquet(out), str(tmp_path / "cp2"), "complete")
    batch = streaming.volume_buckets(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    assert relops.same_bag(spark.read.parquet(out), batch)


def test_reimport(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    store.to_csv(table.withColumn("extra", F.lit("z")).union(spark.createDataFrame([(3, "c", "z")], "k int, v string, extra string")), str(tmp_path / "csv"))
    new, counts = store.reimport(spark, str(tmp_path / "csv"), table.schema, table)
    assert rows(new) == [(3, "c")] and counts == {"in_file": 3, "added": 1, "ignored": ["extra"]}


def test_project_files_and_checks(spark, tmp_path):
    manifest = {
        "nodes": {
            "model.p.stg": {"resource_type": "model", "name": "stg", "original_file_path": "models/stg.sql", "description": "", "config": {"materialized": "view"}, "raw_code": "select id, coalesce(x, 0) as x from raw.t", "schema": "s", "columns": {"id": {"name": "id", "description": "the id"}}, "tags": ["core"]},
            "test.p.nn": {"resource_type": "test", "name": "nn", "attached_node": "model.p.stg", "column_name": "x", "test_metadata": {"name": "not_null"}},
        },
        "sources": {"source.p.raw.t": {"resource_type": "source", "name": "t", "schema": "raw", "identifier": "t"}},
        "exposures": {},
        "parent_map": {"model.p.stg": ["source.p.raw.t"], "test.p.nn": ["model.p.stg"]},
    }
    path = str(tmp_path / "manifest.json")
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    nodes, edges, tests = project.nodes(spark, path), project.edges(spark, path), project.tests(spark, path)
    assert rows(nodes, "node", "kind") == [("model.p.stg", "model"), ("source.p.raw.t", "source"), ("test.p.nn", "test")]
    assert rows(edges) == [("source.p.raw.t", "model.p.stg"), ("model.p.stg", "test.p.nn")][::-1] or len(rows(edges)) == 2
    digests = digest.digest_frame(nodes.where("kind = 'model'").select(F.col("node").alias("model"), "sql"))
    found, unchecked = checks.run_all({"digests": digests, "tests": tests})
    assert ("test_cannot_fail", "test.p.nn") in rows(found, "check_name", "subject")
    assert "test_is_failing" in unchecked  # no results were given: not passed
    assert rows(project.declared_columns(spark, path)) == [("model.p.stg", "id", "the id")]


def test_checks_over_facts(spark):
    incrementals = spark.createDataFrame(
        [("a", "merge", None, "at", False, None, 5, None, ["x", "y"], ["x"]), ("b", "merge", "id", "at", True, 10, 5, 0, ["x"], ["x"]), ("c", "microbatch", "id", None, None, 0, None, None, ["x"], ["x"])],
        "node string, strategy string, unique_key string, filter_column string, subtracts boolean, lookback_seconds long, max_late_seconds long, n_repeated long, columns_now array<string>, columns_before array<string>",
    )
    premises = spark.createDataFrame([("p", "broken", "holding"), ("q", "holding", None)], "premise_id string, status string, was string")
    found, unchecked = checks.run_all({"incrementals": incrementals, "premises": premises})
    assert set(rows(found, "check_name", "subject")) == {
        ("incremental_merge_without_key", "a"), ("incremental_filter_without_lookback", "a"), ("incremental_schema_change_ignored", "a"),
        ("incremental_key_not_unique", "c"),  # an uncounted key is not a unique one
        ("microbatch_without_lookback", "c"), ("guarantee_does_not_hold", "p"), ("guarantee_lost", "p"),
    }
    assert "hop_multiplies_rows" in unchecked


def test_many_leaf_children(spark):
    nodes = spark.createDataFrame([("raw", "source"), ("hub", "model"), ("mid", "model"), ("tip", "model"), *[(f"leaf{k}", "model") for k in range(5)], ("seen", "test")], "node string, kind string")
    edges = [("raw", f"leaf{k}") for k in range(5)] + [("hub", f"leaf{k}") for k in range(3)] + [("hub", "leaf0"), ("hub", "mid"), ("mid", "leaf3"), ("mid", "leaf4"), ("mid", "tip"), ("tip", "leaf4"), ("mid", "seen"), ("leaf0", "seen")]
    project = {"nodes": nodes, "edges": spark.createDataFrame(edges, "src string, dst string")}
    # hub: leaf0 to leaf2, counted once each; mid: leaf3 and leaf4 only, as tip is read by a model; a test does not count.
    assert [(r["subject"], r["detail"]) for r in checks.many_leaf_children(project).collect()] == [("hub", "3")]
    assert sorted((r["subject"], r["detail"]) for r in checks.many_leaf_children(project, 2).collect()) == [("hub", "3"), ("mid", "2")]
