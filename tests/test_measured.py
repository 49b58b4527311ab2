"""Chains of joins, similarity joins, walks from seeds, and streams that merge, against plain forms on small tables."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyhouse import streaming
from tallyhouse.operators import chains, graph, planning, relops, similar
from tallyhouse.streaming import late, merge


def drawn(spark, seed, names, n):
    draw = random.Random(seed)
    return spark.createDataFrame([tuple(draw.choice((None, 1, 1, 1, 2, 3, 4)) for _ in names) for _ in range(n)], ", ".join(f"{c} int" for c in names))


@pytest.mark.parametrize("hows", [("inner", "inner", "inner"), ("left", "left", "left"), ("left", "inner", "left"), ("left", "left", "inner"), ("inner", "left", "left")])
def test_chain_is_the_joins(spark, hows):
    a, b, c, d = (drawn(spark, k, names, 30) for k, names in enumerate((("a1", "a2"), ("b1", "b2"), ("c1", "c2"), ("d1", "d2"))))
    hops = [chains.Hop("b", b, "a", (("a1", "b1"),), hows[0]), chains.Hop("c", c, "b", (("b2", "c1"), ("b1", "c2")), hows[1]), chains.Hop("d", d, "a", (("a2", "d1"),), hows[2])]
    one = a.join(b, F.col("a1") == F.col("b1"), hows[0])
    two = one.join(c, (F.col("b2") == F.col("c1")) & (F.col("b1") == F.col("c2")), hows[1])
    three = two.join(d, F.col("a2") == F.col("d1"), hows[2])
    got = chains.chain_sizes("a", a, hops).orderBy("step").collect()
    assert [r["n_after"] for r in got] == [x.count() for x in (one, two, three)]
    assert [r["n_before"] for r in got] == [30, *(r["n_after"] for r in got[:-1])]


def test_chain_of_a_hot_key_needs_no_rows(spark):
    left, right = spark.range(200_000).select(F.lit(7).alias("k")), spark.range(300_000).select(F.lit(7).alias("j"))
    got = chains.chain_sizes("l", left, [chains.Hop("r", right, "l", (("k", "j"),))]).first()
    assert (got["n_after"], got["verdict"]) == (60_000_000_000, "fans_out")
    empty = chains.chain_sizes("l", left.limit(0), [chains.Hop("r", right, "l", (("k", "j"),))]).first()
    assert (empty["n_after"], empty["ratio"], empty["verdict"]) == (0, None, "keeps")
    with pytest.raises(ValueError):
        chains.chain_sizes("l", left, [chains.Hop("r", right, "x", (("k", "j"),))])


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_are_brute_force(spark, least):
    draw = random.Random(int(least * 10))
    sets = {k: sorted({f"w{int(draw.random() ** 3 * 12)}" for _ in range(draw.randrange(8))}) for k in range(120)}
    got = {(r[0], r[1]): r[2] for r in similar.similar_sets(spark.createDataFrame(list(sets.items()), "key int, items array<string>"), least).collect()}
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least:
                want[a, b] = round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)
    assert got == want


def test_common_words_make_no_pairs(spark):
    def held(n):
        sets = spark.range(n).select(F.col("id").alias("key"), F.array(F.lit("made"), F.lit("in"), *[F.concat(F.lit(c), (F.col("id") / 2).cast("int")) for c in "abcd"], F.concat(F.lit("own"), "id")).alias("items"))
        return similar.candidates(sets, 0.5).count()

    assert (held(400), held(1600)) == (200, 800)


def test_claims_meet_as_before(spark):
    rows = [(k, f"s{k % 3}", f"the order is made in plant {k // 4} by hand" + (" twice" if k % 2 else "")) for k in range(40)]
    got = planning.claim_pairs(spark.createDataFrame(rows, "claim_id int, subject string, text string"), 0.7, 1000).collect()
    bags = {k: set(text.split()) for k, _, text in rows}
    want = {(a, b) for a in bags for b in bags if a < b and a % 3 != b % 3 and 0.7 <= len(bags[a] & bags[b]) / len(bags[a] | bags[b]) < 1}
    assert {(r["id_a"], r["id_b"]) for r in got} == want and want


def test_walk_costs_what_it_finds(spark):
    nodes = 100_000
    edges = spark.range(nodes).where("id % 100 <> 0").select((F.col("id") - F.when(F.col("id") % 100 > 90, 7).otherwise(1)).alias("src"), F.col("id").alias("dst")).union(spark.createDataFrame([(199, 100)], "src long, dst long"))
    seeds = spark.createDataFrame([(100,), (150,), (70_000,)], "node long")
    began = time.time()
    found = graph.reached_from(seeds, edges)
    assert found.count() == 99 + 1 + 99 and time.time() - began < 120  # 199 -> 100 is a circle
    rows = {(r["node"], r["reached"]) for r in graph.reach(spark.createDataFrame([(195,), (299,)], "node long"), edges, spark.createDataFrame([(103,)], "node long")).collect()}
    assert rows == set()


def test_walks_stop_and_carry_least_labels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (4, 6), (7, 7)], "src int, dst int")
    walk = lambda *a: sorted(tuple(r) for r in graph.reach(*a).collect())
    seeds = spark.createDataFrame([(1,), (5,), (7,), (9,)], "node int")
    assert walk(seeds, edges) == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 6, 4), (5, 4, 1), (5, 6, 2)]
    assert walk(seeds, edges, spark.createDataFrame([(4,)], "node int")) == [(1, 2, 1), (1, 3, 2)]
    assert walk(seeds.limit(0), edges) == []
    labels = graph.least_labels(spark.createDataFrame([(1, "m"), (5, "b"), (9, "a")], "node int, label string"), edges)
    assert sorted(tuple(r) for r in labels.collect()) == [(1, "m"), (2, "m"), (3, "m"), (4, "b"), (5, "b"), (6, "b"), (9, "a")]


SCHEMA = "k int, v string, seq int"


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("seq"))
    merge.merge_batch(first, 0, path, ["k"], "seq", 8)
    folder = merge.Folder(spark, path)
    whole = folder.size("data")
    want = {k: v for k, v in first.select("k", "v").collect()}
    for epoch in range(1, 4):
        batch = spark.createDataFrame([(epoch, f"new{epoch}", 1), (epoch, "older", 0), (90_000 + epoch, "added", 1)], SCHEMA)
        merge.merge_batch(batch, epoch, path, ["k"], "seq")
        want |= {epoch: f"new{epoch}", 90_000 + epoch: "added"}
        assert folder.size(f"data/{epoch:020d}-delta") < whole / 50 and folder.size(f"data/{epoch:020d}-base") == 0
    assert {r["k"]: r["v"] for r in merge.read_merged(spark, path).collect()} == want


def test_replays_and_rewrites_are_exact(spark, tmp_path):
    path, want, draw = str(tmp_path / "table"), {}, random.Random(4)
    folder = merge.Folder(spark, path)
    for epoch in range(8):
        rows = [(draw.choice((None, *range(60))), f"e{epoch}-{k}", k) for k in range(25)]
        want |= {k: v for k, v, _ in rows}
        batch = spark.createDataFrame(rows, SCHEMA)
        if epoch == 4:  # a batch that was cut off before its manifest
            spark.createDataFrame([(1, "lost", 0, 3)], "k int, v string, __epoch long, __bucket int").write.partitionBy("__bucket").parquet(f"{path}/data/{epoch:020d}-delta")
        merge.merge_batch(batch, epoch, path, ["k"], "seq", 4)
        merge.merge_batch(batch, epoch, path, ["k"], "seq", 4)
        got = merge.read_merged(spark, path)
        assert {r["k"]: r["v"] for r in got.collect()} == want and got.count() == len(want)
    assert len(folder.names("manifests")) == 2
    named = {part["at"] for name in folder.names("manifests") for parts in json.loads(folder.read(f"manifests/{name}"))["buckets"].values() for part in parts}
    assert {f"data/{at}" for at in folder.names("data")} == named
    merge.merge_batch(batch.limit(0), 8, path, ["k"], "seq")
    assert merge.read_merged(spark, path).count() == len(want)
    with pytest.raises(FileNotFoundError):
        merge.read_merged(spark, str(tmp_path / "none"))


def test_a_stream_merges_in_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([(k, f"a{k}", k), (9, f"b{k}", k)], SCHEMA).write.mode("append").parquet(source)
        streaming.drain(spark.readStream.schema(SCHEMA).parquet(source), merge.merge_sink(path, ["k"], "seq"), str(tmp_path / "state"))
    assert sorted(tuple(r) for r in merge.read_merged(spark, path).collect()) == [(0, "a0"), (1, "a1"), (2, "a2"), (9, "b2")]


def deliveries(spark):
    day = 86400  # a watermark starts at 1970-01-01, and rows of that second count as late
    rows = [(k, day + 60 * k, day + 60 * k + (k * 37) % 900) for k in range(400)]
    rows += [(k, t, a + 200) for k, t, a in rows if k % 5 == 0]
    return spark.createDataFrame(rows, "id int, t int, a int").select("id", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("a").alias("arrived"), F.lit("x").alias("kind"))


def test_the_measured_delay_loses_nothing_and_a_shorter_one_does(spark, tmp_path):
    rows = deliveries(spark)
    delay = late.measured_delay(rows, "ts", "arrived")
    assert delay == 1 + max((k * 37) % 900 + (200 if k % 5 == 0 else 0) for k in range(400))
    found = {}
    for name, wait in (("measured", delay), ("short", 60)):
        out = str(tmp_path / name)
        handle = lambda s, w=wait: late.closed_buckets(late.without_redelivery(s, "ts", ["id"], w), "ts", "kind", "10 minutes")
        late.in_arrivals(rows, "arrived", 5, handle, lambda df, k, o=out: df.write.mode("overwrite").parquet(f"{o}/batch={k}"))
        found[name] = {r["bucket"].timestamp(): r["n"] for r in spark.read.parquet(out).collect()}
    mark = 86400 + 60 * 399 - delay
    assert found["measured"] == {float(86400 + 600 * b): 10 for b in range(40) if 86400 + 600 * (b + 1) <= mark}
    assert sum(found["short"].get(b, 0) < n for b, n in found["measured"].items()) > 0
    assert relops.same_bag(late.closed_buckets(rows.dropDuplicates(["id"]), "ts", "kind", "10 minutes").select("n"), spark.createDataFrame([(10,)] * 40, "n long"))
