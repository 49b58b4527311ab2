"""The queries over whole tables: rows of all ids, and both kinds of pairs by brute force."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import planning
from tallyhouse.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, table", [("join_inner", "customer"), ("join_left", "customer"), ("join_right", "customer"), ("join_full", "customer"), ("select_exclude", "customer"), ("cast_try_cast", "orders"), ("cte_chain", "customer")])
def test_rows_of_all_ids(spark, name, table):
    whole = spark.read.parquet(f"{LARGER}/{table}.parquet").count()
    found = QUERIES[name](spark, LARGER).count()
    assert found == whole if name not in ("join_inner", "join_right") else whole / 2 < found <= whole


@pytest.mark.parametrize("name", ["except_rows", "intersect_rows", "spend_days", "reason_pairs", "claim_pairs"])
def test_whole_query_runs(spark, name):
    assert QUERIES[name](spark, LARGER).count() > 0


def brute_claims(rows, least, most):
    bag = [(k, s, frozenset(w for w in re.split("[^a-z0-9]+", text.lower()) if w)) for k, s, text in rows]
    bag = [b for b in bag if len(b[2]) >= 3]
    out = [(a[0], b[0], round(len(a[2] & b[2]) / len(a[2] | b[2]), 6)) for a in bag for b in bag if a[0] < b[0] and a[1] != b[1]]
    return sorted([p for p in out if least <= p[2] < 1], key=lambda p: (-p[2], p[0], p[1]))[:most]


def test_pairs_over_the_whole_table(spark):
    part = spark.read.parquet(f"{LARGER}/part.parquet").where("p_partkey % 2 = 0")
    claims = part.select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type", F.lit("made in"), F.col("p_size") % 7)).collect()
    for least, most in ((0.7, 150), (0.7, 3), (0.5, 700)):
        got = planning.claim_pairs(spark.createDataFrame(claims, "claim_id long, subject string, text string"), least, most).collect()
        assert [tuple(r) for r in got] == brute_claims(claims, least, most)
    copies = [(k, f"s{k % 3}", "red hot iron" if k % 2 else "red hot iron bolt") for k in range(60)]
    got = planning.claim_pairs(spark.createDataFrame(copies, "claim_id long, subject string, text string"), 0.5, 7).collect()
    assert [tuple(r) for r in got] == brute_claims(copies, 0.5, 7)
    rulings = part.select("p_brand", "p_name", "p_partkey").collect()
    first = {}
    for family, reason, k in rulings:
        first[family, reason] = min(k, first.get((family, reason), k))
    for most in (3, 200, 5000):
        told = sorted((f, a, b) for (f, _), a in first.items() for (g, _), b in first.items() if f == g and a < b)[:most]
        got = planning.reason_pairs(spark.createDataFrame(rulings, "family string, reason string, id long"), most).collect()
        assert [tuple(r) for r in got] == told


def test_few_word_sets_of_many_claims(spark):
    n = 240_000  # 120,000 claims a word set: 14 milliard pairs, of which the first are wanted
    claims = spark.range(n).select(F.col("id").alias("claim_id"), F.concat(F.lit("s"), (F.col("id") / 2).cast("long") % 1000).alias("subject"), F.when(F.col("id") % 2 == 0, "red hot iron").otherwise("red hot iron bolt").alias("text"))
    began = time.time()
    got = [tuple(r) for r in planning.claim_pairs(claims, 0.5, 300).collect()]
    assert got == [(0, 1 + 2 * k, 0.75) for k in range(1, 301)] and time.time() - began < 120
    # An id may have two texts; what lacks an id, a subject or a text meets nothing.
    few = [(1, "a", "red hot iron bolt"), (6, "b", "red hot iron"), (6, "b", "red hot iron bolt"), (7, "b", "red hot iron"), (9, "a", "red hot iron bolt"), (None, "c", "red hot iron"), (8, None, "red hot iron"), (9, "c", None)]
    got = planning.claim_pairs(spark.createDataFrame(few, "claim_id long, subject string, text string"), 0.5, 2).collect()
    assert [tuple(r) for r in got] == [(1, 6, 0.75), (1, 7, 0.75)]
