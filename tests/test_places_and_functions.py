"""The radius join at poles and over the antimeridian, and functions of our own, against plain forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import geo, registered
from tallyhouse.operators import analytics

POINTS = "id int, lat double, lon double"


def metres(a, b):
    half = lambda x: math.sin(math.radians(x) / 2) ** 2
    return 2 * geo.EARTH * math.asin(math.sqrt(min(1.0, half(b[0] - a[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(b[1] - a[1]))))


def points(seed, n=220):
    draw = random.Random(seed)
    out = [(90.0, 0.0), (-90.0, 33.0), (89.99, 180.0), (0.0, 180.0), (0.0, -180.0), (0.0, 0.0), (45.0, 179.999), (45.0, -179.999)]
    for _ in range(n):
        out.append((draw.choice((draw.uniform(-90, 90), draw.uniform(80, 90), draw.uniform(-90, -85), draw.gauss(0, 3))), draw.choice((draw.uniform(-180, 180), draw.uniform(175, 185), draw.gauss(0, 3)))))
    return [(k, max(-90.0, min(90.0, lat)), lon) for k, (lat, lon) in enumerate(out)]


@pytest.mark.parametrize("radius", [1_000.0, 90_000.0, 1_200_000.0, 9_000_000.0])
def test_radius_join_is_brute_force(spark, radius):
    left, right = points(1), points(2)
    frames = [spark.createDataFrame(rows, POINTS) for rows in ([*left, (900, None, 1.0), (901, 1.0, None), (902, 91.0, 0.0)], right)]
    met = geo.radius_join(frames[0], frames[1].select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b")), ("lat", "lon"), ("lat_b", "lon_b"), radius).select("id", "id_b").collect()
    got = sorted(map(tuple, met))
    assert got == sorted((a[0], b[0]) for a in left for b in right if metres(a[1:], b[1:]) <= radius)


def test_one_full_cell_is_dealt_over_tasks(spark):
    """All rows lie by a pole, read by one task; many share a place."""
    n, m = 24_000, 3_000
    left = spark.range(0, n, 1, 1).select("id", (89.5 + F.col("id") % 4000 / 10_000).alias("lat"), (F.col("id") % 360).cast("double").alias("lon")).withColumn("lon", F.when(F.col("id") < 3_000, 7.0).otherwise(F.col("lon"))).withColumn("lat", F.when(F.col("id") < 3_000, 90.0).otherwise(F.col("lat")))
    right = spark.range(0, m, 1, 1).select(F.col("id").alias("id_b"), (89.2 + F.col("id") % 100 / 200).alias("lat_b"), (F.col("id") * 7 % 360).cast("double").alias("lon_b"))
    met = geo.radius_join(left, right, ("lat", "lon"), ("lat_b", "lon_b"), 700_000.0)
    by_task = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == n * m and max(by_task) <= n * m / 2
    assert met.where("id_b % 1000 = 0").groupBy("id", "id_b").count().agg(F.count("*"), F.max("count")).first() == (3 * n, 1)
    few = geo.radius_join(left.where("id % 1000 = 1"), right.where("id_b < 5").withColumnRenamed("id_b", "id"), ("lat", "lon"), ("lat_b", "lon_b"), 40_000.0, lambda c: F.floor(c * 10 + 0.5) / 10)
    assert few.columns == ["id", "lat", "lon", "id", "lat_b", "lon_b", "metres"]
    want = [(a[1:], b[1:], metres(a[1:], b[1:])) for a in left.where("id % 1000 = 1").collect() for b in right.where("id_b < 5").collect()]
    assert sorted((r[1:3], r[4:6], r[6]) for r in few.collect()) == sorted((a, b, math.floor(x * 10 + 0.5) / 10) for a, b, x in want if x <= 40_000)


def test_a_point_is_looked_up_in_few_cells(spark):
    frame = spark.createDataFrame([p for p in points(3, 400) if abs(p[1]) < 80], POINTS)
    cells = geo.Cells(5_000.0)
    assert frame.select(F.max(F.size(cells.near(F.col("lat"), F.col("lon"))))).first()[0] <= 12
    with pytest.raises(ValueError):
        geo.Cells(0)


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 1.0])
def test_ceil_rank_is_the_sorted_value(spark, p):
    draw = random.Random(5)
    rows = [(draw.choice(("a", None)), draw.choice((None, float("nan"), draw.gauss(0, 1) ** 5, 7.0, 1e300))) for _ in range(3000)] + [("one", -1.5), ("none", None)]
    got = {r["k"]: (r["n"], r["value"]) for r in registered.ceil_rank(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", p).collect()}
    want = {}
    for k in ("a", None, "one"):
        values = sorted(x for key, x in rows if key == k and x is not None and not math.isnan(x))
        want[k] = (len(values), values[max(1, math.ceil(len(values) * p)) - 1])
    assert got == want


def test_spaced_rows(spark):
    rows = [("a", 0), ("a", 50), ("a", 100), ("a", 149), ("a", 200), ("b", 7), ("b", 7), ("b", None), ("c", None)]
    got = registered.spaced(spark.createDataFrame(rows, "k string, s long"), ["k"], "s", 100).collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("a", 100), ("a", 200), ("b", 7)]
    registered.register(spark)
    spark.createDataFrame([("x", 3, 4)], "g string, bin int, n long").createOrReplaceTempView("histogram_of_one")
    assert spark.sql("select quantile_bin(bin, n, 2L) q from histogram_of_one group by g").first()["q"] == [3, 0]


def test_tests_that_outrun_their_source(spark):
    lineage = spark.createDataFrame([("b", "a", True, False), ("c", "b", True, False), ("d", "c", True, True), ("e", "c", False, False), ("f", "p", True, False), ("p", "a", True, False), ("g", "b", True, False), ("g", "z", True, False)], "column string, parent string, carried boolean, guarded boolean")
    measured = spark.createDataFrame([("a", 3, 10), ("p", 0, 10), ("z", 1, 10)], "column string, nulls long, n long")
    tests = spark.createDataFrame([(c,) for c in "abcdefgz"], "column string")
    got = sorted((r["column"], r["origin"], r["hops"]) for r in analytics.outrun_tests(tests, lineage, measured).collect())
    assert got == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("g", "z", 1), ("z", "z", 0)]


def test_a_build_that_skipped(spark):
    models = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    tests = spark.createDataFrame([("ta", "a"), ("tb", "b"), ("tc", "c"), ("td", "d"), ("free", None)], "test string, attached string")
    outcomes = spark.createDataFrame([("b", "error", 5), ("ta", "fail", 5), ("tb", "pass", 5), ("tc", "pass", 5), ("td", "pass", 1), ("td", "skipped", 6), ("free", "warn", 9), ("ta", "skipped", 12)], "unit string, status string, at int")
    got = analytics.build_coverage(models, tests, outcomes, edges, 4, 10).first().asDict()
    assert got == {"models": 4, "models_skipped": 1, "models_with_a_test_declared": 4, "models_an_assertion_ran_on": 2, "tests_declared": 5, "tests_that_ran": 3, "tests_that_did_not_run": 2}
