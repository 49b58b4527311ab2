"""Lines that share most of their shingles and are not near: long lists meet by size and place."""

import time

import brute
from pyspark.sql import functions as F

from tallyhouse.llm import lines


def edited(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("this u"), "id", F.lit(" page was last edited by the site team on monday")).alias("text"))


def test_a_hundred_thousand_lines_of_one_template(spark):
    took = []
    for n in (3_000, 10_000, 100_000):  # the first run warms up
        began = time.time()
        found = lines.deduplicate_lines(edited(spark, n)).agg(F.sum("n_lines_removed"), F.count("*")).first()
        took.append(time.time() - began)
        assert tuple(found) == (0, n)
    assert took[2] < 10 * took[1] and took[2] < 180


def test_long_lists_lose_no_near_line(spark):
    head = [f"h{k}" for k in range(24)]
    rows = []
    for k in range(120):  # lists of more than a few sets, of several sizes, some near each other
        own = [f"o{k // 3}", *([f"p{k}"] if k % 3 == 1 else [])]
        rows.append((k, " ".join([*own, *head[: 12 + k % 7]])))
    want = {r: text for r, text in brute.kept_lines(rows).items()}
    got = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {doc: kept for (doc, _), kept in want.items()}
