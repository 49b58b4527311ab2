"""Set-similarity join by prefix, length and place, in DataFrame functions.

Items are ordered by rarity. Two sets of Jaccard similarity t or more share one of the n - ceil(t n) + 1 rarest items
of each, so only those are joined; a pair goes on if its sizes allow the similarity and, taking the shared item for
the first that both have, if as many items are left in both as they must share. What goes on is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Room for rounding in comparisons of fractions with a threshold.
_EPSILON = 1e-6


def by_rarity(sets: DataFrame, item: str = "items") -> DataFrame:
    """``sets`` (key, items) with ``items`` in order of (number of sets that hold it, item); sets without items are left out."""
    rows = sets.select("key", F.explode(item).alias("item"))
    counted = rows.groupBy("item").agg(F.count("*").alias("sets"))
    ordered = rows.join(counted, "item").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("sets", "item"))).alias("some"))
    return ordered.select("key", F.col("some.item").alias("items"))


def prefixes(ordered: DataFrame, least: float) -> DataFrame:
    """(item, key, items, n, place) of the items that a partner of similarity ``least`` must share one of; place from 0."""
    n = F.size("items")
    length = n - F.ceil(n * (least - _EPSILON)).cast("int") + 1
    rows = ordered.withColumn("n", n).select("key", "items", "n", F.posexplode(F.slice("items", 1, F.least(length, n))).alias("place", "item"))
    return rows.select("item", "key", "items", "n", "place")


def _possible(a: str, b: str, least: float) -> Column:
    """Sizes and places of two rows of ``prefixes`` allow the similarity."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = F.least(n_a, n_b) >= F.greatest(n_a, n_b) * (least - _EPSILON)
    left = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return sizes & (left * (1 + least - _EPSILON) >= (n_a + n_b) * (least - _EPSILON))


def candidates(sets: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (key_a, items_a, key_b, items_b), key_a < key_b, that prefixes, sizes and places let pass."""
    rows = prefixes(by_rarity(sets), least)
    met = rows.alias("a").join(rows.alias("b"), "item").where((F.col("a.key") < F.col("b.key")) & _possible("a", "b", least))
    return met.select(F.col("a.key").alias("key_a"), F.col("a.items").alias("items_a"), F.col("b.key").alias("key_b"), F.col("b.items").alias("items_b")).distinct()


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(key_a, key_b, score) of the pairs of sets (key, items without repeats) whose Jaccard similarity is ``least`` or more, rounded to six places.

    Sets without items have no partner; rows that share a key must be one set.
    """
    if not 0 < least <= 1:
        raise ValueError(f"a similarity is above 0 and at most 1: {least}")
    common = F.size(F.array_intersect("items_a", "items_b"))
    score = F.round(common / (F.size("items_a") + F.size("items_b") - common), 6)
    return candidates(sets, least).select("key_a", "key_b", score.alias("score")).where(F.col("score") >= least)
