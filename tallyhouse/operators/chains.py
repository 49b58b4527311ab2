"""Rows through a chain of joins, prefix by prefix, from key histograms. No join of rows is made.

The joins of a chain form a tree: each relation is joined onto one that stands before it. A relation sends a message
to the one it is joined onto: for each value of the join key, how many rows of its own subtree carry it. A message
has a row for each distinct key, so a hot key is one row however many rows it joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """One join of a chain: ``relation``, called ``name``, joined onto ``onto`` by ``keys`` (its column, own column)."""

    name: str
    relation: DataFrame
    onto: str
    keys: tuple[tuple[str, str], ...]
    how: str = "inner"


class _Chain:
    def __init__(self, name: str, relation: DataFrame, hops: list[Hop]):
        self.hops, self.root = hops, name
        self.relations = {name: relation}
        for hop in hops:
            if hop.how not in ("inner", "left"):
                raise ValueError(f"only inner and left joins are counted: {hop.how}")
            if hop.onto not in self.relations or hop.name in self.relations:
                raise ValueError(f"{hop.name} must be new and join onto a relation before it")
            self.relations[hop.name] = hop.relation
        own = {hop.name: [b for _, b in hop.keys] for hop in hops}
        onto = {n: [a for hop in hops if hop.onto == n for a, _ in hop.keys] for n in self.relations}
        self.columns = {n: list(dict.fromkeys([*own.get(n, []), *onto[n]])) for n in self.relations}
        # All prefixes count over the same histograms, so Spark makes each of them once (a reused exchange).
        self.histograms = {n: df.groupBy(*self.columns[n]).agg(F.count("*").alias("__n")) for n, df in self.relations.items()}

    def _children(self, name: str, last: int) -> list[tuple[int, Hop]]:
        return [(k, hop) for k, hop in enumerate(self.hops[: last + 1]) if hop.onto == name]

    def _keeps(self, hop: Hop, last: int) -> bool:
        """Does a row without a partner stay? Not where a later inner join needs a column of the partner."""
        return hop.how == "left" and all(self._keeps(below, last) for _, below in self._children(hop.name, last))

    def weighted(self, name: str, last: int) -> DataFrame:
        """The histogram of a relation with ``__rows``: rows of its subtree, among the first ``last + 1`` joins."""
        rows, weight = self.histograms[name], F.col("__n")
        for k, hop in self._children(name, last):
            message = self.weighted(hop.name, last).groupBy(*[F.col(b).alias(f"__key{k}_{i}") for i, (_, b) in enumerate(hop.keys)]).agg(F.sum("__rows").alias(f"__rows{k}"))
            met = reduce(lambda x, y: x & y, [F.col(a) == F.col(f"__key{k}_{i}") for i, (a, _) in enumerate(hop.keys)])
            keeps = self._keeps(hop, last)
            rows = rows.join(message, met, "left" if keeps else "inner")
            weight = weight * (F.coalesce(f"__rows{k}", F.lit(1)) if keeps else F.col(f"__rows{k}"))
        return rows.select(*self.columns[name], weight.alias("__rows"))

    def total(self, last: int) -> DataFrame:
        return self.weighted(self.root, last).agg(F.coalesce(F.sum("__rows"), F.lit(0)).alias("n_after"))


def chain_sizes(name: str, relation: DataFrame, hops: list[Hop]) -> DataFrame:
    """step, relation, n_before, n_after, ratio, verdict of each join of a chain.

    The verdict is ``fans_out`` (more rows than before), ``drops`` (fewer) or ``keeps``. NULL keys have no partner.
    Counts beyond 2**63 - 1 are an error.
    """
    chain = _Chain(name, relation, hops)
    steps = [chain.total(k - 1).select(F.lit(k).alias("step"), F.lit(hops[k - 1].name if k else name).alias("relation"), "n_after") for k in range(len(hops) + 1)]
    rows = reduce(DataFrame.union, steps).withColumn("n_before", F.lag("n_after").over(Window.orderBy("step")))  # one row for each join
    verdict = F.when(F.col("n_after") > F.col("n_before"), "fans_out").when(F.col("n_after") < F.col("n_before"), "drops").otherwise("keeps")
    ratio = F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before"))
    return rows.where("step > 0").select("step", "relation", "n_before", "n_after", ratio.alias("ratio"), verdict.alias("verdict"))
