"""A walk that a bound would cut raises; without a bound it walks to the end."""

import pytest

from tallyhouse.operators import graph


def test_bounds_raise(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(7)], "node string")
    assert graph.closure(edges).count() == 21
    assert {r["node"]: r["level"] for r in graph.levels(nodes, edges).collect()} == {f"n{k}": k for k in range(7)}
    with pytest.raises(RuntimeError):
        graph.closure(edges, 3)
    with pytest.raises(RuntimeError):
        graph.levels(nodes, edges, 3)
