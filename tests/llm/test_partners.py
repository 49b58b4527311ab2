"""The tree join takes a few partners of each set and list in a round, and loses no component."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import countjoin


def near_copies(n, seed=11):
    draw = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(n):
        words = list(base)
        for j in range(draw.randrange(2, 5)):
            words[draw.randrange(40, 150)] = f"x{k}.{j}"
        rows.append((k, " ".join(words)))
    return rows


def test_best_partners_are_those_of_the_highest_score():
    a, b = np.array([7, 7, 5, 7, 5]), np.array([1, 2, 3, 4, 6])
    got = countjoin.best_partners(a, b, np.array([0.2, 0.9, 0.5, 0.8, 0.5]), np.zeros(5, bool), 2)
    assert [x.tolist() for x in got] == [[5, 5, 7, 7], [3, 6, 2, 4], [0.5, 0.5, 0.9, 0.8], [False, False, True, True]]
    assert [len(x) for x in countjoin.best_partners(*(x[:0] for x in got), 2)] == [0] * 4


def test_a_group_of_near_copies_makes_rows_in_proportion(spark, monkeypatch):
    made, members, tree = [], [], countjoin._from_tree

    def counted(leaves, most):
        found = tree(leaves, most)
        made.append((most, found.count(), tree(leaves, 1 << 30).count()))
        members.append(leaves.agg(F.sum(F.size("sets"))).first()[0])
        return found

    monkeypatch.setattr(countjoin, "_from_tree", counted)
    monkeypatch.setattr(countjoin, "LEADERS", 1)
    rows = near_copies(400)
    got = sorted(tuple(r) for r in countjoin.join_near(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [r[:3] for r in brute.components(rows, 80)]
    assert made and made[0][0] == countjoin.PARTNERS
    assert all(n <= most * held for (most, n, _), held in zip(made, members, strict=True)) and 4 * made[0][1] < made[0][2]
