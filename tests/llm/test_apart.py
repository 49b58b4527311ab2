"""What the leaders of a bucket leave apart is compared by blocks, without a round of its own where the pairs are few."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import minhash


def near_copies(n, seed=5):
    draw = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(n):
        words = list(base)
        for j in range(draw.randrange(2, 9)):
            words[draw.randrange(150)] = f"x{k}.{j}"
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("changed", [{}, {"BLOCK": 16, "PAIRS_AT_ONCE": 100}, {"PAIRS_A_MEMBER": 0, "BLOCK": 16}, {"BROADCAST_BUCKETS": -1, "BLOCK": 16, "PARTNERS": 1, "MORE": 2}])
def test_near_copies_that_are_mostly_apart(spark, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(minhash, name, value)
    joined, find = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: joined.append(1) or find(links))
    rows = near_copies(300)
    want = brute.components(rows)
    assert 20 < len({r[2] for r in want}) < 280
    assert sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want
    assert len(joined) > 2 if {"PAIRS_A_MEMBER", "PARTNERS"} & changed.keys() else len(joined) == 2


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_blocks_meet_whatever_the_batches(monkeypatch, at_once):
    monkeypatch.setattr(minhash, "PAIRS_AT_ONCE", at_once)
    draw, want, rows = random.Random(3), set(), []
    sig = [np.int64(draw.getrandbits(63)) for _ in range(8)]
    for group in range(40):
        low = draw.randrange(3)
        high = low + draw.randrange(2)
        own = sorted((draw.choice([low, high]), draw.randrange(-(10**6), 10**6), draw.randrange(4), draw.choice([90, 100, 130, 200])) for _ in range(draw.choice([1, 2, 9, 30])))
        for i, (block, name, label, n) in enumerate(own):
            bits = [draw.getrandbits(3)] * 32  # bitmaps of two sets differ in 0 to 96 places
            rows.append({"key": group // 3, "low": 10 * (group % 3) + low, "high": 10 * (group % 3) + high, "block": 10 * (group % 3) + block, "set_hash": name, "label": label, "n": n, "sig": sig, "bitmap": bits, "bands": [draw.randrange(1000, 1003), *range(100 * i, 100 * i + 30), group // 3]})
            for one in rows[-1 - i : -1]:
                differ = 32 * (one["bitmap"][0] ^ bits[0]).bit_count()
                most = (one["n"] + n - differ) // 2
                # a pair that shares an earlier band is told by that one's bucket
                if one["bands"][0] != rows[-1]["bands"][0] and (low == high or one["block"] != rows[-1]["block"]) and one["label"] != label and 4 * min(n, one["n"]) >= 3 * max(n, one["n"]) and 4 * most >= 3 * (one["n"] + n - most):
                    want.add((min(name, one["set_hash"]), max(name, one["set_hash"])))
    table = pa.Table.from_pylist(rows)
    for size in (1, 13, 1000):
        got = {(r["a"], r["b"]) for batch in minhash._compare(iter(table.to_batches(max_chunksize=size)), 1 << 30) for r in batch.to_pylist()}
        assert got == want and want
    assert list(minhash._compare(iter([]), 1)) == []


def test_each_component_gets_its_best_pairs():
    group, score = np.array([4, 9, 4, 4, 9]), np.array([3, 1, 8, 5, 1])
    assert minhash._best(group, score, 1).tolist() == [False, True, True, False, False]
    assert minhash._best(group, score, 2).tolist() == [False, True, True, True, True]
