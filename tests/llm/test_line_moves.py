"""What the line join moves between tasks: no set that sizes, places or bitmaps have ruled out."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyhouse.llm import lines
from tallyhouse.llm import words as W
from tallyhouse.llm.scratch import bound_batches


def test_packed_planes_are_read_back():
    draw = np.random.default_rng(5)
    sizes = np.array([3, 1, 7])
    for width in (1, 2, 3, 6):
        values = draw.integers(0, 1 << 8 * width, 11, np.uint64)
        packed = lines._packed_planes(values, width, sizes)
        assert lines._unpacked_planes(packed, width).tolist() == values.tolist()
        assert lines._unpacked_planes(packed.slice(1), width).tolist() == values[3:].tolist()
    high = lines._packed_planes(np.array([258, 259, 260], np.uint64), 2, np.array([3]))
    assert high[0].as_py() == bytes([2, 3, 4, 1, 1, 1])


def test_members_of_long_lists_that_can_meet_none_stay_out(spark):
    bound_batches(spark)
    common = [f"c{k}" for k in range(5)]  # one shingle in lines of 40 sizes, no two of which are near
    rows = [(k, " ".join([*common, *(f"w{k}.{j}" for j in range(round(5 * 1.4**k)))])) for k in range(24)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.xxhash64("doc_id"))
    stored = lines._stored(keyed, 5)
    found = lines._candidates(stored, *lines.rarity(stored), (0, 23))
    assert found.count() == 0


def test_only_ends_of_close_pairs_are_moved(spark):
    bound_batches(spark)
    sets = spark.range(20_000).select(F.xxhash64("id").alias("set_hash"), "id")
    some = sets.where("id % 1000 = 0")
    found = lines._marked(sets, some.select("set_hash"), "set_hash", 25)
    assert found.where("id % 1000 = 0").count() == 20 and found.count() < 400


def test_codes_of_short_words_tell_words_apart():
    made = [f"{a}{b}" for a in ("", "a", "é", "x" * 31, "x" * 32, "x" * 900) for b in range(300)] + ["ab", "ba", "a\0", "a"]
    codes = W.short_codes(pa.array([*made, *made]).slice(0, 2 * len(made)))
    assert len(set(codes[: len(made)].tolist())) == len(made) and (codes[: len(made)] == codes[len(made) :]).all()
    assert W.short_codes(pa.array(["zz", *made]).slice(1)).tolist() == codes[: len(made)].tolist() and len(W.short_codes(pa.array([], pa.string()))) == 0
