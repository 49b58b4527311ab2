"""Words of one length are merged together, with the result of one by one."""

import random

from tallyhouse.llm import bpe, queries


def test_merging_together_is_merging_one_by_one():
    model, draw = bpe.Model(queries.TOKENIZER), random.Random(4)
    parts = ["the", "ing", "str", "aa", "é", "ß", "\0", "z", "中", "tion", "ab", "e", "t", "1", "-"]
    words = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 9))).encode() for _ in range(4000)]
    words += [b"a" * k for k in range(80)] + [b"", b"x"] + [b"aaaa", b"abababab"] * 30
    words += [bytes(draw.randrange(256) for _ in range(draw.randrange(0, 60))) for _ in range(1000)]
    assert model.merge_all(words) == [model.merge(w) for w in words]
    assert model.merge_all([]) == []
