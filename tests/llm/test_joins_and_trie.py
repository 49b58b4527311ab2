"""The count-vector join, spelling variants and the prefix trie against plain Python, and on odd tables."""

import random
import zlib

import brute
import numpy as np
import pytest

from tallyhouse.llm import countjoin, prefixtrie, variants

DOCS, TURNS = "doc_id long, text string", "conv_id long, turn long, role string, text string"


def drawn(seed, n=70):
    """Texts of few words, near copies of each other in chains, with nulls, empty and repeated ones."""
    draw = random.Random(seed)
    rows, texts = [], ["", None, "one", "Two words", " \t\n"]
    for _ in range(6):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice((4, 12, 60, 300)))]
        for _ in range(n // 6):
            base = list(base)
            for _ in range(draw.randrange(max(2, len(base) // 30))):
                base[draw.randrange(len(base))] = f"x{draw.randrange(50)}"
            texts.append(" ".join(base))
    texts += draw.sample(texts, 8)
    draw.shuffle(texts)
    return [(k * 3, t) for k, t in enumerate(texts)] + rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_brute_force(spark, seed):
    rows = drawn(seed)
    got = sorted(tuple(r) for r in countjoin.join_near(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [r[:3] for r in brute.components(rows, 80)]
    assert len({r[2] for r in got}) < len(got) - 20


def test_summed_minima_bound_overlaps():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)) for size in (1, 40, 700, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], draw.integers(0, 1 << 63, len(s) // 10 + 1, dtype=np.uint64)])) for s in sets]
    hashes, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    counts, at = countjoin.count_points(hashes, of, len(sets))
    assert np.diff(at).tolist() == [64, 64, 128, 1024] * 2
    import pyarrow as pa

    points = [counts[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            most = countjoin.summed_minima(pa.array([points[i]]), pa.array([points[j]]))[0]
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))


def test_join_of_a_group_of_near_copies_and_leaves_apart(spark):
    base = [f"a{k}" for k in range(100)]
    rows = [(k, " ".join([*base[: 3 + k % 3], f"own{k}", *base[4 + k % 3 :]])) for k in range(60)]  # near each other
    rows += [(1000 + k, " ".join([*base[:70], *(f"b{k}-{j}" for j in range(30))])) for k in range(60)]  # they share most, and are not
    got = sorted(tuple(r) for r in countjoin.join_near(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [r[:3] for r in brute.components(rows, 80)]


def test_join_of_odd_tables(spark):
    assert countjoin.join_near(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(None, "same words in both of them here"), (4, "Same words in both of them here"), (4, "Same words in both of them here"), (7, None), (8, ""), (9, long), (10, long + " end")]
    odd = spark.createDataFrame([(*r, "mine", 5) for r in rows], DOCS + ", set_hash string, n long")
    got = sorted((tuple(r) for r in countjoin.join_near(odd).collect()), key=repr)
    assert got == sorted([(None, 3, 4), (4, 3, 4), (4, 3, 4), (7, 0, 7), (8, 0, 8), (9, 5000, 9), (10, 5001, 9)], key=repr)


def words(seed, n=400):
    draw = random.Random(seed)
    letters = "aeinrstéöÀ×"
    made = ["".join(draw.choice(letters) for _ in range(draw.randrange(5, 9))) for _ in range(40)]
    for _ in range(120):
        w = draw.choice(made)
        k = draw.randrange(len(w))
        made.append(draw.choice((w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k:], w[:k] + draw.choice(letters) + w[k + 1 :], w[:k][::-1] + w[k:])))
    weight = [draw.random() ** 6 for _ in made]
    return [(draw.choice((None, k)), draw.choice((" ", "-", "\n", "1")).join(w.upper() if draw.random() < 0.2 else w for w in draw.choices(made, weight, k=60))) for k in range(n)]


@pytest.mark.parametrize("seed", [3, 4])
def test_variants_are_brute_force(spark, seed):
    rows = [*words(seed), (1, None), (2, ""), (3, "x" * 3000 + " short"), *[(4, "y" * 700)] * 6]
    rows += [(500 + k, "stonesets " * 20 + ("stoneset " * 3 if k % 2 else "") + ("stonese" if k < 6 else "")) for k in range(20)]  # a chain of two steps
    counted = variants.count_words(spark.createDataFrame(rows, DOCS), slips=True).where(f"n >= {variants.LEAST_COUNT}")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(counted).collect()}
    assert got == brute.variants(rows)
    assert sum(v[0] is not None for v in got.values()) > 10 and any(v[1] not in (v[0], w) for w, v in got.items())


def test_checksums_of_joined_parts():
    heads, tails = [b"", b"12:", b"-7:"], [b"a", "é".encode() * 90, b"z" * 254, b"z" * 255, b"z" * 256, b"z" * 9000]
    doc, code = np.repeat(np.arange(3), 6), np.tile(np.arange(6), 3)
    assert variants._checksums(heads, doc, tails, code).tolist() == [zlib.crc32(heads[d] + tails[c]) for d, c in zip(doc, code, strict=True)]


def test_rows_of_near_words_meet():
    draw = random.Random(9)
    for _ in range(3000):
        a = "".join(draw.choice("abcé") for _ in range(draw.randrange(1, 9)))
        k = draw.randrange(len(a))
        b = draw.choice((a[:k] + a[k + 1 :], a[:k] + draw.choice("abcé") + a[k:], a[:k] + draw.choice("abcé") + a[k + 1 :]))
        if b and brute.one_apart(a, b):
            x, y = variants.anagram_rows(a), variants.anagram_rows(b)
            assert any(r[:2] == s[:2] and not (r[2] and s[2]) for r in x for s in y), (a, b)


def test_variants_of_odd_tables(spark):
    empty = variants.count_words(spark.createDataFrame([], DOCS), slips=True)
    assert variants.group_variants(empty).count() == 0
    odd = spark.createDataFrame([(1, "letters letters", "mine")], DOCS + ", n string")
    assert [tuple(r) for r in variants.count_words(odd).collect()] == [("letters", 2)]


def conversations(seed, n=60):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if draw.random() < 0.15:
            continue
        for t in range(draw.choice((1, 2, 3, 9, 20, 40))):
            rows.append((c, draw.choice((t, t, t, None, 3)), draw.choice(("user", "user", None)), draw.choice(("hello", "é ü", "", None, "go on"))))
    return [*rows, *rows[:30], (None, 1, "user", "lost")]


@pytest.mark.parametrize(("seed", "share"), [(1, True), (2, True), (3, False)])
def test_trie_is_brute_force(spark, seed, share):
    rows = conversations(seed)
    found = prefixtrie.conversation_trie(spark.createDataFrame(rows, TURNS), share).collect()
    assert sorted((tuple(r)[:8] for r in found), key=lambda r: (r[0], r[1])) == brute.trie(rows, share)
    by_start = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == list(range(len(found)))
    for r in found:  # an interval holds the subtree: as many childless nodes as were counted
        assert sum(s["n_children"] == 0 for s in by_start[r["start"] : r["end"] + 1]) == r["n_leaves"]


def test_trie_of_odd_tables(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], TURNS), share=True).count() == 0
    long = [(5, k, "user", f"turn {k}") for k in range(700)] + [(10, k, "user", f"turn {k}") for k in range(300)]
    odd = spark.createDataFrame([(*r, "mine", 1) for r in long], TURNS + ", label string, pos long")
    found = {r["depth"]: r for r in prefixtrie.conversation_trie(odd).collect()}
    assert len(found) == 701 and found[0]["saved_tokens"] == sum(len(r[3]) for r in long[700:])
    assert found[300]["ends_sha256"] == brute.sha("10") and found[300]["conv_id"] == 5 and found[0]["n_leaves"] == 1
    turnless = [(c, 1, "user", "a") for c in range(6, 10)]  # some take all turns from conversation 5, which is absent
    assert [tuple(r)[:8] for r in prefixtrie.conversation_trie(spark.createDataFrame(turnless, TURNS), share=True).collect()] == brute.trie(turnless)
