"""Slots along an alignment, and short items."""

from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate

ITEM = "Yesterday Sara has 15 red marbles and gives away some of them to her friends in the park near the river . Later on in the week Sara buys 15 more marbles in the shop around the corner of the street"


def leaks(spark, docs, items=None):
    items = items or [(1, ITEM)]
    found = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["kind"]) for r in found.collect()}


def test_one_value_for_one_value_along_an_alignment(spark):
    same = ITEM.replace("Sara", "Lena").replace("15", "21")
    first, second = same[: len(same) // 2], same[len(same) // 2 :]
    other = first + second.replace("Lena", "Otto").replace("21", "99")
    got = leaks(spark, [ITEM, same, other])
    n = got[0, 1][0]
    assert got[0, 1] == (n, n, "exact") and got[1, 1] == (n, n, "reparameterised")
    assert got[2, 1][1] < n  # windows that hold the other name or number contradict the binding, and only those go
    assert got[2, 1][1] >= n - 2 * 8 and got[2, 1][2] == "reparameterised"


def test_two_values_for_one_are_no_leak(spark):
    item = "if box one has 12 and box two has 12 then all of them have 12 in 12 rows of 12"
    torn = item
    for k, value in enumerate((31, 42, 53, 64, 75)):
        torn = torn.replace("12", str(value), 1) if k == 0 else torn.replace(" 12", f" {value}", 1)
    got = leaks(spark, [item.replace("12", "77"), torn], [(1, item)])
    assert (0, 1) in got and got.get((1, 1), (0, 0))[1] < got[0, 1][1] / 2


def test_short_items_match_whole_texts_only(spark):
    items = [(1, "Two trains"), (2, "7 apples"), (3, "Hello!"), (4, ""), (5, "...")]
    got = leaks(spark, ["two trains", "  Two, trains. ", "two trains meet", "8 apples", "7 apples", "hello", "hello hello", "", None, "..."], items)
    assert set(got) == {(0, 1), (1, 1), (4, 2), (5, 3)} and all(v == (1, 1, "exact") for v in got.values())


def brute_windows(text, size=8):
    words = [decontaminate.canonical(w) for w in text.split()]
    return [tuple(w[0] for w in words[k : k + size]) for k in range(len(words) - size + 1)]


def test_template_windows_are_brute_force(spark):
    texts = ["we saw 3 cats and 4 dogs in the yard of the old house by 9 km of road", "they saw 5 cats and 6 dogs in the yard of the old house by 7 miles of road", "nothing like it is told in this text of some words that go on and on here", "and 8 dogs in the yard of the old house by the sea"]
    items = [(k, t) for k, t in enumerate(texts[:1])]
    got = leaks(spark, texts, items)
    wanted = set(brute_windows(texts[0]))
    for k, text in enumerate(texts):
        hits = sum(w in wanted for w in set(brute_windows(text)))
        leak = hits >= decontaminate.LEAST_WINDOWS or hits >= decontaminate.LEAST_SHARE * len(brute_windows(texts[0]))
        assert ((k, 0) in got) == leak and (not leak or got[k, 0][1] == hits)


def test_rows_of_alignments_are_counted_once(spark):
    got = decontaminate.find_leaks(spark.createDataFrame([(1, ITEM), (1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string"))
    assert got.agg(F.count("*")).first()[0] == 1
