"""Leaks of unusual items: many numbers, equal values drawn anew, names at the start of a sentence."""

from tallyhouse.llm import decontaminate


def leaks(spark, items, docs):
    found = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r["doc_id"], r["item_id"], r["kind"]) for r in found.collect()}


def test_items_of_many_numbers(spark):
    items = ["Compute 12 + 30 + 45 + 18 + 27 + 33 + 41", "10 20 30 40", "A 3 m by 4 m by 5 m by 6 m by 7 m box holds how many small cubes"]
    docs = [f"We read here: {item} and so on." for item in items]
    other = ["We read: Compute 13 + 31 + 46 + 19 + 28 + 34 + 42 and", "rows 10 20 30 50 of"]
    assert leaks(spark, items, docs + other) == {(0, 0, "exact"), (1, 1, "exact"), (2, 2, "exact")}


def test_equal_values_drawn_anew(spark):
    items = [
        "the first farm sells 12 fresh eggs to the near shop every day while the second farm sends 12 old hens to the far market",
        "a short walk takes them 2 hours on the road and a longer walk takes them 3 hours on the hill",
    ]
    docs = [
        "so the first farm sells 12 fresh eggs to the near shop every day while the second farm sends 13 old hens to the far market",
        "and a short walk takes them 1 hour on the road and a longer walk takes them 2 hours on the hill",
    ]
    assert leaks(spark, items, docs) == {(0, 0, "reparameterised"), (1, 1, "reparameterised")}


def test_names_at_the_start_of_a_sentence(spark):
    items = ["Tom has 3 red apples. Tom buys 4 more apples. Tom eats 2 apples."]
    docs = ["Bob has 3 red apples. Bob buys 4 more apples. Bob eats 2 apples.", "tom has 3 red apples. tom buys 4 more apples. tom eats 2 apples.", "Rain fell. Bob sold 3 red boats. Bob lost 4 old coins. Bob ate 2 pears."]
    assert leaks(spark, items, docs) == {(0, 0, "reparameterised"), (1, 0, "exact")}
