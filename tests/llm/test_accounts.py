"""Account numbers: the length of their country ends them, whatever follows."""

import random

import pytest

from tallyhouse.llm import pii

GOOD = ["DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "FR14 2004 1010 0505 0001 3M02 606", "BE68 5390 0754 7034"]
AFTER = ["", ".", ", then", " EUR 500", " OK", " BIC COBADEFF", " 2024", "\n12", " A B C", "-x", " é"]


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x.startswith("iban")] for r in pii.digest(pii.find_spans(docs)).collect()}


def test_numbers_end_where_their_country_ends_them(spark):
    texts = [f"pay {form}{after}" for one in GOOD for form in (one, one.lower()) for after in AFTER]
    got = spans(spark, texts)
    for k, text in enumerate(texts):
        one = GOOD[k // (2 * len(AFTER))]
        assert got[k] == [["iban", "4", str(4 + len(one))]], text


@pytest.mark.parametrize("change", ["digit", "length", "glued", "country", "grouping"])
def test_what_is_no_number_is_left_alone(spark, change):
    draw = random.Random(1)
    texts = []
    for one in GOOD:
        k = draw.choice([i for i, c in enumerate(one) if c.isdigit() and i > 3])
        texts.append({"digit": one[:k] + str((int(one[k]) + 1) % 10) + one[k + 1 :], "length": one[:-1], "glued": "x" + one, "country": "ZZ" + one[2:], "grouping": one.replace(" ", "")[:5] + " " + one.replace(" ", "")[5:]}[change])
    assert all(not found for found in spans(spark, texts).values())


def test_two_numbers_in_a_row(spark):
    assert spans(spark, [f"{GOOD[0]} {GOOD[1]} {GOOD[2]}"])[0] == [["iban", "0", "22"], ["iban", "23", "45"], ["iban", "46", "73"]]
