"""Clashing names, shared doc_ids and very long texts, for the operators and the stages."""

import time

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, langid, lines, minhash, pii, scratch

SCHEMA = "doc_id long, text string"
CLASHES = ("n_lines", "n_lines_removed", "score", "lang_pred", "pii", "row", "line", "hash", "kept", "component_id", "token", "size")


def words(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_personal_data_in_a_text_of_many_numbers(spark):
    numbers = ", ".join(str(k % 10_000 + 10) for k in range(100_000))
    hosts = "; ".join(f"10.0.{k % 256}.{k // 256}" for k in range(20_000))
    docs = spark.createDataFrame([(1, numbers), (2, hosts)], SCHEMA)
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digest(pii.find_spans(docs)).collect()}
    assert time.time() - began < 60
    assert (got[1]["n_ip"], got[2]["n_ip"]) == (0, 20_000)
    for doc, text in ((1, numbers), (2, hosts)):
        assert got[doc]["base_sha256"] == brute.sha(brute.base_spans(text))


def test_context_on_both_sides(spark):
    docs = spark.createDataFrame([(1, "4539 1488 0343 6467 is my visa"), (2, "4539 1488 0343 6467 is a number"), (3, "host 10.0.0.1, 10.0.0.2 and" + " far" * 20 + " 10.0.0.3")], SCHEMA)
    got = {r["doc_id"]: [round(s["score"], 2) for s in r["pii"]] for r in pii.find_spans(docs).collect()}
    assert got == {1: [0.9], 2: [0.7], 3: [0.8, 0.8, 0.6]}


def test_redact_keeps_a_column_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "write to a@b.cd", "mine")], SCHEMA + ", pii string")
    assert pii.redact(docs).first().asDict() == {"doc_id": 1, "text": "write to <EMAIL>", "pii": "mine"}


def test_rows_that_share_a_doc_id(spark):
    rows = [(3, words("a")), (5, words("a") + " more"), (5, words("own")), (None, words("a")), (7, None), (7, None)]
    kept = minhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(3, words("a")), (5, words("own")), (None, words("a")), (7, None)], key=repr)
    items = spark.createDataFrame([(1, words("a"))], "item_id long, text string")
    kept = decontaminate.decontaminate(spark.createDataFrame(rows[1:3], SCHEMA), items).collect()
    assert [tuple(r) for r in kept] == [(5, words("own"))]


def test_slots_are_consistent_both_ways(spark):
    item = "a train leaves at 31 and another train leaves at 57 from the same old station in town"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("31", "44").replace("57", "68")), (2, item.replace("31", "44").replace("57", "44"))], SCHEMA)
    told = {r["doc_id"]: r["n_matched"] for r in decontaminate.find_leaks(docs, items).collect()}
    assert told[1] > told.get(2, 0)


def test_a_rare_language_is_learned(spark):
    rows = [(k, f"the house and the tree of {k} was there", "en") for k in range(3000)] + [(k, f"zxq vvw qqj zxqa {k} vvwq jjx", "xx") for k in range(3000, 3030)]
    filters = langid.fit(spark.createDataFrame(rows, SCHEMA + ", lang string"), fit_docs=200)
    assert filters.langs == ["en", "xx"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, f"the house and the tree of {k} was there\n{words(f'w{k}', 12)}\nthe same line stands in every one of them") for k in range(40)]
    docs = spark.createDataFrame([*rows, (40, None), (41, ""), rows[0]], SCHEMA).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit(f"my {c}") for c in CLASHES})


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns(spark, data, clashing, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, clashing, data)
    assert out.columns == clashing.columns
    kept = out.collect()
    assert kept and all(r[c] == f"my {c}" for r in kept for c in CLASHES)
    assert out.limit(0).columns == clashing.columns and dict(corpus_pipeline.STAGES)[stage](spark, clashing.limit(0), data).count() == 0


def test_line_counts_replace_columns_of_their_names(spark, clashing):
    out = lines.deduplicate_lines(clashing)
    assert {r["n_lines_removed"] for r in out.where("doc_id between 1 and 39").select("n_lines_removed").distinct().collect()} == {1}
    assert out.where("doc_id = 40").first()["n_lines"] == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        scratch.root(Session())
