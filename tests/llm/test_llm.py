"""Each operator against brute force, the library it must equal, or held-out labels; and its edge cases."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, decontaminate, imatch, langid, licenses, lines, minhash, pii, queries, scratch, sharding, substrings
from tallyhouse.llm.lexicon import Lexicon, compile_words, save

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def made(seed, n=120, vocabulary=14):
    """Small documents with copies, near copies, shared passages, periodic text, empty and null texts, and repeated rows."""
    chance = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["The", "é", "日本"]
    some = lambda n: [chance.choice(vocab) for _ in range(n)]
    passage, out = some(60), []
    for doc in range(n):
        w, kind = some(chance.randint(0, 90)), chance.random()
        if kind < 0.3:
            at = chance.randint(0, len(w))
            w = w[:at] + passage[chance.randint(0, 15) : chance.randint(45, 60)] + w[at:]
        elif kind < 0.4:
            w = ["x", "y"] * chance.randint(5, 40)
        elif kind < 0.7 and out and out[-1][1]:
            w = (chance.choice(out)[1] or "").replace("\n", " ").split()
            if w and chance.random() < 0.7:
                w[chance.randrange(len(w))] = f"edit{doc}"
        text = " ".join(w)
        for _ in range(chance.randint(0, 3)):
            text = text.replace(" ", "\n", chance.randint(0, 4))
        out.append((doc, text))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n\t ")]


@pytest.fixture(scope="module")
def rows():
    return made(3)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


# -- sharding


@pytest.mark.parametrize("source", ["documents", "hot"])
def test_shards_are_even_and_gapless(spark, documents, source):
    docs = documents if source == "documents" else spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = sharding.assign_shards(docs, 16).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(got.doc_id) == sorted(texts)
    assert all(s == len(texts[d].encode()) + 1 and c == zlib.crc32(texts[d].encode()) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    by = got.groupby("shard")["size"].sum()
    assert by.max() - by.min() <= 2 * got["size"].max() + 0.02 * by.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_shards_of_odd_rows(spark, empty):
    assert sharding.assign_shards(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, "")], SCHEMA).withColumn("shard", F.lit("clash"))
    got = tuples(sharding.assign_shards(odd, 2).select("size", "text_crc32", "law"))
    assert got == [(1, 0, "bytes"), (1, 0, "bytes"), (1, 0, "bytes"), (2, zlib.crc32(b"x"), "bytes")]


# -- BPE


def test_lexicon_numbers_words(tmp_path):
    words = sorted({b"a", b"ab", b"abc", b"bc", b"c", b"xbc", "é".encode()})
    save(compile_words(words, [[k, k + 1][: 1 + k % 2] for k in range(len(words))]), str(tmp_path / "l"))
    lexicon = Lexicon(str(tmp_path / "l"))
    assert lexicon.ranks([*words, b"", b"b", b"abcd"]).tolist() == [*range(len(words)), -1, -1, -1]
    assert lexicon.ids_of_all(np.array([2, -1, 1])) == [[2], None, [1, 2]]
    assert len(lexicon.finals) < 2 + sum(map(len, words))  # endings are shared


def test_bpe_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.TOKENIZER)
    library.no_truncation()
    library.no_padding()
    chance = random.Random(1)
    parts = ["a", "B", "'s", "'", " ", "\n", "é", "é", "ß", "Σ", "1", "٣", "-", "<|endoftext|>", "<|ENDoftext|>", "İ", "日", "😀", "th", "ing", "\x1d", " ", "ͅ"]
    hard = ["", "a" * 300, "ab" * 3000, "don't 'S !!'s", "a<|endoftext|>B", *("".join(chance.choice(parts) for _ in range(chance.randint(0, 30))) for _ in range(400))]
    hard += [r["text"] for r in documents.limit(40).collect()]
    got = {r["doc_id"]: r for r in bpe.encode(spark.createDataFrame(list(enumerate(hard)), SCHEMA), queries.TOKENIZER, lexicon_words=60, keep="ids").collect()}
    for k, text in enumerate(hard):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(got[k]["ids"]) == ids, repr(text)
        assert got[k]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_rows(spark, empty):
    assert bpe.encode(empty, queries.TOKENIZER).count() == 0
    got = bpe.encode(spark.createDataFrame([(1, None), (1, None)], SCHEMA).withColumn("n_tokens", F.lit(9)), queries.TOKENIZER)
    assert tuples(got.select("doc_id", "n_tokens", "decoded_sha256")) == [(1, 0, brute.sha(""))] * 2


# -- decontamination


def test_leaks(spark, empty):
    items = spark.createDataFrame(
        [(1, "Tom buys 3 apples for 5 dollars each and sells 2 apples. How much money does Tom have left after the day?"), (2, "what is two"), (3, None), (4, "of the in and")], "item_id long, text string"
    )
    docs = spark.createDataFrame(
        [
            (1, "Intro here. Tom buys 3 apples for 5 dollars each and sells 2 apples. How much money does Tom have left after the day? End."),
            (2, "We say that Bob buys 7 apples for 9 dollars each and sells 4 apples. How much money does Bob have left after the day? ok"),
            (3, "TOM BUYS 3 APPLES FOR 5 DOLLARS EACH AND SELLS 2 APPLES. HOW MUCH MONEY DOES TOM HAVE LEFT AFTER THE DAY?"),
            (4, "nothing to see of the road"), (5, None), (6, ""), (7, "so what is two, really"), (7, "so what is two, really"),
        ],
        SCHEMA,
    ).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(1, 1): "exact", (2, 1): "reparameterised", (3, 1): "exact", (7, 2): "exact"}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()) == [4, 5, 6]
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_torn_slots_are_no_leak(spark):
    items = spark.createDataFrame([(1, "if one has 12 and the other has 12 then both of them have 12 each")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "if one has 7 and the other has 7 then both of them have 7 each"), (2, "if one has 7 and the other has 8 then both of them have 9 each")], SCHEMA)
    assert [(r["doc_id"], r["kind"]) for r in decontaminate.find_leaks(docs, items).collect()] == [(1, "reparameterised")]


# -- personal data


HARD_PII = [
    "a@b.c%d@e.f x", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111-", "é😀 +12 345 678 901 x@y.zz.", "9" * 20000, "+" * 2000 + "1" * 20, "0001.02.3.255 1.2.3.256", "a" * 20000 + "@" + "b" * 10 + ".c", "", None, "@@@@a@b", "x@y..z a.b@c-d.e-f_g",
]


def test_pii_base_spans(spark, documents):
    texts = HARD_PII + [r["text"] for r in documents.collect()]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_spans(spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("spans", F.lit(1)))).collect()}
    for k, text in enumerate(texts):
        expected = brute.base_spans(text)
        assert got[k]["base_sha256"] == brute.sha(expected), (text or "")[:60]
        assert got[k]["n_email"] == expected.count("email:")


def test_pii_checks_and_context(spark, empty):
    docs = spark.createDataFrame([(1, "my bank account GB82 WEST 1234 5698 7654 32, then GB82 WEST 1234 5698 7654 33"), (2, "call me: +49 (30) 1234567 or +49 (30) 7654321")], SCHEMA)
    got = {r["doc_id"]: r["pii"] for r in pii.find_spans(docs).collect()}
    assert [s["kind"] for s in got[1]] == ["iban"] and got[1][0]["score"] == 1.0
    assert [round(s["score"], 2) for s in got[2]] == [0.8, 0.8]  # context reaches over a neighbouring match
    assert pii.redact(docs.where("doc_id = 2")).first()["text"] == "call me: <PHONE> or <PHONE>"
    assert pii.find_spans(empty).count() == 0


# -- licences


def test_licenses(spark, empty):
    text = licenses.TEMPLATES["ISC"]
    docs = spark.createDataFrame([(1, "a\nReleased under the MIT License.\n" + licenses.TEMPLATES["MIT#text"]), (2, text.replace(". ", ".\n").replace(", ", ",\n")), (3, None), (4, ""), (5, "x"), (6, "RELEASED under the MIT license"), (7, "\n\n"), (6, "RELEASED under the MIT license"), (8, "word " * 5000)], SCHEMA)
    got = {(r["doc_id"], r["line"], r["license"], r["dice"]) for r in licenses.find_licenses(docs.withColumn("line", F.lit(1))).collect()}
    assert {(1, 1, "MIT", 1.0), (1, 2, "MIT", 1.0), (2, -1, "ISC", 1.0), (6, 0, "MIT", 1.0)} <= got
    assert {g[0] for g in got} == {1, 2, 6}
    assert licenses.find_licenses(empty).count() == 0


# -- lines, passages, near copies


def test_line_dedup(spark, rows, frame, empty):
    odd = rows + [(None, rows[5][1]), rows[7]]
    expected = brute.kept_lines(odd)
    got = lines.deduplicate_lines(spark.createDataFrame(odd, SCHEMA).withColumn("lines", F.lit("kept")))
    assert tuples(got.select("doc_id", "text")) == sorted([(d, expected[d, t]) for d, t in odd], key=repr)
    assert got.where("lines = 'kept'").count() == len(odd)
    assert lines.deduplicate_lines(empty).count() == 0


def test_one_line_in_many_near_copies(spark):
    base = [f"b{k}" for k in range(30)]
    texts = [" ".join(base[: k % 30] + [f"own{k}"] + base[k % 30 + 1 :]) for k in range(150)]
    got = lines.deduplicate_lines(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], SCHEMA))
    expected = brute.kept_lines(list(enumerate(texts)))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {k: expected[k, t] for k, t in enumerate(texts)}


def test_repeated_passages(spark, rows, empty):
    odd = rows + [rows[4], (None, rows[9][1]), (None, None)]
    assert tuples(substrings.remove_repeats(spark.createDataFrame(odd, SCHEMA).withColumn("row", F.lit(1)))) == sorted(brute.repeats(odd), key=repr)
    assert substrings.remove_repeats(empty).count() == 0


def test_a_passage_in_more_documents_than_a_shard_holds(spark):
    chance = random.Random(9)
    own = lambda n: [f"u{chance.randrange(10**9)}" for _ in range(n)]
    passage = own(40)
    odd = [(k, " ".join(own(20) + passage[k % 5 :] + own(20))) for k in range(3 * substrings.SHARD_PIECES)]
    assert tuples(substrings.remove_repeats(spark.createDataFrame(odd, SCHEMA))) == sorted(brute.repeats(odd), key=repr)


def test_suffix_automaton():
    automaton = substrings.SuffixAutomaton()
    automaton.add(list("abcabx"))
    automaton.add(list("zabc"), weight=2)
    automaton.close()
    assert automaton.statistics(list("abcab"), 3) == [1, 2, 3, 1, 2]
    assert substrings.spans_of([0, 1, 2, 3, 0, 3, 4], 3) == [(1, 4), (3, 7)] or substrings.spans_of([0, 1, 2, 3, 0, 3, 4], 3) == [(1, 7)]


def test_near_duplicates(spark, rows, empty):
    unique = [r for r in rows if r[1] is not None]
    assert tuples(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("sig", F.lit(1)))) == sorted(brute.components(unique) + [(len(rows) - 3, 0, len(rows) - 3, True)], key=repr)
    assert minhash.near_duplicates(empty).count() == 0


def test_large_group_of_near_copies(spark):
    base = [f"b{k}" for k in range(120)]
    edit = lambda k, *at: " ".join([f"own{k}" if j in at else w for j, w in enumerate(base)])
    odd = [(k, edit(k, k % 120, (k * 7) % 120)) for k in range(200)] + [(500 + k, " ".join(f"c{k}-{j}" for j in range(40))) for k in range(30)] + [(600 + k, "same words in all of these rows") for k in range(50)]
    assert tuples(minhash.near_duplicates(spark.createDataFrame(odd, SCHEMA))) == sorted(brute.components(odd), key=repr)


def test_signatures_estimate_similarity(spark):
    a = [f"t{k}" for k in range(400)]
    odd = [(0, " ".join(a)), (1, " ".join(a[:350] + [f"n{k}" for k in range(50)]))]
    signed = {r["doc_id"]: r for r in minhash.signatures(spark.createDataFrame(odd, SCHEMA)).collect()}
    frame = spark.createDataFrame([(signed[0]["sig"], signed[1]["sig"])], "a array<long>, b array<long>")
    told = frame.select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
    one, two = (brute.shingle_set(t) for _, t in odd)
    assert abs(told - len(one & two) / len(one | two)) < 0.15


# -- language


def test_language_on_held_out_documents(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) for d in got.doc_id) and got.score.between(0, 1).all()


def test_language_of_odd_rows(spark, documents):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "a"), (4, "a"), (5, "the " * 30000)], SCHEMA).withColumn("lang_pred", F.lit("clash"))
    told = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, langid.fit(documents)).collect()}
    assert told[1] == told[2] == told[3] == "und" and told[4] != "und" and told[5] == "en"
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(documents.limit(0)).count() == 0


# -- fingerprints


def test_fingerprints(spark, documents):
    got = imatch.compare_with_edits(documents.withColumn("h", F.lit(1))).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        k = len(texts[a]) // 3
        assert got.edited_sha256[a] == brute.sha(texts[a][: len(texts[a]) - k] + texts[b][:k]) and got.n_chars[a] == len(texts[a])
    by_text = {}
    for d in order:
        assert by_text.setdefault(texts[d], got.fingerprint[d]) == got.fingerprint[d]
    assert (got.near_edited > got.near_next).mean() > 0.9


def test_fingerprints_of_odd_rows(spark, empty):
    odd = spark.createDataFrame([(1, None), (1, None), (None, "x y"), (3, "one"), (2, "😀é ab")], SCHEMA)
    got = imatch.compare_with_edits(odd).toPandas()
    assert len(got) == 5 and sorted(got.n_chars) == [0, 0, 3, 3, 5]
    assert got[got.n_chars == 0].fingerprint.nunique() == 1
    assert imatch.compare_with_edits(empty).count() == 0


# -- all queries, the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, data, name):
    import duckdb

    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    told = duck.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    assert columns == sorted(told.columns)
    assert tuples(found.select(*columns)) == sorted([tuple(r) for r in told.project(", ".join(f'"{c}"' for c in columns)).fetchall()], key=repr)


def test_pipeline(spark, data, documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, before = documents, None
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == documents.columns, name
        kept = out.collect()
        docs = spark.createDataFrame(kept, documents.schema)
        before = before or {r["doc_id"] for r in kept}
        assert {r["doc_id"] for r in kept} <= before
    groups = brute.components([(r["doc_id"], r["text"]) for r in kept])
    assert all(k for _, _, _, k in groups)  # no near copies are left
    final = pipeline.STAGES[-1][1](spark, docs, data)
    assert final.count() == len(kept) and pipeline.run(spark, data).count() == len(kept)


def test_scratch_is_released(spark):
    held = scratch.materialize(spark.range(5).toDF("x"), "mine")
    scratch.release(spark, [held.scratch_path])
    assert held.scratch_path not in scratch.written()
