"""Licences that are wrapped over lines above other text, or share their line with it."""

import textwrap

from tallyhouse.llm import licenses


def test_wrapped_licences(spark):
    rest = "\n\n" + "\n".join(" ".join(f"word{9 * k + j}" for j in range(9)) for k in range(60))
    long = [n for n, t in licenses.TEMPLATES.items() if len(t.split()) > 20]
    docs = [(k, "Copyright 2024 Acme\n\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES[n], 60)) + rest) for k, n in enumerate(long)]
    docs += [(50, "Copyright 2024 Acme. Released under the MIT License. All else is free."), (51, rest), (52, None), (53, ""), (54, "mit license")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["template"]) for r in licenses.find_passages(frame).collect()}
    assert {(k, n) for k, n in enumerate(long)} | {(50, "MIT")} <= got
    assert {k for k, _ in got} == {*range(len(long)), 50}
    lines = {(r["doc_id"], r["template"]) for r in licenses.find_licenses(frame).collect()}
    assert not {(k, n) for k, n in enumerate(long)} & lines
    assert licenses.find_passages(frame.limit(0)).count() == 0


def test_licence_files_and_edited_copies(spark):
    """A licence file is found as a whole; wrapped copies with every fifteenth word replaced, above other text, as a run of lines."""
    rest = "\n\n" + "\n".join(" ".join(f"word{9 * k + j}" for j in range(9)) for k in range(30))
    files = sorted(n for n, t in licenses.TEMPLATES.items() if len(t.split()) > 80)
    edited = {n: " ".join(w if k % 15 else "changed" for k, w in enumerate(licenses.TEMPLATES[n].split(), 1)) for n in files}
    docs = [(k, "Copyright 2024 Acme\n\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES[n], 70))) for k, n in enumerate(files)]
    docs += [(100 + k, "\n".join(textwrap.wrap(edited[n], 70)) + rest) for k, n in enumerate(files)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {(r["doc_id"], r["template"]) for r in licenses.find_licenses(frame).where("line = -1").collect()}
    assert {(k, n) for k, n in enumerate(files)} <= whole
    runs = {(r["doc_id"], r["template"]) for r in licenses.find_passages(frame.where("doc_id >= 100")).collect()}
    assert len({(100 + k, n) for k, n in enumerate(files)} & runs) >= 0.9 * len(files)


def test_templates_of_a_folder(spark, tmp_path):
    text = " ".join(f"clause{k % 37} says{k % 11} thing{k}" for k in range(900))
    (tmp_path / "Own-1.0.txt").write_text(text)
    known = licenses.read_templates(spark, str(tmp_path))
    assert known == {"Own-1.0#file": text}
    docs = spark.createDataFrame([(1, "\n".join(textwrap.wrap(text, 70))), (2, "clause1 says1 thing1"), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["line"], r["license"]) for r in licenses.find_licenses(docs, templates=known).collect()] == [(1, -1, "Own-1.0")]
