"""I-Match document fingerprints over randomised lexicon subsets.

Terms are white-space words, A-Z lower-cased. The lexicon keeps the terms whose inverse document
frequency lies in a band: those in 0.05 % to 20 % of the documents. A term is in few documents of any
size, so the lexicon has at most (mean number of distinct terms of a document) / 0.0005 entries, whatever
the corpus. A document's distinct lexicon terms are sorted and summed up by hash in each of 128
random subsets of the lexicon, which hold 1/4, 1/16, 1/64 or 1/256 of it (32 subsets each); one byte of
each sum makes the fingerprint, 00 standing for a subset without terms of the document.

Likeness of two fingerprints: of the subsets of one scale in which either has terms, the share in which
both agree; the scale with the highest share counts among those with at least six such subsets.

Defined results: a null text is empty; a document with fewer than eight lexicon terms uses all its terms;
a text without words has the zero fingerprint, and two zero fingerprints have likeness 1; repeated rows are
neighbours of each other; rows of one doc_id are ordered by a hash of their text; a null doc_id comes
last; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import bound_batches, share_value

LOW_SHARE, HIGH_SHARE, LEAST_TERMS = 5e-4, 0.2, 8
SCALES, SUBSETS, LEAST_SUBSETS = (4, 16, 64, 256), 32, 6


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term codes of each text: (code, text index)."""
    flat, counts = W.split(pc.ascii_lower(text))
    code = W.codes(flat)
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    if len(code):
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])])
        code, of = code[new], of[new]
    return code, of


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted codes of the terms whose document frequency lies in the band, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in W.chunks(batches):
            code, n = np.unique(_terms(text)[0], return_counts=True)
            yield pa.record_batch([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "df"])

    n_docs = docs.count()
    df = docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = df.where((F.col("df") >= LOW_SHARE * n_docs) & (F.col("df") <= max(1.0, HIGH_SHARE * n_docs))).select("term").toArrow()
    return np.sort(band["term"].to_numpy().view(np.uint64))


def fingerprints(text: pa.Array, known: np.ndarray) -> np.ndarray:
    """uint8 array (texts, subsets)."""
    n = len(text)
    code, of = _terms(text)
    if len(known):
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        inside = known[at] == code
        few = np.bincount(of[inside], minlength=n) < LEAST_TERMS
        keep = inside | few[of]
        code, of = code[keep], of[keep]
    width = len(SCALES) * SUBSETS
    total = np.zeros(n * width, np.uint64)
    value = W.mix(code ^ np.uint64(0xA0761D6478BD642F))
    for s, parts in enumerate(SCALES):
        for again in range(max(1, SUBSETS // parts)):
            subset = (W.mix(code + np.uint64(1 + 1000 * s + again)) >> np.uint64(33)).astype(np.int64) % parts
            ok = subset < SUBSETS
            np.add.at(total, of[ok] * width + s * SUBSETS + again * min(parts, SUBSETS) + subset[ok], value[ok])
    return np.where(total == 0, 0, 1 + W.mix(total) % np.uint64(255)).astype(np.uint8).reshape(n, width)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    shape = (len(a), len(SCALES), SUBSETS)
    a, b = a.reshape(shape), b.reshape(shape)
    either = ((a > 0) | (b > 0)).sum(axis=2)
    same = ((a == b) & (a > 0)).sum(axis=2)
    share = np.where(either >= LEAST_SUBSETS, same / np.maximum(either, 1), -1.0).max(axis=1, initial=-1.0)
    overall = same.sum(axis=1) / np.maximum(either.sum(axis=1), 1)
    return np.where(either.sum(axis=1) == 0, 1.0, np.where(share >= 0, share, overall))


def _in_order(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text): documents in parts of descending doc_id; each part ends with a guest, the first row of the next."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    parts = int(min(65536, max(32, n // 1000)))
    cuts = rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 20 * parts).alias("q")).first()["q"] if n else []
    bounds = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, key.to_numpy(), "left")).astype(np.int32))

    placed = rows.withColumn("part", part_of("key")).withColumn("h", F.xxhash64("text"))
    firsts = {r["part"]: (r["f"]["key"], r["f"]["h"]) for r in placed.groupBy("part").agg(F.max(F.struct("key", "h")).alias("f")).collect()}  # one row a part
    order = sorted(firsts)
    guests = [(*firsts[order[(k + 1) % len(order)]], part) for k, part in enumerate(order)]
    table = spark.createDataFrame(guests, "key long, h long, to int")
    invited = placed.join(F.broadcast(table), ["key", "h"], "left_semi") if n else placed.limit(0)
    invited = invited.groupBy("key", "h").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    invited = invited.join(F.broadcast(table), ["key", "h"]).select(F.col("to").alias("part"), F.lit(1).alias("guest"), "key", "h", "doc_id", "text")
    both = placed.select("part", F.lit(0).alias("guest"), "key", "h", "doc_id", "text").union(invited)
    return both.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("key"), F.desc("h")).select("part", "guest", "doc_id", "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likeness; see ``queries.op9_imatch`` for the columns."""
    bound_batches(docs.sparkSession)
    shared = share_value(docs.sparkSession, lexicon(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held = None  # the last row so far: (guest, doc_id, text, fingerprint)
        for part, text in W.chunks(batches):
            texts = text.to_pylist()
            guest, ids = part.column(1).to_pylist(), part.column(2).to_pylist()
            own = fingerprints(text, known)
            if held is not None:
                texts, guest, ids, own = [held[2], *texts], [held[0], *guest], [held[1], *ids], np.concatenate([held[3], own])
            held = (guest[-1], ids[-1], texts[-1], own[-1:])
            out = [k for k in range(len(texts) - 1) if not guest[k]]
            edited = [texts[k][: len(texts[k]) - len(texts[k]) // 3] + texts[k + 1][: len(texts[k]) // 3] for k in out]
            other = fingerprints(pa.array(edited, pa.large_string()), known)
            index = np.array(out, np.int64)
            yield pa.record_batch(
                [
                    pa.array([ids[k] for k in out], pa.int64()),
                    pa.array([len(texts[k]) for k in out], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([own[k].tobytes().hex() for k in out], pa.string()),
                    pa.array([x.tobytes().hex() for x in other], pa.string()),
                    pa.array(likeness(own[index], other)),
                    pa.array(likeness(own[index], own[index + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs).mapInArrow(run, schema)
