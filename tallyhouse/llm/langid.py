"""Language identification with bit-sliced Bloom filters of n-grams.

An n-gram is four consecutive bytes of the lower-cased UTF-8 text with a space at either end. Fitting
counts n-grams by language over a bounded, hash-chosen sample of each language's labelled rows (``fit_docs``); a
language contains an n-gram if it is frequent there and not much more frequent elsewhere. One table of
2**20 slots holds a bit for each language, so the AND of three slots returns all languages containing an
n-gram at once. Predicting adds up each language's bits over all n-grams of a whole text, takes off the
share expected from false positives of that language's filter, and chooses the largest.

Only rows with ``crc32(doc_id as text) mod 3 <> 1`` are fitted on. ``lang``, ``source`` and ``doc_id`` are
never inputs of a prediction.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where nothing could be
learned; ties go to the alphabetically first language; repeated rows each get their result; an empty table
gives an empty result; further columns are not read by ``identify`` and kept by ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import BROADCAST_IDS, bound_batches, materialize, share_value

SLOTS_BITS, PROBES, GRAM = 20, 3, 4
#: Labelled rows to fit on: about this many of all languages together, in equal parts, chosen by a hash of doc_id.
FIT_DOCS = 6000
#: A part is never less than this many rows of a language.
LEAST_FIT_DOCS = 100
#: Text bytes that are predicted at once.
CHUNK = 1 << 20
#: An n-gram belongs to a language if it makes up this share of its n-grams ...
LEAST_SHARE = 2e-5
#: ... and this part of the share it has where it is most frequent.
LEAST_RATIO = 0.2
_LETTER = regex.compile(r"\p{L}")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as uint32, offsets by text) of all texts."""
    raw = [b" " + t.lower().encode() + b"   " for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    out = np.zeros(max(0, len(flat) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        out = (out << np.uint32(8)) | flat[k : k + len(out)]
    # The three spaces at each end keep every n-gram that starts in a text inside of it.
    starts = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.ones(len(flat), bool)
    for k in range(1, GRAM):
        inside[starts[1:] - k] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return out[inside[: len(out)]], kept[starts]


def slots(gram: np.ndarray) -> Iterator[np.ndarray]:
    """The slots of each n-gram, one array for each probe."""
    for k in range(PROBES):
        x = (gram ^ np.uint32(0x9E3779B9 * (k + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        yield (x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOTS_BITS)


class Filters:
    """Bit-sliced Bloom filters of up to 64 languages a slice."""

    def __init__(self, langs: list[str], members: list[np.ndarray]):
        self.langs = langs
        self.slices = [np.zeros(1 << SLOTS_BITS, np.uint8 if len(langs) <= 8 else np.uint64) for _ in range(max(1, -(-len(langs) // 64)))]
        for k, gram in enumerate(members):
            table = self.slices[k // 64]
            for slot in slots(gram):
                table[slot] |= table.dtype.type(1 << (k % 64))
        fill = [np.count_nonzero(self.slices[k // 64] >> np.uint8(k % 64) & np.uint8(1)) / (1 << SLOTS_BITS) if len(langs) <= 8 else np.count_nonzero(self.slices[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / (1 << SLOTS_BITS) for k in range(len(langs))]
        self.false_positive = np.array(fill) ** PROBES

    def counts(self, gram: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected number of n-grams that each language contains, by text: shape (texts, languages)."""
        n = np.diff(offsets)
        out = np.zeros((len(n), len(self.langs)))
        found = list(slots(gram))
        for s, table in enumerate(self.slices):
            mask = table[found[0]]
            for slot in found[1:]:
                mask &= table[slot]
            for k in range(64 * s, min(64 * s + 64, len(self.langs))):
                total = np.concatenate([[0], np.cumsum((mask >> table.dtype.type(k % 64)) & table.dtype.type(1), dtype=np.int64)])
                out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
        p = self.false_positive
        return np.clip((out - n[:, None] * p) / np.maximum(1 - p, 1e-9), 0, None)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Filters:
    """Filters of all languages found in the labelled rows that are not held out."""
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
    # One row for each language: how many rows to draw of how many, so that rare languages are learned at every size.
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    langs = sizes.count()
    part = F.lit(max(LEAST_FIT_DOCS, fit_docs / max(1, langs)))
    rate = sizes.select("lang", F.least(F.lit(1 << 20), F.ceil(part / F.col("rows") * (1 << 20))).alias("rate"))
    drawn = rows.join(F.broadcast(rate) if langs <= BROADCAST_IDS else rate, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in W.chunks(batches):
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            texts = text.to_pylist()
            for lang in sorted(set(langs)):
                gram, _ = grams([t for t, own in zip(texts, langs == lang, strict=True) if own])
                value, n = np.unique(gram, return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    # The sample bounds these counts, so they fit the driver.
    counted = drawn.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1").toArrow().to_pandas()
    langs = sorted(set(counted["lang"]))
    if not langs:
        return Filters([], [])
    by_lang = counted.pivot(index="gram", columns="lang", values="n").fillna(0.0)[langs]
    shares = by_lang.to_numpy() / by_lang.to_numpy().sum(axis=0)
    gram = by_lang.index.to_numpy().astype(np.uint32)
    member = (shares >= LEAST_SHARE) & (shares >= LEAST_RATIO * shares.max(axis=1, keepdims=True))
    return Filters(langs, [gram[member[:, k]] for k in range(len(langs))])


def predict(docs: DataFrame, filters: Filters, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` and two columns, named ``names``: the language and its score. Columns of ``docs`` of these names are replaced."""
    docs = docs.drop(*names)
    shared = share_value(docs.sparkSession, filters)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Filters = shared.value
        labels = np.array([*model.langs, "und"], dtype=object)
        for part, text in W.chunks(batches, most=CHUNK):
            texts = text.to_pylist()
            best, score = np.full(len(texts), len(model.langs)), np.zeros(len(texts))
            if model.langs:
                gram, offsets = grams(texts)
                count = model.counts(gram, offsets)
                letters = np.array([_LETTER.search(t) is not None for t in texts])
                best = np.where(letters, count.argmax(axis=1), best)
                score = np.where(letters, np.clip(count.max(axis=1) / np.maximum(np.diff(offsets), 1), 0, 1), 0.0)
            yield pa.record_batch([*part.columns, pa.array(labels[best], pa.string()), pa.array(score)], [*columns, *names])

    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema
    for field in schema:
        field.nullable = True
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    out = predict(docs.select("doc_id", "text"), fit(docs, fit_docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
