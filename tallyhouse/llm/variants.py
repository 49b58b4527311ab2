"""Spelling variants: words one letter apart, found by anagram hashing.

1. One pass counts the words of whole texts; a task sends one row for each word and block of texts.
2. The key of a word is the sum of a power of its letters, so anagrams share it. A letter that is added, removed or
   exchanged changes the key by that letter's value or by the difference of two values: every word is put under its
   own key and under its key less each of its letters' values. A removed letter meets a whole word, an exchange meets
   another word less a letter.
3. The first or the last half of a word is left alone by one edit. Rows carry the half that an edit would leave, so
   that words which only share their letters do not meet.
4. Pairs that meet are verified in letter order (one insertion, removal or replacement of a code point).
5. A word's form is its most frequent near word, if that is ``RATIO`` times as frequent; roots are found by
   pointer jumping, and frequencies at least multiply by ``RATIO`` with each step, so chains are short.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one; words may have any length;
rows that repeat are counted as often as they stand; ties of frequency go to the smallest word in code-point order;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import bound_batches, materialize

#: Maximal runs of these are words: ASCII letters and the letters of Latin-1 (A-Z are lower-cased before).
NO_LETTER = "[^a-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: The power of a letter's code point that is summed into a key (modulo 2**64).
POWER = 5
#: An occurrence whose checksum this divides loses a letter.
SLIP = 199
#: Words of more bytes than this have their checksums computed one by one.
SHORT_BYTES = 255


def _crc_step() -> np.ndarray:
    """What eight zero bits make of the low byte of a CRC-32 (reflected polynomial 0xEDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (out & np.uint32(1)))
    return out


def _checksums(heads: list[bytes], doc: np.ndarray, words: list[bytes], code: np.ndarray) -> np.ndarray:
    """crc32(heads[doc] + words[code]) for arrays of indices: a head's checksum is carried over as many zero bytes as a word has."""
    size = np.array([len(w) for w in words])
    tail = np.array([zlib.crc32(w) for w in words], np.uint32)
    step = _crc_step()
    carried = np.empty((min(int(size.max()), SHORT_BYTES) + 1, len(heads)), np.uint32)
    carried[0] = [zlib.crc32(h) for h in heads]
    for k in range(1, len(carried)):
        carried[k] = step[carried[k - 1] & np.uint32(255)] ^ (carried[k - 1] >> np.uint32(8))
    out = carried[np.minimum(size[code], SHORT_BYTES), doc] ^ tail[code]
    for k in np.flatnonzero(size[code] > SHORT_BYTES):
        out[k] = zlib.crc32(heads[doc[k]] + words[code[k]])
    return out


def count_words(docs: DataFrame, slips: bool = False) -> DataFrame:
    """(word, n) of all words of at least ``LEAST_LETTERS`` code points.

    With ``slips``, an occurrence whose h = crc32("<doc_id>:<word>") is divided by ``SLIP`` first loses its code point h % length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in W.chunks(batches):
            lists = pc.split_pattern_regex(pc.ascii_lower(text), NO_LETTER)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            full = np.asarray(pc.binary_length(flat)) > 0
            doc = np.repeat(np.arange(len(text)), np.diff(offsets))[full]
            coded = flat.filter(pa.array(full)).dictionary_encode()
            code, words = np.asarray(coded.indices), coded.dictionary
            if not len(code):
                continue
            plain = words.to_pylist()
            slipped: Counter[str] = Counter()
            if slips:
                heads = ["" if d is None else str(d) for d in part.column(0).to_pylist()]
                h = _checksums([f"{d}:".encode() for d in heads], doc, [w.encode() for w in plain], code)
                hit = h % np.uint32(SLIP) == 0
                for c, one in zip(code[hit].tolist(), h[hit].tolist(), strict=True):
                    at = one % len(plain[c])
                    slipped[plain[c][:at] + plain[c][at + 1 :]] += 1
                code = code[~hit]
            n = np.bincount(code, minlength=len(plain))
            ok = np.flatnonzero((n > 0) & (np.asarray(pc.utf8_length(words)) >= LEAST_LETTERS))
            more = [(w, k) for w, k in slipped.items() if len(w) >= LEAST_LETTERS]
            found = pa.chunked_array([words.take(pa.array(ok)).cast(pa.string()), pa.array([w for w, _ in more], pa.string())]).combine_chunks()
            yield pa.record_batch([found, pa.array(np.concatenate([n[ok], np.array([k for _, k in more], np.int64)]))], ["word", "n"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def anagram_rows(word: str) -> set[tuple[int, bytes, bool]]:
    """(key, half, whole) of a word: its own key, and its key less each letter, with the half that an edit there leaves alone."""
    value = [ord(c) ** POWER for c in word]
    total, size = sum(value), len(word)

    def half(rest: int, last: bool) -> bytes:
        """Half of the ``rest`` letters that the shorter of two words has: the first ones, or the last ones."""
        some = word[size - (rest - rest // 2) :] if last else word[: rest // 2]
        return hashlib.blake2b(f"{rest}{'<>'[last]}{some}".encode(), digest_size=8).digest()

    out = {(total, half(size, last), True) for last in (False, True)}
    middle = (size - 1) // 2
    first, second = half(size - 1, False), half(size - 1, True)
    for k, v in enumerate(value):
        out.add((total - v, second if k < middle else first, False))
    return out


def near_words(counted: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b), a < b, of the words of (word, n) that differ by one inserted, removed or replaced code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                some = batch.slice(start, 5000)
                rows = [(k, *row) for k, w in enumerate(some.column(0).to_pylist()) for row in anagram_rows(w)]
                at = pa.array(np.array([r[0] for r in rows], np.int64))
                keys = np.array([r[1] & ((1 << 64) - 1) for r in rows], np.uint64).view(np.int64)
                halves = np.frombuffer(b"".join(r[2] for r in rows), np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(halves), pa.array([r[3] for r in rows], pa.bool_()), some.column(0).take(at), some.column(1).take(at)], ["key", "half", "whole", "word", "n"])

    rows = materialize(counted.select("word", "n").mapInArrow(run, "key long, half long, whole boolean, word string, n long"), "anagrams")
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, ["key", "half"]).where((F.col("x.word") < F.col("y.word")) & ~(F.col("x.whole") & F.col("y.whole")) & (F.levenshtein("x.word", "y.word", 1) == 1))
    return met.select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b")).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): where the chain of forms from a word ends. The chains must have no circle."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = steps.select(F.col("word").alias("root"), F.col("root").alias("top"))
        jumped = materialize(steps.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        steps = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return steps


def group_variants(counted: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of (word, n)."""
    bound_batches(counted.sparkSession)
    counted = materialize(counted.select("word", "n"), "words")
    pairs = materialize(near_words(counted), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= RATIO * F.col("n")
    formed = counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    formed = materialize(formed, "forms")
    roots = roots_of(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
