"""BPE encoding and decoding with a transducer lexicon of the corpus's frequent words.

1. Count the words of the whole corpus (partial counts in each task, one sum per word).
2. Merge the most frequent ones (``lexicon_words`` at most, down to a count that a histogram gives) on the driver, and compile them with their ids into a
   minimal acyclic transducer (``lexicon.py``): a table of bounded size. The file goes to the executors
   with ``addFile`` and is memory-mapped there.
3. Encode: texts fall into chunks at white space; each distinct chunk is normalised and cut into words
   once per task; words are looked up in the transducer, and unseen ones are merged exactly.

The format is a public tokenizer file of the kind "BPE with word ends": NFC, lower case, the pattern of its
pre-tokenizer, byte-level symbols, no decoder (tokens joined by one space).

Defined results: a null text is empty; an empty text has no ids and decodes to the empty text; special
tokens written out in a text count as themselves; repeated rows each get their result; an empty table
gives an empty result; of further columns only ``doc_id`` is kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import Lexicon, compile_words, save
from .scratch import bound_batches, materialize, release, ship
from .words import chunks, give_back

LEXICON_WORDS = 1 << 17
#: Distinct chunks that a task counts or remembers at once (some tens of megabytes).
MEMO = 120_000
#: Text bytes that are encoded at once.
CHUNK = 2 << 20
#: Ids are below 2**SHIFT.
SHIFT = 20
MASK, NEVER = (1 << SHIFT) - 1, 1 << 62
#: Words of more symbols are merged with a queue, in n log n steps.
LONG_WORD = 48
#: Fewer words of one length are merged one by one.
FEW = 24
#: White space as the tokenizer's patterns know it (str.split() also takes 1C to 1F).
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself if printable Latin-1, else one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _less(table: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """``table`` with one cell of each row taken out."""
    keep = np.ones(table.shape, bool)
    keep[row, column] = False
    return table[keep].reshape(len(table), table.shape[1] - 1)


class Model:
    """A tokenizer file: exact merging of one word, and the text of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        v = self.vocab
        #: left id and right id in one number -> rank and id of both in one number
        self.merges = {v[a] << SHIFT | v[b]: rank << SHIFT | v[a + b] for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t for t, i in v.items()} | {i: t for t, i in self.special.items()}
        self.spelled = pa.array([self.tokens.get(i) for i in range(1 + max(self.tokens, default=-1))], pa.large_string())
        self.pattern = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        symbols = byte_symbols()
        self.inner = [v[s] for s in symbols]
        self.last = [v[s + self.suffix] for s in symbols]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.pair_keys = np.sort(np.fromiter(self.merges, np.int64, len(self.merges)))
        self.pair_values = np.array([self.merges[k] for k in self.pair_keys.tolist()], np.int64)

    def normalise(self, text: str) -> str:
        """NFC, then lower case letter by letter (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, chunk: str) -> list[str | int]:
        """The words of a text without white space; a special token stands as its id."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if "<|" not in chunk:
            return self.pattern.findall(self.normalise(chunk))
        out: list[str | int] = []
        for part in self.at_special.split(chunk):
            out += [self.special[part]] if part in self.special else self.pattern.findall(self.normalise(part))
        return out

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of consecutive runs of ids: tokens joined by one space."""
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.spelled.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: again and again the pair of the lowest rank, the leftmost first."""
        if not word:
            return []
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < NEVER:
            at = ranks.index(best)
            ids[at : at + 2] = [best & MASK]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(ids[at] << SHIFT | ids[at + 1], NEVER)
            if at:
                ranks[at - 1] = get(ids[at - 1] << SHIFT | ids[at], NEVER)
        return ids

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and id of each pair of ids in one number, ``NEVER`` if they do not merge."""
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NEVER)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of every word. Words of one length take each step together, and so stay of one length."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            row = np.flatnonzero(lengths == n)
            if not 1 < n <= LONG_WORD or len(row) < FEW or not len(self.pair_keys):
                for k in row.tolist():
                    out[k] = self.merge(words[k])
                continue
            raw = np.frombuffer(b"".join([words[k] for k in row.tolist()]), np.uint8).reshape(-1, n)
            ids = np.concatenate([self.inner_ids[raw[:, :-1]], self.last_ids[raw[:, -1:]]], axis=1)
            ranks = self._pairs(ids[:, :-1], ids[:, 1:])
            while len(row):
                at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
                best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NEVER)
                go = best < NEVER
                for k, found in zip(row[~go].tolist(), ids[~go].tolist(), strict=True):
                    out[k] = found
                row, ids, ranks, at = row[go], ids[go], ranks[go], at[go]
                if not len(row):
                    break
                here, width = np.arange(len(row)), ids.shape[1]
                ids[here, at] = best[go] & MASK
                ids, ranks = _less(ids, here, at + 1), _less(ranks, here, at)
                for some, left in ((np.flatnonzero(at < width - 2), at), (np.flatnonzero(at > 0), at - 1)):
                    ranks[some, left[some]] = self._pairs(ids[some, left[some]], ids[some, left[some] + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        queue: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (found := merges.get(ids[k] << SHIFT | ids[after[k]])):
                heapq.heappush(queue, (found >> SHIFT, k, ids[k], ids[after[k]]))

        for k in range(n - 1):
            offer(k)
        while queue:
            _, k, left, right = heapq.heappop(queue)
            j = after[k]
            if not alive[k] or j < 0 or ids[k] != left or ids[j] != right:
                continue
            ids[k], alive[j], after[k] = merges[left << SHIFT | right] & MASK, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            offer(before[k])
            offer(k)
        return [x for x, there in zip(ids, alive, strict=True) if there]


def split_chunks(text: str) -> list[str]:
    """The parts of a text between white space."""
    if _ODD.search(text) is None:
        return text.split()
    return [x for x in _SPACE.split(text) if x]


def _digests(texts: pa.LargeStringArray) -> list[str]:
    """SHA-256 of each text, in hexadecimal."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    whole = memoryview(data or b"")
    return [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]


_OPEN: dict[str, object] = {}


def _opened(kind, name: str):
    """The shipped file as ``kind``, opened once per worker process."""
    if name not in _OPEN:
        if len(_OPEN) > 8:
            _OPEN.clear()
        _OPEN[name] = kind(SparkFiles.get(name))
    return _OPEN[name]


def word_counts(docs: DataFrame, model_name: str) -> DataFrame:
    """(word, n) over all texts: partial counts a task, summed by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what other tasks of this worker left
        model, seen = _opened(Model, model_name), Counter()

        def flush() -> pa.RecordBatch:
            total: Counter = Counter()
            for chunk, n in seen.items():
                for word in model.words(chunk):
                    if isinstance(word, str):
                        total[word] += n
            seen.clear()
            return pa.record_batch({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for _, text in chunks(batches, most=CHUNK):
            for one in text.to_pylist():
                seen.update(split_chunks(one))
            if len(seen) > 2 * MEMO:
                yield flush()
        yield flush()
        give_back()

    partial = docs.select("text").mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, size: int = LEXICON_WORDS) -> tuple[str, str]:
    """Names under which the tokenizer file and the corpus's lexicon are found on every executor."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        model_name = ship(spark, f.read(), "tokenizer")
    # The most frequent words by a histogram of counts, not by a sort: no task gathers a list from every other.
    counts = materialize(word_counts(docs, model_name).withColumn("band", F.floor(16 * F.log2("n")).cast("int")), "word-counts")
    least, total = None, 0
    for row in sorted(counts.groupBy("band").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["band"]):  # some hundred rows
        total += row["words"]
        if total > size:
            break
        least = row["band"]
    frequent = counts.where(F.col("band") >= F.lit(least) if least is not None else F.lit(False)).select("word").toArrow()
    release(spark, [counts.scratch_path])
    model = Model(tokenizer_path)
    words = sorted({w.encode() for w in frequent["word"].to_pylist()})
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "lexicon.bin")
        save(compile_words(words, model.merge_all(words)), path)
        with open(path, "rb") as f:
            return model_name, ship(spark, f.read(), "lexicon")


class Encoder:
    """Encodes texts in one task; remembers distinct chunks in two generations, so that frequent ones stay known."""

    def __init__(self, model: Model, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon
        #: chunk -> its ids as 32-bit integers
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, parts: set[str]) -> None:
        """Make every chunk of ``parts`` known."""
        if len(self.ids) > MEMO:
            self.older, self.ids = self.ids, {}
        ids, old = self.ids, self.older
        missing = parts.difference(ids)
        ids.update((p, old[p]) for p in missing.intersection(old))
        new = missing.difference(old)
        single = {p: p.lower() for p in new if p.isascii() and p.isalpha()}
        several = {p: self.model.words(p) for p in new if p not in single}
        unknown = set(single.values())
        unknown.update(w for ws in several.values() for w in ws if isinstance(w, str))
        plain = list(unknown)
        raw = [w.encode() for w in plain]
        looked_up = self.lexicon.packed_ids(self.lexicon.ranks(raw))
        merged = iter(self.model.merge_all([r for r, found in zip(raw, looked_up, strict=True) if found is None]))
        words: dict[str | int, bytes] = {i: array("I", [i]).tobytes() for i in self.model.special.values()}
        words.update((w, array("I", next(merged)).tobytes() if found is None else found) for w, found in zip(plain, looked_up, strict=True))
        ids.update((p, words[w]) for p, w in single.items())
        ids.update((p, b"".join([words[w] for w in ws])) for p, ws in several.items())


def encode(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS, keep: str = "digest") -> DataFrame:
    """Encode every whole text, then decode its ids.

    ``keep="digest"``: doc_id, n_tokens, ids_sha256, decoded_sha256. ``keep="ids"``: doc_id, ids array<int>, decoded string.
    """
    bound_batches(docs.sparkSession)
    model_name, lexicon_name = build_lexicon(docs, tokenizer_path, lexicon_words)
    full = keep == "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what other tasks of this worker left
        coder = Encoder(_opened(Model, model_name), _opened(Lexicon, lexicon_name))
        for part, text in chunks(batches, most=CHUNK):
            split = [split_chunks(t) for t in text.to_pylist()]
            coder.learn({c for cs in split for c in cs})
            raw = [b"".join(map(coder.ids.__getitem__, cs)) for cs in split]
            sizes = np.array([len(r) // 4 for r in raw], np.int64)
            flat = np.frombuffer(b"".join(raw), np.uint32)
            decoded = coder.model.decode(flat, sizes)
            doc = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64())
            if full:
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.record_batch([doc, ids, decoded.cast(pa.string())], ["doc_id", "ids", "decoded"])
            else:
                yield pa.record_batch([doc, pa.array(sizes), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(_digests(decoded))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            del split, raw, flat, decoded
        del coder
        give_back()

    schema = "doc_id long, ids array<int>, decoded string" if full else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
