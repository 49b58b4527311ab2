"""Vectorised words and word windows over Arrow batches (no per-row Python in the hot loops)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; bounds a worker's memory whatever the batch (one longer document is handled alone).
CHUNK_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The published splitmix64 finaliser.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """Slices of the batches with at most ``most`` bytes of text, each with its text (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
        ends = np.cumsum(np.asarray(pc.binary_length(text)))
        start = 0
        while start < len(text):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start), text.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return freed memory of this worker to the system: it serves many tasks, and else keeps the most that any of them held."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other systems have other allocators
        ctypes.CDLL(None).malloc_trim(0)


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: the flat words, and the number of words per text."""
    lists = pc.ascii_split_whitespace(text)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if full.all():
        return flat, np.diff(offsets)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), np.diff(before[offsets])


def hash_strings(values: list | np.ndarray) -> np.ndarray:
    """64-bit hashes of distinct strings; the same in every process."""
    return pd.util.hash_array(np.asarray(values, dtype=object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def codes(flat: pa.Array) -> np.ndarray:
    """A 64-bit code for each word: distinct words are hashed once per chunk."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    return hash_strings(coded.dictionary.to_numpy(zero_copy_only=False))[np.asarray(coded.indices)]


#: Bytes of a word that have a random number for each value at each place.
_PLACES = 32
_AT_PLACE = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _MULTIPLIER)


def short_codes(flat: pa.Array) -> np.ndarray:
    """A 64-bit code for each word, like ``codes`` and other than those: the sum of a number for each byte and place; long words are hashed whole."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    flat = flat.cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.add.reduceat(_AT_PLACE[np.minimum(place, _PLACES - 1) << 8 | data], offsets[:-1])
    long = np.flatnonzero(np.diff(offsets) > _PLACES)
    if len(long):
        out[long] = codes(flat.take(pa.array(long)))
    return out


def order_by_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The order by (text, hash): one sort of packed keys, and a full sort only where 40 bits of two hashes of a text agree."""
    if len(text) and int(text.max()) < 1 << 24:
        order = np.argsort(text.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
        h, t = hashes[order], text[order]
        if not ((h[1:] < h[:-1]) & (t[1:] == t[:-1])).any():
            return order
    return np.lexsort((hashes, text))


def windows(code: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text: (hash, index of text, index of first word)."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[:n] == text[size - 1 :]
    total = np.zeros(n, np.uint64)
    if size <= 12:
        for k in range(size):
            total *= _MULTIPLIER
            total += code[k : k + n]
    else:  # by doubling: a window of 2m words from two of m
        total = _long(code, size)
    at = np.flatnonzero(inside)
    return mix(total[at]), text[at], at


def _long(code: np.ndarray, size: int) -> np.ndarray:
    """Polynomial window hashes, composed from windows of powers of two."""
    power, block, width, done, total = _MULTIPLIER, code, 1, 0, None
    while size:
        if size & 1:
            if total is None:
                total, done = block, width
            else:
                n = min(len(total), len(block) - done)
                total, done = total[:n] + _power(done) * block[done : done + n], done + width
        size >>= 1
        if size:
            n = len(block) - width
            block, width = block[:n] + _power(width) * block[width : width + n], width * 2
    return total


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_MULTIPLIER), k, 1 << 64))


def shingles(code: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles per text, sorted by (text, hash): (hash, index of text).

    A text of fewer words has its whole sequence as its only shingle; a text without words has none.
    """
    hashes, text, _ = windows(code, counts, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])[short]
        whole = np.full(len(short), np.uint64(len("short")), np.uint64)
        for k in range(size - 1):
            there = counts[short] > k
            whole[there] = mix(whole[there] * _MULTIPLIER + code[first[there] + k] + np.uint64(k))
        hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, short])
    order = order_by_text(hashes, text)
    hashes, text = hashes[order], text[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])
        hashes, text = hashes[new], text[new]
    return hashes, text


def set_hash(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each text's set of hashes, independent of order (0 for the empty set)."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, text, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    return mix(out)


def starts(text: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each text's rows in arrays sorted by text (n + 1 values)."""
    return np.searchsorted(text, np.arange(n + 1))


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow lists of longs out of flat uint64 values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
