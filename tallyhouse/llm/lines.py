"""Line deduplication by an exact set-similarity join.

A line is its set of distinct 5-word shingles (A-Z lower-cased; fewer words: the whole sequence as one).
A line goes if an earlier line of the corpus, in the order of (doc_id, line number), has a similarity
(Jaccard) of 0.75 or more; equal sets have similarity 1. Lines without words always stay.

1. One pass reads the words and stores every line's set of 48-bit shingle hashes in the shared folder, with a
   count sketch of fixed size that gives every shingle its rarity. All further steps read that table.
2. The prefix of a set holds its rarest shingles, of which two near lines share at least one. Prefix shingles are
   posted in packed blocks by range of shingles, as many ranges as the data need. Frequent shingles are
   dealt by their sets instead, so that no range holds a hot one.
3. The task of a range sorts its postings. In short lists each set meets the earlier ones that pass the length and
   positional filters. Members of long lists are written out and meet the earliest set of their length first; what
   is then left is dealt by shingle, size and place, and meets the earlier members of those cells that the filters let pass.
4. A bitmap of each set bounds the overlap of a candidate pair; what passes is verified on the whole sets.
5. The first places of sets that survive meet their documents, and all other lines with words are removed.

The positional filter is exact: at the first shingle that two sets share in the order of rarity, each must have
left as many shingles as they have to share, and every shared prefix shingle is posted.

Defined results: a null text stays null; an empty text stays empty and has one empty line; rows that
repeat both doc_id and text are the same document and keep the same lines; a null doc_id is earliest;
an empty table gives an empty result; further columns are kept unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import bound_batches, destroy_shared, in_bitmap, key_bitmap, materialize, release, share_value, shared, tidy

#: Least similarity as a fraction of integers.
NEAR = (75, 100)
SKETCH_BITS = 18
#: Sketches that one task adds up, and that reach the driver (2 MB each).
SKETCHES = 8
#: A shingle counts as frequent above this number of places; its postings are dealt by their sets.
FREQUENT = 2048
#: Postings of one range that a task should sort, about.
RANGE_POSTINGS = 250_000
#: Lists of more sets than this are long.
SHORT_LIST = 16
#: In long lists of up to this length each member is held against all others; one that sizes and places let meet none of them is left out.
HELD_LIST = 1024
#: Postings that a task holds before it writes them out as blocks.
FLUSH = 300_000
#: Set sizes and places from here on are unknown to the filters, which let them pass.
MOST_N = (1 << 16) - 1
#: Words of a set's bitmap (512 bits).
WIDE_WORDS = 8


class Lines:
    """The lines of some texts and their shingle sets, as flat arrays sorted by (line, hash)."""

    def __init__(self, text: pa.Array, size: int):
        lists = pc.split_pattern(text, "\n")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.per_text = np.diff(offsets)
        self.text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        self.number = np.arange(len(self.text)) - np.repeat(offsets[:-1] - offsets[0], self.per_text)
        words, counts = W.split(pc.ascii_lower(flat))
        self.hashes, self.of = W.shingles(W.short_codes(words), counts, size)
        self.at = W.starts(self.of, len(self.text))
        self.set_hash = W.set_hash(self.hashes, self.of, len(self.text))
        self.n = np.diff(self.at)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _packed(values: np.ndarray, width: int, sizes: np.ndarray) -> pa.Array:
    """Binary rows of ``sizes`` numbers each, with the low ``width`` bytes of every number."""
    data = np.ascontiguousarray(np.asarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    offsets = np.concatenate([[0], width * np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(packed: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat uint64 numbers of ``width`` bytes, and how many each row of a binary column holds."""
    if not len(packed):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    return wide.ravel().view("<u8").astype(np.uint64, copy=False), np.diff(offsets).astype(np.int64) // width


def _planes(sizes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Where the first, second, ... byte of every number stands if each row holds the first bytes of its numbers, then the second ones, and so on."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, step = np.arange(len(first)) + (width - 1) * first, np.repeat(sizes, sizes)
    for _ in range(width):
        yield at
        at = at + step


def _packed_planes(values: np.ndarray, width: int, sizes: np.ndarray) -> pa.Array:
    """Like ``_packed``, with the bytes of a row in planes: high bytes that agree or run in order compress, however few numbers a row has."""
    raw = np.asarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    data = np.empty(len(raw) * width, np.uint8)
    for k, at in enumerate(_planes(sizes, width)):
        data[at] = raw[:, k]
    offsets = np.concatenate([[0], width * np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked_planes(packed: pa.Array, width: int) -> np.ndarray:
    """Flat uint64 numbers of rows that ``_packed_planes`` made."""
    if not len(packed):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    for k, at in enumerate(_planes(np.diff(offsets).astype(np.int64) // width, width)):
        wide[:, k] = raw[at]
    return wide.ravel().view("<u8").astype(np.uint64, copy=False)


#: Bytes of a stored shingle, and its bits.
TOKEN = 6
TOKEN_BITS = 8 * TOKEN


def _stored(keyed: DataFrame, size: int) -> DataFrame:
    """Every line with words: set_hash, n, doc_id, row, line, full, tokens; and one row a task that carries only its sketch.

    ``full`` stands on the first such line of a document and counts them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["set_hash", "n", "doc_id", "row", "line", "full", "tokens", "sketch"]
        for part, text in W.chunks(batches):
            found = Lines(text, size)
            token = found.hashes >> np.uint64(64 - TOKEN_BITS)
            sketch += np.bincount((token >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            full = np.flatnonzero(found.n)
            of = found.text[full]
            head = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
            counted = np.bincount(of, minlength=len(text))[of].astype(np.int32)
            columns = [
                _longs(found.set_hash[full]), pa.array(found.n[full].astype(np.int32)), part.column(1).take(pa.array(of)), part.column(2).take(pa.array(of)),
                pa.array(found.number[full].astype(np.int32)), pa.array(counted, mask=~head), _packed(token, TOKEN, found.n[full]),
            ]
            yield pa.record_batch([*columns, pa.nulls(len(full), pa.binary())], names)
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())]
        yield pa.record_batch([*empty, pa.array([sketch.tobytes()], pa.binary())], names)
        W.give_back()

    schema = "set_hash long, n int, doc_id long, row long, line int, full int, tokens binary, sketch binary"
    # Hashes do not compress, and sets of them make no dictionary.
    return materialize(keyed.select("text", "doc_id", "row").mapInArrow(run, schema), "lines", "none", {"parquet.enable.dictionary#tokens": "false"})


def rarity(stored: DataFrame) -> tuple[np.ndarray, int]:
    """Count sketch of all shingles (2**SKETCH_BITS counters, summed over all tasks in a tree), and their number.

    Counters that do not stand out of the noise of their neighbours become 0, so the order by
    (counter, hash) puts frequent shingles last and is the same total order everywhere.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for one in batch.column(0):
                total += np.frombuffer(one.as_buffer(), np.uint32 if len(one.as_buffer()) == 4 << SKETCH_BITS else np.int64)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sketch"])

    parts = stored.where("sketch is not null").select("sketch")
    n = parts.count()  # one for each task
    while n > SKETCHES:
        n = -(-n // SKETCHES)
        parts = materialize(parts.repartition(n).mapInArrow(add, "sketch binary"), "sketches")
    sketch = sum((np.frombuffer(one.as_buffer(), np.int64) for one in parts.coalesce(SKETCHES).mapInArrow(add, "sketch binary").toArrow()["sketch"]), np.zeros(1 << SKETCH_BITS, np.int64))
    usual = float(np.median(sketch))
    return np.where(sketch > usual + 8 * np.sqrt(usual) + 8, sketch - int(usual), 0), int(sketch.sum())


class Prefixes:
    """The prefixes of some stored sets: row index, shingle, place in the set and its rarity counter, all flat."""

    def __init__(self, token: np.ndarray, sizes: np.ndarray, sketch: np.ndarray):
        row = np.repeat(np.arange(len(sizes)), sizes)
        frequency = sketch[(token >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64)]
        heavy = np.zeros(len(sizes), bool)
        heavy[row[frequency > 0]] = True
        if heavy.any():  # stored shingles are in the order of their hashes; only these rows change theirs
            at = np.flatnonzero(heavy[row])
            order = np.lexsort((token[at], frequency[at], row[at]))
            token, frequency = token.copy(), frequency.copy()
            token[at], frequency[at] = token[at][order], frequency[at][order]
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ok = pos < np.repeat(sizes - (NEAR[0] * sizes + NEAR[1] - 1) // NEAR[1] + 1, sizes)
        self.row, self.token, self.pos, self.frequency = row[ok], token[ok], pos[ok], frequency[ok]


def _possible(n_a, pos_a, n_b, pos_b, both, least, greatest):
    """Length and positional filter of two sets at one shingle, over arrays or columns (``both`` is their "and")."""
    left = least(n_a - pos_a, n_b - pos_b)
    enough = both(NEAR[1] * least(n_a, n_b) >= NEAR[0] * greatest(n_a, n_b), (NEAR[0] + NEAR[1]) * left >= NEAR[0] * (n_a + n_b))
    return enough | (greatest(n_a, n_b) >= MOST_N)


def _possible_arrays(n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _possible(n[a], pos[a], n[b], pos[b], np.logical_and, np.minimum, np.maximum)


def _possible_columns(a: str, b: str) -> Column:
    return _possible(*[F.col(f"{x}.{c}") for x in (a, b) for c in ("n", "pos")], lambda x, y: x & y, F.least, F.greatest)


#: Bytes of a posting's parts (shingle, set, hint, n, place) in a block, and their types in a task.
_POSTING = ((TOKEN, np.uint64), (8, np.uint64), (3, np.uint32), (2, np.uint16), (2, np.uint16))
#: The part without planes: whole hashes of sets repeat from one posting to the next, their bytes do not.
_SETS = 1


def _blocks(token: np.ndarray, key: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    """One row for each key: its postings in packed columns."""
    order = np.argsort(key, kind="stable")
    keys, sizes = np.unique(key, return_counts=True)
    packed = [(_packed if k == _SETS else _packed_planes)(values[order], width, sizes) for k, (values, width) in enumerate([(token, TOKEN), *columns])]
    return pa.record_batch([pa.array(keys.astype(np.int32)), *packed], ["range", "token", "sets", "hint", "n", "pos"])


def _candidates(stored: DataFrame, sketch: np.ndarray, total: int, hints: tuple[int, int]) -> DataFrame:
    """Candidate pairs (a, b) of short lists, and the rows (token, a, n, pos, hint) of long ones (there ``b`` is null).

    ``hint`` is the doc_id of a set's first place on a scale of 24 bits; it never decreases in the order of places.
    """
    spark = stored.sparkSession
    order = share_value(spark, sketch)
    ranges = 1 << max(5, int(total // (4 * RANGE_POSTINGS)).bit_length())
    lo, span = hints[0], max(1, hints[1] - hints[0])

    def hint_of(doc_ids: pa.Array) -> np.ndarray:
        scaled = (doc_ids.to_numpy(zero_copy_only=False).astype(np.float64) - lo) / span
        return np.clip(np.nan_to_num(scaled, nan=0.0) * 16_777_214 + 1, 0, 16_777_215).astype(np.uint64)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            token, sets, hint, n, pos, frequent = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            by_token = (token >> np.uint64(TOKEN_BITS - 16)).astype(np.int64) * ranges >> 16
            by_set = (sets >> np.uint64(40)).astype(np.int64) % ranges
            return _blocks(token, np.where(frequent, by_set, by_token), [(sets, 8), (hint, 3), (n, 2), (pos, 2)])

        for batch in batches:
            sets = np.asarray(batch.column(1)).view(np.uint64)
            hint = np.where(np.asarray(batch.column(3).is_null()), 0, hint_of(batch.column(3))).astype(np.uint64)
            once = np.lexsort((hint, sets))
            once = np.sort(once[np.concatenate([[True], sets[once][1:] != sets[once][:-1]])]) if len(once) else once
            token, sizes = _unpacked(batch.column(0).take(pa.array(once)), TOKEN)
            found = Prefixes(token, sizes, order.value)
            row = once[found.row]
            n = np.minimum(np.asarray(batch.column(2)), MOST_N).astype(np.uint64)
            held.append((found.token, sets[row], hint[row], n[row], np.minimum(found.pos, MOST_N).astype(np.uint64), found.frequency > FREQUENT))
            waiting += len(row)
            if waiting > FLUSH:
                yield flush()
                waiting = 0
        if held:
            yield flush()
        W.give_back()

    blocks = stored.where("sketch is null").select("tokens", "set_hash", "n", "doc_id").mapInArrow(post, "range int, token binary, sets binary, hint binary, n binary, pos binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda part, k, width: _unpacked(part, width)[0] if k == _SETS else _unpacked_planes(part, width)
        held = [[read(batch.column(k + 1), k, width).astype(kind) for k, (width, kind) in enumerate(_POSTING)] for batch in batches]
        if held:
            yield from lists_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        del held
        W.give_back()

    def lists_of(token, sets, hint, n, pos) -> Iterator[pa.RecordBatch]:
        """The lists of one range: only shingles of two sets and more are sorted in full."""
        order_ = np.argsort(token)
        twice = np.zeros(len(token), bool)
        same = np.flatnonzero(token[order_][1:] == token[order_][:-1])
        twice[order_[same]] = twice[order_[same + 1]] = True
        frequent = order.value[(token >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64)] > FREQUENT
        at = np.flatnonzero(twice | frequent)
        at = at[np.lexsort((hint[at], sets[at], token[at]))]  # of a set's postings the earliest counts
        at = at[np.concatenate([[True], (token[at][1:] != token[at][:-1]) | (sets[at][1:] != sets[at][:-1])])] if len(at) else at
        at = at[np.lexsort((sets[at], hint[at], token[at]))]
        token, sets, hint, n, pos, frequent = token[at], sets[at], hint[at], n[at].astype(np.int64), pos[at].astype(np.int64), frequent[at]
        first = np.concatenate([[True], token[1:] != token[:-1]]) if len(at) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        size = np.bincount(group)[group] if len(at) else group
        long = frequent | (size > SHORT_LIST)
        pairs = []
        for step in range(1, SHORT_LIST):
            late = np.arange(step, len(at))
            late = late[(group[late] == group[late - step]) & ~long[late]]
            late = late[_possible_arrays(n, pos, late, late - step)]
            pairs.append(np.stack([np.minimum(sets[late].view(np.int64), sets[late - step].view(np.int64)), np.maximum(sets[late].view(np.int64), sets[late - step].view(np.int64))], axis=1))
        pairs = np.concatenate(pairs)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        start = np.flatnonzero(first)
        sizes = np.diff(np.append(start, len(at)))
        held = (sizes > SHORT_LIST) & (sizes <= HELD_LIST) & ~frequent[start]
        for i, m in zip(start[held].tolist(), sizes[held].tolist(), strict=True):
            here = slice(i, i + m)
            met = _possible(n[here, None], pos[here, None], n[here], pos[here], np.logical_and, np.minimum, np.maximum)
            long[here] = met.sum(axis=1) > met.diagonal()
        none = lambda t: pa.nulls(len(pairs), t)
        names = ["a", "b", "token", "n", "pos", "hint"]
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int32())], names)
        for some in np.array_split(np.flatnonzero(long), max(1, int(long.sum()) // 100_000)):
            yield pa.record_batch([_longs(sets[some]), pa.nulls(len(some), pa.int64()), _longs(token[some]), *[pa.array(x[some].astype(np.int32)) for x in (n, pos, hint)]], names)

    dealt = blocks.repartition(ranges, "range")
    return materialize(dealt.mapInArrow(meet, "a long, b long, token long, n int, pos int, hint int"), "candidates")


def _marked(rows: DataFrame, keys: DataFrame, column: str, bits: int) -> DataFrame:
    """``rows`` whose ``set_hash`` a bitmap of ``keys`` lets pass; an exact join follows. Only the hashes go to Python."""
    bitmap = share_value(rows.sparkSession, key_bitmap(keys, column, bits))

    @F.pandas_udf("boolean")
    def marked(key: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap.value, key.to_numpy().view(np.uint64)))

    return rows.where(marked("set_hash"))


def _full_sets(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_hash, n, tokens, bitmap, place) of the wanted sets, one row each; ``place`` is the first (doc_id, row, line) of a set."""
    spark = stored.sparkSession
    bitmap = share_value(spark, key_bitmap(wanted, "set_hash", 26))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap.value, np.asarray(batch.column(0)).view(np.uint64))))
            key, row, line = (np.asarray(batch.column(k)) for k in (0, 3, 4))
            order = np.lexsort((line, row, np.asarray(batch.column(2).fill_null(0)), np.asarray(batch.column(2).is_valid()), key))
            once = batch.take(pa.array(np.sort(order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(key) else order)))
            token, sizes = _unpacked(once.column(1), TOKEN)
            place = (W.mix(token) >> np.uint64(40)).astype(np.int64) % (64 * WIDE_WORDS)
            wide = np.zeros(len(sizes) * WIDE_WORDS, np.uint64)
            np.bitwise_or.at(wide, np.repeat(np.arange(len(sizes)), sizes) * WIDE_WORDS + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            yield pa.record_batch([*once.columns, pa.array(sizes.astype(np.int32)), W.list_array(wide, np.arange(len(sizes) + 1) * WIDE_WORDS)], ["set_hash", "tokens", "doc_id", "row", "line", "n", "bitmap"])

    sets = stored.where("sketch is null").select("set_hash", "tokens", "doc_id", "row", "line").mapInArrow(run, "set_hash long, tokens binary, doc_id long, row long, line int, n int, bitmap array<long>")
    first = F.min(F.struct("doc_id", "row", "line")).alias("place")
    return sets.join(wanted, "set_hash", "left_semi").groupBy("set_hash").agg(*[F.any_value(c).alias(c) for c in ("n", "tokens", "bitmap")], first)


def _by_bitmap(n_a: Column, a: Column, n_b: Column, b: Column) -> Column:
    """Sets whose bitmaps differ in h bits differ in h members at least, so they share (n_a + n_b - h) / 2 at most."""
    differ = F.lit(0)
    for k in range(WIDE_WORDS):
        differ = differ + F.bit_count(a[k].bitwiseXOR(b[k]))
    common = F.shiftright(n_a + n_b - differ, 1)
    return NEAR[1] * common >= NEAR[0] * (n_a + n_b - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_hash), the later set of each pair (a, b) that is near: first by bitmaps, then by the whole sets."""
    side = lambda name, *columns: sets.select(F.col("set_hash").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])  # noqa: E731  of ``sets`` as they are then
    close = pairs.join(side("a", "n", "bitmap"), "a").join(side("b", "n", "bitmap"), "b")
    close = materialize(close.where(_by_bitmap(F.col("a_n"), F.col("a_bitmap"), F.col("b_n"), F.col("b_bitmap"))).select("a", "b"), "close-pairs")
    ends = close.select(F.explode(F.array("a", "b")).alias("set_hash"))
    sets = _marked(sets.select("set_hash", "tokens", "place"), ends, "set_hash", 25)  # few sets are in close pairs; the others are not moved
    both = close.join(side("a", "tokens", "place"), "a").join(side("b", "tokens", "place"), "b")
    both = both.select(F.when(F.col("a_place") < F.col("b_place"), F.col("b")).otherwise(F.col("a")).alias("set_hash"), "a_tokens", "b_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            (a, na), (b, nb) = _unpacked(batch.column(1), TOKEN), _unpacked(batch.column(2), TOKEN)
            # A shingle that both sets of a pair hold comes twice in the sorted union of (pair, shingle).
            pair, token = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)]), np.concatenate([a, b])
            order = W.order_by_text(token << np.uint64(64 - TOKEN_BITS), pair)
            pair, token = pair[order], token[order]
            twice = (token[1:] == token[:-1]) & (pair[1:] == pair[:-1])
            common = np.bincount(pair[1:][twice], minlength=n)
            yield batch.select([0]).filter(pa.array(NEAR[1] * common >= NEAR[0] * (na + nb - common)))

    return both.mapInArrow(run, "set_hash long").distinct()


def _banded(rows: DataFrame, reach: int) -> DataFrame:
    """``rows`` with the length band that they meet others in: their own, and ``reach`` bands on either side. Near sets are at most one band apart."""
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(NEAR[1] / NEAR[0])) + 1e-9).cast("int")
    return rows.withColumn("band", F.explode(F.sequence(own - reach, own + reach)) if reach else own)


#: Members of a list of equal size and place: all of them can be near the same others, as far as sizes and places tell.
CELL = ("token", "n", "pos")


def _cells(rows: DataFrame) -> DataFrame:
    """The cells of ``rows``, one row each, with the least and the greatest of their members and of their hints."""
    return rows.groupBy(*CELL).agg(*[f(c).alias(f"{c}_{name}") for c in ("a", "hint") for name, f in (("lo", F.min), ("hi", F.max))])


def _cell_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(token, n_x, pos_x, n_y, pos_y): the cells of a list in which a member of ``left`` can meet an earlier one of ``right``, as far as sizes, places and hints tell."""
    alone = (F.col("x.a_lo") == F.col("y.a_hi")) & (F.col("x.a_hi") == F.col("y.a_lo"))  # the same single member on both sides
    met = _banded(left, 1).alias("x").join(_banded(right, 0).alias("y"), ["token", "band"])
    met = met.where(_possible_columns("x", "y") & (F.col("y.hint_lo") <= F.col("x.hint_hi")) & ~alone)
    return met.select("token", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("x", "y") for c in ("n", "pos")]).distinct()


def _in_long_lists(long: DataFrame, sets: DataFrame, gone: DataFrame) -> DataFrame:
    """What goes besides ``gone`` by comparisons in long lists: with the earliest set of a length, then of what is left with all earlier ones."""
    pair = (F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b"))
    members = materialize(_banded(long, 0), "long-lists")
    leads = members.groupBy("token", "band").agg(F.min(F.struct("hint", "a", "n", "pos")).alias("lead")).select("token", "lead.*")
    left = long.join(gone, F.col("a") == F.col("set_hash"), "left_anti")
    stars = _banded(leads, 1).alias("x").join(_banded(left, 0).alias("y"), ["token", "band"]).where((F.col("x.a") != F.col("y.a")) & _possible_columns("x", "y"))
    first = materialize(_verified(stars.select(*pair).distinct(), sets), "gone-long").union(gone)
    left = long.join(first, F.col("a") == F.col("set_hash"), "left_anti")
    cells = _cell_pairs(materialize(_cells(left), "left-cells"), materialize(_cells(members), "cells"))
    bits = sets.select(F.col("set_hash").alias("a"), F.col("n").alias("size"), "bitmap")
    side = lambda rows, name: rows.join(bits, "a").select("token", *[F.col(c).alias(f"{c}_{name}") for c in ("n", "pos", "a", "hint", "size", "bitmap")])
    met = side(left, "x").join(cells, ["token", "n_x", "pos_x"]).join(side(long, "y"), ["token", "n_y", "pos_y"])
    may = (F.col("a_x") != F.col("a_y")) & (F.col("hint_y") <= F.col("hint_x")) & _by_bitmap(F.col("size_x"), F.col("bitmap_x"), F.col("size_y"), F.col("bitmap_y"))
    rest = met.where(may).select(F.least("a_x", "a_y").alias("a"), F.greatest("a_x", "a_y").alias("b")).distinct()
    return first.union(_verified(rest, sets)).distinct()


def kept_lines(docs: DataFrame, size: int = 5) -> DataFrame:
    """(row, lines, loses): the numbers of all lines with words that stay, and whether others go; ``row`` is xxhash64(doc_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    before = shared()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))
    hints = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    stored = _stored(keyed, size)
    lines = stored.where("sketch is null")
    candidates = _candidates(stored, *rarity(stored), (hints[0] or 0, hints[1] or 0))
    tidy(spark)
    places = lines.groupBy("set_hash").agg(F.min(F.struct("doc_id", "row", "line")).alias("place"))
    places = materialize(places, "places")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("set_hash")).where("set_hash is not null").distinct()
    sets = materialize(_full_sets(stored, wanted), "full-sets", "none", {"parquet.enable.dictionary#tokens": "false"})
    documents = materialize(lines.where("full is not null").groupBy("row").agg(F.max("full").alias("full")), "line-totals")
    release(spark, [stored.scratch_path])

    pairs = candidates.where("b is not null").select("a", "b").distinct()
    gone = materialize(_verified(pairs, sets), "gone-short")
    long = candidates.where("b is null").drop("b")
    if not long.isEmpty():
        gone = materialize(_in_long_lists(long, sets, gone), "gone")
    lost = sets.select("set_hash", "place").join(gone, "set_hash", "left_semi").select("place.row", F.lit(None).cast("int").alias("line"), F.col("place.line").alias("lost"))
    first = places.select("place.row", "place.line", F.lit(None).cast("int").alias("lost")).union(lost)
    stay = first.groupBy("row").agg(F.array_except(F.collect_list("line"), F.collect_list("lost")).alias("lines"))
    kept = documents.join(stay, "row", "left")
    kept = materialize(kept.select("row", "lines", (F.col("full") > F.coalesce(F.size("lines"), F.lit(0))).alias("loses")), "kept-lines")
    destroy_shared([one for one in shared() if one not in before])
    return kept


def deduplicate_lines(docs: DataFrame, size: int = 5, counts: bool = True) -> DataFrame:
    """``docs`` with later near copies of lines removed from ``text``, and columns ``n_lines`` and ``n_lines_removed`` if ``counts``.

    Only documents that lose lines (and a few that a bitmap of fixed size takes for such) are moved. Columns
    of ``docs`` that are named like the two counts are replaced by them, and kept without ``counts``.
    """
    if counts:
        docs = docs.drop("n_lines", "n_lines_removed")
    kept = kept_lines(docs, size).where("loses").select(F.col("row").alias("__kept_row"), F.coalesce("lines", F.lit([]).cast("array<int>")).alias("__kept_lines"))
    bitmap = share_value(docs.sparkSession, key_bitmap(kept, "__kept_row", 24))

    @F.pandas_udf("boolean")
    def may_lose(row: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap.value, row.to_numpy().view(np.uint64)))

    columns = docs.columns
    numbers = ["n_lines", "n_lines_removed"] if counts else []
    marked = docs.withColumn("__kept_row", F.xxhash64("doc_id", "text")).withColumn("__may_lose", may_lose("__kept_row"))
    breaks = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    plain = [breaks.alias("n_lines"), F.lit(0).cast("long").alias("n_lines_removed")] if counts else []
    whole = marked.where(~F.col("__may_lose")).select(*columns, *plain)
    joined = marked.where("__may_lose").join(kept, "__kept_row", "left").select(*columns, "__kept_lines")
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in W.chunks(batches):
            texts, lines_in, lines_gone = [], [], []
            for one, null, keep in zip(text.to_pylist(), part.column(at).is_null().to_pylist(), part.column(len(columns)).to_pylist(), strict=True):
                lines, stay = one.split("\n"), set(keep or ())
                out = lines if keep is None else [x for k, x in enumerate(lines) if k in stay or not x.strip(" \t\n\v\f\r")]
                texts.append(None if null else "\n".join(out))
                lines_in.append(0 if null else len(lines))
                lines_gone.append(0 if null else len(lines) - len(out))
            arrays = [pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(len(columns))]
            counted = [pa.array(lines_in, pa.int64()), pa.array(lines_gone, pa.int64())] if counts else []
            yield pa.record_batch([*arrays, *counted], [*columns, *numbers])

    schema = docs.select(*columns, *[F.lit(0).cast("long").alias(name) for name in numbers]).schema
    for field in schema:
        field.nullable = True
    return whole.union(joined.mapInArrow(run, schema))
