"""N-gram Jaccard join of whole texts over a count-vector R-tree; all links between different sets count.

A text is its set of distinct 5-word shingles. Its point is a vector of counts: shingles are hashed into groups
(about an eighth as many as shingles, a power of two), and each coordinate counts one group. Two sets share at
most the sum of the smaller coordinates of their points, and at most that sum over the upper corners of two
rectangles that hold them; so rectangles and points rule pairs out, and what is left is verified on whole sets.

1. One pass gives every text the hash of its set and its point, and a count sketch of fixed size of all shingles.
   Equal sets are one class.
2. The top level of the tree is dealt by shingles, for a lossless split over machines: near sets share one of their
   n - ceil(0.8 n) + 1 rarest shingles. Postings of classes travel in packed blocks by range of shingles; shingles that
   stand out in the sketch are dealt by sets. A member of a list stays if sizes and places allow a link with another.
3. A list of up to ``LEAF`` members is one leaf: its pairs go on. In longer lists the members of each size band first
   meet ``LEADERS`` of them. What the summed minima of the points let pass is verified on whole sets.
4. Long lists that still hold several components become leaves of ``LEAF`` points, packed in order of component and size,
   each with its rectangle. Leaves meet if their sizes, components and the summed minima of their corners allow a link;
   then their points meet. A point takes its best few partners of a list, as far as summed minima tell; these are verified,
   components grow, and lists that are still apart meet again with ever more partners, until no point has left one out.

No step makes the pairs within a component, so copies and near copies of one text cost a row each and list.

Defined results: A-Z are lower-cased; a text of fewer than five words has its whole sequence as its one shingle;
a null or wordless text has the empty set and is linked with nothing; repeated rows are one class; the component
is named by the smallest doc_id (null only if all are null); an empty table gives an empty result; only ``doc_id``
and ``text`` are read. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .lines import FLUSH, FREQUENT, RANGE_POSTINGS, SKETCH_BITS, TOKEN, TOKEN_BITS, _packed, _unpacked, rarity
from .minhash import _merged
from .scratch import bound_batches, destroy_shared, in_bitmap, key_bitmap, materialize, share_value, shared

#: Least similarity as a fraction of integers.
NEAR = (80, 100)
#: Points of a leaf; coordinates of a rectangle, and least coordinates of a point.
LEAF, CORNERS = 16, 64
#: Members that the others of a long list and size band meet first; partners in a list that a set takes in the first round, and so many times as many in each further one.
LEADERS, PARTNERS, MORE = 4, 4, 16
#: In lists of up to this length each member is held against all others before it stays.
SHORT = 1024
#: Hashes of sets that a task remembers, to post copies once.
REMEMBERED = 1 << 17
_POSTING = ((TOKEN, np.uint64), (8, np.uint64), (4, np.int64), (4, np.int64))


def _shingled(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    flat, counts = W.split(pc.ascii_lower(text))
    return W.shingles(W.codes(flat), counts, size)


def _sets_of(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_hash, point, corner of every row; and one row a task that carries only its sketch of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n_shingles", "set_hash", "point", "corner", "sketch"]
        for part, text in W.chunks(batches):
            hashes, of = _shingled(text, size)
            sketch += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            n = np.bincount(of, minlength=len(text)).astype(np.int64)
            set_hash = W.set_hash(hashes, of, len(text)).view(np.int64)
            counts, at = count_points(hashes, of, len(text))
            point = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(counts)])
            corner = np.add.reduceat(counts, (at[:-1, None] + np.arange(CORNERS) * (np.diff(at)[:, None] // CORNERS)).ravel(), dtype=np.uint16)
            yield pa.record_batch([part.column(0), pa.array(n), pa.array(set_hash), point, _corners(corner), pa.nulls(len(text), pa.binary())], names)
        yield pa.record_batch([*[pa.nulls(1, pa.int64())] * 3, *[pa.nulls(1, pa.binary())] * 2, pa.array([sketch.tobytes()], pa.binary())], names)

    return materialize(docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash long, point binary, corner binary, sketch binary"), "sets-of")


def _corners(flat: np.ndarray) -> pa.Array:
    """Packed rows of ``CORNERS`` counts."""
    n = len(flat) // CORNERS
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 2 * CORNERS).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, np.uint16))])


def _matrix(packed: pa.Array) -> np.ndarray:
    """Rows of counts out of packed rows of one length."""
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint16).reshape(len(packed), -1).astype(np.int32)


def _rarest(hashes: np.ndarray, of: np.ndarray, sizes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, ...]:
    """The shingles of each set's prefix in the order (counter, hash): shingle of 48 bits, index of set, place, counter."""
    counter = sketch[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    heavy = np.zeros(len(sizes), bool)
    heavy[of[counter > 0]] = True
    at = np.flatnonzero(heavy[of])
    if len(at):  # the others are in this order already
        order = at[np.lexsort((hashes[at], counter[at], of[at]))]
        hashes, counter = hashes.copy(), counter.copy()
        hashes[at], counter[at] = hashes[order], counter[order]
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ok = place < np.repeat(sizes - (NEAR[0] * sizes + NEAR[1] - 1) // NEAR[1] + 1, sizes)
    return hashes[ok] >> np.uint64(64 - TOKEN_BITS), of[ok], place[ok], counter[ok]


def _lists(docs: DataFrame, sketch: np.ndarray, total: int, size: int) -> DataFrame:
    """Pairs (a, b) out of lists of one leaf, and the rows (key, a, n, pos) of longer lists (there ``b`` is null)."""
    order = share_value(docs.sparkSession, sketch)
    ranges = 1 << max(5, int(total // (5 * RANGE_POSTINGS)).bit_length())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting, seen = 0, set()

        def flush() -> pa.RecordBatch:
            token, sets, n, pos, frequent = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            by_token = (token >> np.uint64(TOKEN_BITS - 16)).astype(np.int64) * ranges >> 16
            by_set = (sets >> np.uint64(40)).astype(np.int64) % ranges
            key = np.where(frequent, by_set, by_token)
            at = np.argsort(key, kind="stable")
            keys, sizes = np.unique(key, return_counts=True)
            packed = [_packed(x[at], width, sizes) for x, (width, _) in zip((token, sets, n, pos), _POSTING, strict=True)]
            return pa.record_batch([pa.array(keys.astype(np.int32)), *packed], ["range", "token", "sets", "n", "pos"])

        for _, text in W.chunks(batches):
            hashes, of = _shingled(text, size)
            sets = W.set_hash(hashes, of, len(text))
            new = np.zeros(len(sets), bool)
            for k, one in enumerate(sets.tolist()):
                if one not in seen:
                    new[k] = True
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(one)
            ok = new[of]
            hashes, of = hashes[ok], of[ok]
            sizes = np.bincount(of, minlength=len(text))
            token, row, pos, counter = _rarest(hashes, of, sizes, order.value)
            held.append((token, sets[row], sizes[row].astype(np.uint64), pos.astype(np.uint64), counter > FREQUENT))
            waiting += len(row)
            if waiting > FLUSH:
                yield flush()
                waiting = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[_unpacked(batch.column(k + 1), width)[0].astype(kind) for k, (width, kind) in enumerate(_POSTING)] for batch in batches]
        if not held:
            return
        token, sets, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        by_token = np.argsort(token)
        twice = np.zeros(len(token), bool)
        same = np.flatnonzero(token[by_token][1:] == token[by_token][:-1])
        twice[by_token[same]] = twice[by_token[same + 1]] = True
        frequent = order.value[(token >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64)] > FREQUENT
        at = np.flatnonzero(twice | frequent)
        at = at[np.lexsort((sets[at], token[at]))]
        if len(at):  # a set that was posted by several tasks counts once
            at = at[np.concatenate([[True], (token[at][1:] != token[at][:-1]) | (sets[at][1:] != sets[at][:-1])])]
        token, sets, n, pos, frequent = (x[at] for x in (token, sets, n, pos, frequent))
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(at)))
        small = (size > 1) & (size <= LEAF) & ~frequent[first]
        a, b = _within(first[small], size[small])
        ok = _admissible(n[a], pos[a], n[b], pos[b])
        pairs = np.stack([sets[a[ok]].view(np.int64), sets[b[ok]].view(np.int64)], axis=1)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
        names = ["key", "a", "b", "n", "pos"]
        yield pa.record_batch([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[pa.nulls(len(pairs), pa.int32())] * 2], names)
        for i, m in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
            here = np.arange(i, i + m)
            if m <= SHORT and not frequent[i]:
                with_ = _admissible(n[here, None], pos[here, None], n[here], pos[here])
                here = here[with_.sum(axis=1) > with_.diagonal()]
            if len(here):
                yield pa.record_batch([pa.array(token[here].view(np.int64)), pa.array(sets[here].view(np.int64)), pa.nulls(len(here), pa.int64()), pa.array(n[here].astype(np.int32)), pa.array(pos[here].astype(np.int32))], names)

    blocks = docs.mapInArrow(post, "range int, token binary, sets binary, n binary, pos binary")
    return materialize(blocks.repartition(ranges, "range").mapInArrow(meet, "key long, a long, b long, n int, pos int"), "lists")


def _within(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in groups that begin at ``first``; a group has ``LEAF`` places at most."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(LEAF):
        for j in range(i + 1, LEAF):
            some = first[size > j]
            left.append(some + i)
            right.append(some + j)
    return np.concatenate(left), np.concatenate(right)


def _admissible(n_a: np.ndarray, pos_a: np.ndarray, n_b: np.ndarray, pos_b: np.ndarray) -> np.ndarray:
    """Sizes allow a link, and if this shingle is the first that both share, each has as many left as they must share."""
    fits = NEAR[1] * np.minimum(n_a, n_b) >= NEAR[0] * np.maximum(n_a, n_b)
    return fits & ((NEAR[0] + NEAR[1]) * np.minimum(n_a - pos_a, n_b - pos_b) >= NEAR[0] * (n_a + n_b))


def count_points(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The points of ``n`` sets: flat counts of groups, and offsets. A set of m shingles has 2**k >= m / 8 groups, ``CORNERS`` at least."""
    sizes = np.bincount(of, minlength=n)
    bits = np.maximum(int(np.log2(CORNERS)), np.ceil(np.log2(np.maximum(sizes, 8) / 8)).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(1 << bits)])
    group = (hashes >> (np.uint64(64) - bits[of].astype(np.uint64))).astype(np.int64)
    return np.bincount(at[of] + group, minlength=at[-1]).astype(np.uint16), at


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts with neighbouring groups added up until ``groups`` are left."""
    return points.reshape(len(points), groups, -1).sum(axis=2)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_hash, shingles) of the wanted classes (set_hash, doc_id), one row each. Other texts are skipped before they are read as words."""
    bitmap = share_value(docs.sparkSession, key_bitmap(wanted.select(F.xxhash64("doc_id").alias("k")), "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap.value, np.asarray(batch.column(2)).view(np.uint64))))
            for _, text in W.chunks(iter([batch])):
                hashes, of = _shingled(text, size)
                yield pa.record_batch([pa.array(W.set_hash(hashes, of, len(text)).view(np.int64)), W.list_array(hashes, W.starts(of, len(text)))], ["set_hash", "shingles"])

    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k")).mapInArrow(run, "set_hash long, shingles array<long>")
    return materialize(found.join(wanted.select("set_hash"), "set_hash", "left_semi").groupBy("set_hash").agg(F.any_value("shingles").alias("shingles")), "sets")


def summed_minima(a: pa.Array, b: pa.Array) -> np.ndarray:
    """For rows of two columns of packed points: the most shingles that the two sets can share."""
    out = np.zeros(len(a), np.int64)
    size_a, size_b = (np.asarray(pc.binary_length(x)).astype(np.int64) // 2 for x in (a, b))
    for kind in np.unique(np.stack([size_a, size_b]), axis=1).T if len(a) else ():
        at = np.flatnonzero((size_a == kind[0]) & (size_b == kind[1]))
        for some in np.array_split(at, -(-len(at) * int(kind.max()) // (1 << 20))):
            x, y = (np.frombuffer(b"".join(v.take(pa.array(some)).to_pylist()), np.uint16).reshape(len(some), -1) for v in (a, b))
            out[some] = np.minimum(folded(x, int(kind.min())), folded(y, int(kind.min()))).sum(axis=1)
    return out


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and points allow a link; further columns of longs are kept."""
    columns = pairs.columns
    side = lambda name: classes.select(F.col("set_hash").alias(name), F.col("n").alias(f"n_{name}"), F.col("point").alias(f"point_{name}"))
    fits = NEAR[1] * F.least("n_a", "n_b") >= NEAR[0] * F.greatest("n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(0)).astype(np.int64) + np.asarray(batch.column(1))
            may = (NEAR[0] + NEAR[1]) * summed_minima(batch.column(2), batch.column(3)) >= NEAR[0] * n
            yield batch.select(columns).filter(pa.array(may))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
    return materialize(both.select("n_a", "n_b", "point_a", "point_b", *columns).mapInArrow(run, ", ".join(f"{c} long" for c in columns)), "close")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are near on their whole sets."""
    side = lambda name: sets.select(F.col("set_hash").alias(name), F.col("shingles").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return materialize(both.where(NEAR[1] * F.col("common") >= NEAR[0] * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b"), "links")


def _sets_of_pairs(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("set_hash")).distinct().union(pairs.select("b").distinct()).distinct()  # both sides shrink before they are shuffled
    return _sets(docs, materialize(classes.join(ends, "set_hash", "left_semi").select("set_hash", "doc_id"), "ends"), size)


def _band(n: str) -> Column:
    """The size band of a number of shingles; near sets are in the same or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(NEAR[1] / NEAR[0])) + 1e-9).cast("int")


def _with_leaders(long: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of each long list and size band with ``LEADERS`` of them, by chance."""
    banded = long.select("key", _band("n").alias("band"), "a")
    by_chance = [F.min(F.struct(F.xxhash64("a", F.lit(salt)).alias("chance"), F.col("a").alias("lead"))).alias(f"s{salt}") for salt in range(LEADERS)]
    leads = banded.groupBy("key", "band").agg(*by_chance)
    met = banded.join(leads, ["key", "band"]).select("a", F.explode(F.array(*[f"s{salt}.lead" for salt in range(LEADERS)])).alias("b")).where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(long: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, set_hash, n, pos, root) of the lists that hold more than one component; ``root`` is null for a class without links."""
    known = long.withColumnRenamed("a", "set_hash").join(roots.select(F.col("node").alias("set_hash"), "root"), "set_hash", "left")
    label = F.coalesce("root", "set_hash")
    torn = known.groupBy("key").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select("key")
    return materialize(known.join(torn, "key", "left_semi").select("key", "set_hash", "n", "pos", "root"), "apart")


def pack_leaves(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Leaves of ``LEAF`` members of a list, in order of component and size, with their rectangles."""
    rows = lists.join(classes.select("set_hash", "corner"), "set_hash").select("key", "set_hash", "n", "pos", F.coalesce("root", "set_hash").alias("label"), "corner", F.coalesce("root", F.lit(-(1 << 63))).alias("group"))
    order = ("key", "group", "n", "set_hash")
    schema = "key long, leaf long, n_lo int, n_hi int, label_lo long, label_hi long, top binary, sets array<long>, ns array<int>, places array<int>, labels array<long>, corners binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, sets, n, pos, label = (np.asarray(batch.column(k)) for k in range(5))
            if not len(key):
                continue
            corner = _matrix(batch.column(5))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            at = np.flatnonzero(rank % LEAF == 0)
            ends = np.append(at, len(key))
            lists_of = lambda x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x))
            edge = lambda f, x: pa.array(f.reduceat(x, at))
            points = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * 2 * CORNERS).astype(np.int32)), pa.py_buffer(corner.astype(np.uint16))])
            yield pa.record_batch(
                [pa.array(key[at]), pa.array(sets[at]), edge(np.minimum, n), edge(np.maximum, n), edge(np.minimum, label), edge(np.maximum, label),
                 _corners(np.maximum.reduceat(corner, at, axis=0).ravel()), lists_of(sets), lists_of(n), lists_of(pos), lists_of(label), points], names)

    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("group").mapInArrow(run, schema), "leaves")


def best_partners(a: np.ndarray, b: np.ndarray, score: np.ndarray, cut: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """For each ``a`` its ``most`` partners ``b`` of the highest score. ``cut`` stands on the rows of those that have left out some."""
    order = np.lexsort((b, -score, a))
    a, b, score, cut = a[order], b[order], score[order], cut[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(a)))
    keep = np.arange(len(a)) - np.repeat(first, sizes) < most
    some_cut = np.logical_or.reduceat(cut, first) if len(a) else cut
    return a[keep], b[keep], score[keep], np.repeat(some_cut | (sizes > most), sizes)[keep]


def _from_tree(leaves: DataFrame, most: int) -> DataFrame:
    """Candidate pairs (a, b) of different components out of all pairs of leaves that can hold a link: ``most`` partners of a set and list at most.

    A pair counts for its set in the left leaf. ``cut`` tells that this set has more partners in the list.
    """
    slim = leaves.select("key", "leaf", "n_lo", "n_hi", "label_lo", "label_hi", "top")
    x = slim.withColumn("band", F.explode(F.sequence(_band("n_lo") - 1, _band("n_hi") + 1))).alias("x")
    y = slim.withColumn("band", F.explode(F.sequence(_band("n_lo"), _band("n_hi")))).alias("y")
    sizes = (NEAR[1] * F.col("x.n_hi") >= NEAR[0] * F.col("y.n_lo")) & (NEAR[1] * F.col("y.n_hi") >= NEAR[0] * F.col("x.n_lo"))
    one = (F.col("x.label_lo") == F.col("x.label_hi")) & (F.col("y.label_lo") == F.col("y.label_hi")) & (F.col("x.label_lo") == F.col("y.label_lo"))

    def rectangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                most = np.minimum(_matrix(batch.column(4)), _matrix(batch.column(5))).sum(axis=1)
                yield batch.select([0, 1, 2]).filter(pa.array((NEAR[0] + NEAR[1]) * most >= NEAR[0] * np.asarray(batch.column(3)).astype(np.int64)))

    met = x.join(y, ["key", "band"]).where((F.col("x.leaf") <= F.col("y.leaf")) & sizes & ~one)
    met = met.select("key", F.col("x.leaf").alias("left"), F.col("y.leaf").alias("right"), (F.col("x.n_lo") + F.col("y.n_lo")).alias("n"), F.col("x.top").alias("top_x"), F.col("y.top").alias("top_y"))
    met = materialize(met.mapInArrow(rectangles, "key long, left long, right long").distinct(), "leaf-pairs")
    columns = ("sets", "ns", "places", "labels", "corners")
    side = lambda name: leaves.select("key", F.col("leaf").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    both = met.join(side("right"), ["key", "right"]).join(side("left"), ["key", "left"])

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        held, waiting, leaf, done = [none], 0, None, []  # ``held`` has the pairs of the left leaf at hand

        def best() -> tuple[np.ndarray, ...]:
            return best_partners(*(np.concatenate(x) for x in zip(*held, strict=True)), most)

        def told() -> pa.RecordBatch:
            a, b, _, cut = (np.concatenate(x) for x in zip(none, *done, strict=True))
            done.clear()
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cut)], ["a", "b", "cut"])

        for batch in batches:
            key, left, right = (np.asarray(batch.column(k)) for k in range(3))
            for k in range(batch.num_rows):
                if leaf != (key[k], left[k]):
                    done.append(best())
                    held, waiting, leaf = [none], 0, (key[k], left[k])
                (sa, na, qa, la), (sb, nb, qb, lb) = ([np.asarray(batch.column(3 + 5 * s + c)[k].values) for c in range(4)] for s in (0, 1))
                ca, cb = (np.frombuffer(batch.column(7 + 5 * s)[k].as_buffer(), np.uint16).reshape(-1, CORNERS) for s in (0, 1))
                na, nb = na.astype(np.int64), nb.astype(np.int64)
                may = (la[:, None] != lb) & _admissible(na[:, None], qa[:, None], nb, qb)
                i, j = np.nonzero(np.triu(may) if left[k] == right[k] else may)
                shared_most = np.minimum(ca[i], cb[j]).sum(axis=1, dtype=np.int64)
                ok = (NEAR[0] + NEAR[1]) * shared_most >= NEAR[0] * (na[i] + nb[j])
                i, j = i[ok], j[ok]
                held.append((sa[i], sb[j], shared_most[ok] / (na[i] + nb[j]), np.zeros(len(i), bool)))
                waiting += len(i)
                if waiting > 8 * LEAF * max(most, LEAF):
                    held = [best()]
                    waiting = 0
            yield told()
        done.append(best())
        yield told()

    wanted = ["key", "left", "right", *[f"{c}_{name}" for name in ("left", "right") for c in columns]]
    dealt = both.select(*wanted).repartition("key", "left").sortWithinPartitions("key", "left")
    found = dealt.mapInArrow(points, "a long, b long, cut boolean").groupBy("a", "b").agg(F.bool_or("cut").alias("cut"))
    return materialize(found, "tree-pairs")


def _in_rounds(docs: DataFrame, long: DataFrame, roots: DataFrame, tried: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """The components after all links between members of one list. In each round sets of lists that are still apart take more partners; the last one leaves none out."""
    for turn in count():
        apart = _apart(long, roots)
        if apart.isEmpty():
            return roots
        found = _from_tree(pack_leaves(apart, classes), PARTNERS * MORE**turn)
        more = _bounded(found.select("a", "b").join(tried, ["a", "b"], "left_anti"), classes)
        if not more.isEmpty():
            links = _confirmed(more, _sets_of_pairs(docs, more, classes, size))
            if not links.isEmpty():
                roots = _merged(roots, links)
            tried = tried.union(more)
        if found.where("cut").isEmpty():
            return roots


def linked_sets(docs: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """(node, root) of set hashes: the classes that have links, and one class for each component."""
    lists = _lists(docs.select("text"), *rarity(base), size)
    classes = base.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(d) for c, d in (("n_shingles", "n"), ("point", "point"), ("corner", "corner"))])
    classes = materialize(classes, "classes")
    long = lists.where("b is null").drop("b")
    pairs = _bounded(lists.where("b is not null").select("a", "b").union(_with_leaders(long)).distinct(), classes)
    roots = components(_confirmed(pairs, _sets_of_pairs(docs, pairs, classes, size)))
    return _in_rounds(docs, long, roots, pairs, classes, size)


def join_near(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) for every row."""
    bound_batches(docs.sparkSession)
    before = shared()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = _sets_of(docs, size)
    roots = linked_sets(docs, base, size).select(F.col("node").alias("set_hash"), "root")
    rows = base.where("sketch is null").select("doc_id", "n_shingles", "set_hash")
    classes = rows.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    known = classes.join(roots, "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
    known = materialize(known.where((F.col("copies") > 1) | F.col("root").isNotNull()).select("set_hash", "root", "least"), "class-roots")
    destroy_shared([one for one in shared() if one not in before])
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(known.join(least, "root").select("set_hash", "component_id"), "set_hash", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
