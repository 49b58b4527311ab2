"""Near-duplicate documents: b-bit MinHash signatures, band candidates, exact confirmation, components.

1. Each text becomes its set of distinct 5-word shingles, 128 minima, 32 band keys (four whole minima each)
   and a packed signature of the low 4 bits of each minimum.
2. Texts with equal sets form one class; only classes go on, so copies cost one row each.
3. Each bucket of a band compares its members with a leader (stars, not all pairs). Where the buckets whose
   members this leaves in several components hold too many pairs, those outside of the largest meet some of its
   members first; what is then still apart is compared pair by pair, in blocks of a bucket, and there a bitmap of each set also bounds the overlap.
   The collision-corrected similarity of the packed signatures must reach ``ESTIMATE`` before a pair is confirmed. Members of one component need no link more.
4. Pairs are confirmed on their full shingle sets, and the links' components are found by label rounds.

A pair of similarity 0.75 shares a band with probability 1 - (1 - 0.75**4)**32 > 0.99999 and is kept by
the estimate with probability > 0.999999 (five standard deviations).

Defined results: A-Z are lower-cased; a text of fewer than five words has its whole sequence as its one
shingle; a null or wordless text has the empty set and is linked with nothing; repeated rows are one class;
ties go to the smallest doc_id; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import bound_batches, destroy_shared, in_bitmap, key_bitmap, materialize, row_key, share_value, shared, without

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
#: Least similarity, as a fraction of integers, so that it is decided exactly.
NEAR = (75, 100)
ESTIMATE = 0.55
#: Words of the bitmap of a set that bounds overlaps exactly (2,048 bits).
BITMAP_WORDS = 32
#: Members of a bucket's core that all others meet in each round; most rounds.
CORE_LEADERS, CORE_ROUNDS = 4, 8
#: Pairs for each member of mixed buckets up to which they are compared without rounds; about 0.1 ms of a core.
PAIRS_A_MEMBER = 256
#: Members of a block of a bucket: a task compares two blocks at once. Pairs that are compared at once.
BLOCK, PAIRS_AT_ONCE = 512, 1 << 16
#: Pairs that a component gets of two blocks in the first round; times as many in each further one.
PARTNERS, MORE = 256, 16
#: Most large buckets that are broadcast.
BROADCAST_BUCKETS = 100_000


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = W.mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:MINIMA] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[MINIMA:] >> np.uint64(32)).astype(np.uint32)


def _shingled(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    flat, counts = W.split(pc.ascii_lower(text))
    return W.shingles(W.codes(flat), counts, size)


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, row, n_shingles, set_hash, sig (8 packed longs), bands (32 longs); the arrays are empty for the empty set. ``row`` is ``row_key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations()
        shift = np.uint64(BITS) * np.arange(64 // BITS, dtype=np.uint64)
        for part, text in W.chunks(batches):
            n = len(text)
            hashes, of = _shingled(text, size)
            at = W.starts(of, n)
            filled = np.flatnonzero(np.diff(at))
            minima = np.zeros((MINIMA, len(filled)), np.uint32)
            if len(filled):
                high = (hashes >> np.uint64(32)).astype(np.uint32)
                for k in range(MINIMA):
                    minima[k] = np.minimum.reduceat(high * a[k] + b[k], at[filled])
            wide = minima.astype(np.uint64)
            bands = np.zeros((BANDS, len(filled)), np.uint64)
            for k in range(ROWS):
                bands = W.mix(bands * np.uint64(0x9E3779B97F4A7C15) + wide[k::ROWS])
            bands = W.mix(bands + np.arange(BANDS, dtype=np.uint64)[:, None])
            low = (wide & np.uint64((1 << BITS) - 1)).T.reshape(len(filled), MINIMA * BITS // 64, 64 // BITS)
            sig = np.bitwise_or.reduce(low << shift, axis=2) if len(filled) else np.zeros((0, MINIMA * BITS // 64), np.uint64)
            there = np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
            yield pa.record_batch(
                [
                    part.column(0).cast(pa.int64()),
                    part.column(2),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array(W.set_hash(hashes, of, n).view(np.int64)),
                    W.list_array(np.ascontiguousarray(sig).ravel(), there * sig.shape[1]),
                    W.list_array(np.ascontiguousarray(bands.T).ravel(), there * BANDS),
                ],
                ["doc_id", "row", "n_shingles", "set_hash", "sig", "bands"],
            )

    return docs.select("doc_id", "text", row_key().alias("row")).mapInArrow(run, "doc_id long, row long, n_shingles long, set_hash long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity by bit counts over packed signatures, corrected for chance collisions of the kept bits."""
    ones = sum(1 << (BITS * k) for k in range(64 // BITS))
    differ = F.lit(0)
    for k in range(MINIMA * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        for shift in (2, 1):  # folds the bits of each minimum into its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 1 / (1 << BITS)
    return ((1 - differ / F.lit(MINIMA)) - chance) / (1 - chance)


def _possible(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (places a, b in the rows) can be near, and the most that they can share: by label, size, ``estimate``, and by the bitmaps, as sets whose bitmaps differ in h bits differ in h members at least."""
    label, n, sig, bitmap = rows["label"], rows["n"], rows["sig"], rows["bitmap"]
    keep = (label[a] != label[b]) & (NEAR[1] * np.minimum(n[a], n[b]) >= NEAR[0] * np.maximum(n[a], n[b]))
    left = np.flatnonzero(keep)
    a, b = a[left], b[left]
    ones = np.uint64(sum(1 << (BITS * k) for k in range(64 // BITS)))
    differ = np.zeros(len(left), np.int64)
    for word in sig:
        x = word[a] ^ word[b]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        differ += np.bitwise_count(x & ones)
    chance = 1 / (1 << BITS)
    near = np.flatnonzero(((1 - differ / MINIMA) - chance) / (1 - chance) >= ESTIMATE)
    left, a, b = left[near], a[near], b[near]
    differ = np.zeros(len(left), np.int64)
    for word in bitmap:
        differ += np.bitwise_count(word[a] ^ word[b])
    total = n[a] + n[b]
    most = (total - differ) // 2
    near = np.flatnonzero(NEAR[1] * most >= NEAR[0] * (total - most))
    left, a, b = left[near], a[near], b[near]
    key = rows["key"][a].view(np.uint64)
    first = key.copy()  # the key of the first band that both have: there alone the pair is told
    for band in rows["bands"][::-1]:
        first = np.where(band[a] == band[b], band[a], first)
    return left[first == key], most[near][first == key]


def _best(group: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the ``most`` of highest score of their group."""
    order = np.lexsort((-score, group))
    begins = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    at = np.flatnonzero(begins)
    keep = np.zeros(len(group), bool)
    keep[order] = np.arange(len(group)) - at[np.cumsum(begins) - 1] < most
    return keep


def _compare(batches: Iterator[pa.RecordBatch], partners: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that ``_possible`` lets pass, out of rows sorted by (key, low, high, block): members of one block meet each other, those of two meet across.

    Of two blocks each label gets its ``partners`` best pairs; ``more`` says that pairs were left for a further round.
    """
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if kept is None else [*kept, batch]).combine_chunks()
        group = np.stack([np.asarray(table[name]) for name in ("key", "low", "high")])
        new = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        done = int(new[-1]) if len(new) else 0  # the last group may go on in the next batch
        kept = table.slice(done).to_batches()
        if done:
            yield _compare_groups(table.slice(0, done), np.concatenate([[0], new]), partners)
    if kept is not None:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield _compare_groups(table, np.array([0, table.num_rows]), partners)


def _compare_groups(table: pa.Table, at: np.ndarray, partners: int) -> pa.RecordBatch:
    """``_compare`` for whole groups, which begin at ``at``."""
    wide = lambda name: np.ascontiguousarray(table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(table.num_rows, -1).T)
    rows = {name: np.asarray(table[name]) for name in ("key", "set_hash", "label", "n", "low", "high", "block")} | {name: wide(name) for name in ("sig", "bitmap", "bands")}
    sizes = np.diff(at)
    end, begin = np.repeat(at[1:], sizes), np.arange(table.num_rows) + 1
    first = rows["block"] == rows["low"]
    across = rows["low"] != rows["high"]
    second = np.repeat(at[:-1] + np.add.reduceat(first.astype(np.int64), at[:-1]), sizes)  # where the group's second block begins
    begin = np.where(across, np.where(first, second, end), begin)
    upto = np.concatenate([[0], np.cumsum(end - begin)])
    row, met = 0, []
    while row < table.num_rows:
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + PAIRS_AT_ONCE, "right")) - 1)
        many = end[row:stop] - begin[row:stop]
        a = np.repeat(np.arange(row, stop), many)
        b = np.arange(len(a)) - np.repeat(upto[row:stop] - upto[row], many) + np.repeat(begin[row:stop], many)
        found, score = _possible(rows, a, b)
        met.append((a[found], b[found], score))
        row = stop
    a, b, score = (np.concatenate(x) for x in zip(*met, strict=True))
    group = np.repeat(np.arange(len(sizes)), sizes)[a]
    _, label = np.unique(rows["label"], return_inverse=True)
    ends = np.concatenate([group * table.num_rows + label[a], group * table.num_rows + label[b]])
    keep = _best(ends, np.concatenate([score, score]), partners).reshape(2, -1).any(axis=0) if len(a) else np.zeros(0, bool)
    left = np.isin(group, group[~keep])
    x, y = rows["set_hash"][a[keep]], rows["set_hash"][b[keep]]
    return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(left[keep])], ["a", "b", "more"])


def _apart(mixed: DataFrame, large: DataFrame, classes: DataFrame, sets: DataFrame, partners: int) -> DataFrame:
    """Distinct pairs (a, b, more) of different labels in a bucket that can be near, as ``_compare`` tells them. ``large``: (key, n) of the buckets of more than one block.

    A bucket of k blocks is dealt as k * (k + 1) / 2 pairs of blocks, so that no task gets more than two blocks of a bucket at once.
    """
    blocks = F.ceil(F.coalesce("members", F.lit(1)) / BLOCK)
    dealt = mixed.join(large.withColumnRenamed("n", "members"), "key", "left").select("key", "set_hash", "label", F.pmod(F.xxhash64("set_hash"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set_hash", "label")
    known = classes.select("set_hash", "n", "sig", "bands").join(sets.select("set_hash", "bitmap"), "set_hash")
    whole = dealt.join(known, "set_hash").select("key", "low", "high", "block", "set_hash", "label", "n", "sig", "bitmap", "bands")
    dealt = whole.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "block")
    return dealt.mapInArrow(partial(_compare, partners=partners), "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_hash, shingles, bitmap) of the wanted classes, one row each. Other texts are skipped before they are read as words."""
    bitmap = share_value(docs.sparkSession, key_bitmap(wanted.select(F.xxhash64("doc_id").alias("k")), "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(2)).view(np.uint64)
            batch = batch.filter(pa.array(in_bitmap(bitmap.value, keys)))
            for _, text in W.chunks(iter([batch])):
                hashes, of = _shingled(text, size)
                at = W.starts(of, len(text))
                bitmap_of = np.zeros(len(text) * BITMAP_WORDS, np.uint64)
                place = (hashes >> np.uint64(40)).astype(np.int64) % (64 * BITMAP_WORDS)
                np.bitwise_or.at(bitmap_of, of * BITMAP_WORDS + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
                columns = [pa.array(W.set_hash(hashes, of, len(text)).view(np.int64)), W.list_array(hashes, at), W.list_array(bitmap_of, np.arange(len(text) + 1) * BITMAP_WORDS)]
                yield pa.record_batch(columns, ["set_hash", "shingles", "bitmap"])

    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k")).mapInArrow(run, "set_hash long, shingles array<long>, bitmap array<long>")
    return found.join(wanted.select("set_hash"), "set_hash", "left_semi").groupBy("set_hash").agg(F.any_value("shingles").alias("shingles"), F.any_value("bitmap").alias("bitmap"))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are near."""
    first = pairs.join(sets.select(F.col("set_hash").alias("a"), F.col("shingles").alias("sa")), "a")
    both = first.join(sets.select(F.col("set_hash").alias("b"), F.col("shingles").alias("sb")), "b")
    # 100 * common >= 75 * (sizes - common), with the intersection written once
    return both.where((NEAR[0] + NEAR[1]) * F.size(F.array_intersect("sa", "sb")) >= NEAR[0] * (F.size("sa") + F.size("sb"))).select("a", "b")


def near_classes(docs: DataFrame, base: DataFrame, size: int = 5) -> DataFrame:
    """(node, root) of set hashes: the classes of equal sets that are linked, and one class for each component."""
    classes = materialize(
        base.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")), "classes"
    )
    rows = classes.select("set_hash", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = materialize(rows.join(buckets, "key", "left_semi"), "members")
    ends = members.select("set_hash").distinct().join(classes.select("set_hash", "doc_id"), "set_hash")
    sets = materialize(_sets(docs, ends, size), "sets")
    signed = classes.select("set_hash", "n", "sig")
    side = lambda name: signed.select(F.col("set_hash").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    fits = NEAR[1] * F.least("n_a", "n_b") >= NEAR[0] * F.greatest("n_a", "n_b")
    alike = fits & (estimate(F.col("sig_a"), F.col("sig_b")) >= ESTIMATE)

    def confirmed(met: DataFrame) -> DataFrame:
        """Links among the pairs (x, y) of classes."""
        pairs = met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        return materialize(_confirm(pairs.join(side("b"), "b").join(side("a"), "a").where(alike).select("a", "b"), sets), "links")

    leads = members.groupBy("key").agg(F.min("set_hash").alias("lead"))
    roots = components(confirmed(members.join(leads, "key").select(F.col("set_hash").alias("x"), F.col("lead").alias("y"))))

    # In each mixed bucket the largest group is its core; the others meet some of its members, and other ones
    # in the next round, for as long as there are too many pairs and that joins many of them.
    mixed, before = _mixed(members, roots), None
    for again in range(CORE_ROUNDS + 1):
        tally, rows, pairs, n_large = _tally(mixed)
        if pairs <= PAIRS_A_MEMBER * rows or again == CORE_ROUNDS or (before is not None and pairs > 0.7 * before):
            break
        before = pairs
        core = tally.select("key", "core.label")
        some = Window.partitionBy("key").orderBy(F.xxhash64("set_hash", F.lit(again)))
        leads = mixed.join(core, ["key", "label"]).withColumn("k", F.row_number().over(some)).where(F.col("k") <= CORE_LEADERS).groupBy("key").agg(F.collect_list("set_hash").alias("leads"))
        others = mixed.join(core, ["key", "label"], "left_anti").select("key", "set_hash")
        own = others.join(leads, "key").groupBy("set_hash").agg(F.array_distinct(F.flatten(F.collect_set("leads"))).alias("leads"))
        roots = _merged(roots, confirmed(own.select(F.col("set_hash").alias("x"), F.explode("leads").alias("y"))))
        mixed = _mixed(members, roots)

    # What is still apart meets all of its buckets; the best pairs of each component are confirmed first.
    partners = PARTNERS
    while pairs:
        large = tally.where(F.col("n") > BLOCK).select("key", "n")
        found = materialize(_apart(mixed, F.broadcast(large) if n_large <= BROADCAST_BUCKETS else large, classes, sets, partners), "more")
        roots = _merged(roots, _confirm(found.select("a", "b"), sets))
        if found.where("more").isEmpty():
            break
        mixed, partners = _mixed(members, roots), partners * MORE
        tally, rows, pairs, n_large = _tally(mixed)
    return roots


def _tally(mixed: DataFrame) -> tuple[DataFrame, int, float, int]:
    """(key, core struct of n and label, n, squares) of mixed buckets; all members, pairs of different labels, buckets of more than one block."""
    square = F.col("n").cast("double") * F.col("n")
    labels = mixed.groupBy("key", "label").agg(F.count("*").alias("n"))
    tally = materialize(labels.groupBy("key").agg(F.max(F.struct("n", "label")).alias("core"), F.sum("n").alias("n"), F.sum(square).alias("squares")), "tally")
    return tally, *tally.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((square - F.col("squares")) / 2), F.lit(0.0)), F.count_if(F.col("n") > BLOCK)).first()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after some more links: only the links' own roots are joined up, not all links again."""
    links = materialize(links, "more-links")
    ends = links.select(F.col("a").alias("node"), F.col("a").alias("root")).union(links.select("b", "b"))
    known = materialize(roots.union(ends).groupBy("node").agg(F.min("root").alias("root")), "roots")
    rooted = links.join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    up = components(rooted.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(known.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, set_hash, label) of the members in buckets that hold more than one component so far."""
    roots = roots.select(F.col("node").alias("set_hash"), F.col("root").alias("label"))
    labelled = materialize(members.join(roots, "set_hash", "left").withColumn("label", F.coalesce("label", "set_hash")), "labelled")
    torn = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return materialize(labelled.join(torn, "key", "left_semi"), "mixed")


def _labelled(docs: DataFrame, size: int) -> DataFrame:
    """``near_duplicates`` with each row's ``row_key`` besides."""
    bound_batches(docs.sparkSession)
    before = shared()
    base = materialize(signatures(docs, size), "signatures")
    roots = near_classes(docs, base, size).select(F.col("node").alias("set_hash"), "root")
    classes = base.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    known = classes.join(roots, "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
    known = materialize(known.where((F.col("copies") > 1) | F.col("root").isNotNull()).select("set_hash", "root", "least"), "class-roots")
    destroy_shared([one for one in shared() if one not in before])
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = known.join(least, "root").select("set_hash", "component_id")
    out = base.select("doc_id", "row", "n_shingles", "set_hash").join(by_class, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id), for every row."""
    return _labelled(docs, size).drop("row")


def deduplicate(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` without the rows that are near copies of one with a smaller doc_id.

    Rows are told apart by doc_id and text: a text of its own stays though its doc_id has near copies too. Documents
    without words and rows without a doc_id stay; of rows that repeat doc_id and text, one stays.
    """
    found = _labelled(docs, size)
    out = without(docs, found.where(~F.col("kept") & F.col("doc_id").isNotNull()))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])
