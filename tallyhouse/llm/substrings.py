"""Exact removal of repeated passages: suffix automata of reference shards and matching statistics.

A window is ``window`` consecutive words of one document; every word of a window whose word sequence
also starts anywhere else goes. Comparing each document with an automaton of the whole corpus would
cost (shards x corpus), so documents and reference are first cut by content:

1. Each window has an anchor: the least hash among its 12-word parts. Equal windows have equal anchors.
   Consecutive windows of one anchor form a piece of at most 58 words.
2. Anchors of one piece in the whole corpus cannot lie in a repeated window. A bitmap of fixed size
   drops nearly all of them, the exact counts the rest.
3. Equal pieces of an anchor are counted together, so copies cost one row each. A piece seen twice is
   repeated throughout.
4. The distinct pieces of an anchor are its reference shard, sent to the task that needs it. A suffix
   automaton of the shard is built, and pieces seen once are streamed through it: where the longest
   match with something other than the piece itself reaches the window's length, the words are marked.
   An anchor with more than ``SHARD_PIECES`` distinct pieces (a passage inside thousands of documents)
   is never gathered; its windows are counted by hash instead, which is the same test.
5. The marked spans meet their documents again, and the words outside of them are kept.

Defined results: a null or wordless text has 0 words; texts shorter than a window lose nothing; repeated
rows repeat each other; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import bound_batches, in_bitmap, key_bitmap, materialize, share_value

WINDOW, PART = 35, 12
SHARD_PIECES = 64


class SuffixAutomaton:
    """Suffix automaton of several weighted sequences; knows how often each state's strings occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.last, self.fence = 0, 0

    def add(self, sequence: list, weight: int = 1) -> list[int]:
        """Append a sequence behind a separator; returns the state of each of its prefixes."""
        self.fence -= 1
        self._extend(("fence", self.fence), 0)
        return [self._extend(symbol, weight) for symbol in sequence]

    def _extend(self, symbol, weight: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        self.count.append(weight)
        p = self.last
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.count.append(0)
                link[q] = link[new] = twin
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = twin
                    p = link[p]
        self.last = new
        return new

    def close(self) -> None:
        """Sum the occurrences along suffix links. Call it once, after the last sequence."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def statistics(self, sequence: list, least: int) -> list[int]:
        """For each end in ``sequence``, the longest match there that occurs ``least`` times or more."""
        out, state, matched = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            at, size = state, matched
            while at > 0 and self.count[at] < least:
                at = self.link[at]
                size = self.length[at]
            out.append(size if at > 0 else 0)
        return out


def spans_of(statistics: list[int], window: int) -> list[tuple[int, int]]:
    """Merged (from, to) of all matches of at least ``window`` symbols."""
    out: list[tuple[int, int]] = []
    for end, size in enumerate(statistics, 1):
        if size >= window:
            begin = end - size
            while out and out[-1][1] >= begin:
                begin = min(begin, out.pop()[0])
            out.append((begin, end))
    return out


class Pieces:
    """All pieces of some texts as flat arrays: anchor, content hash, windows, text index, first word."""

    def __init__(self, text: pa.Array, window: int):
        flat, self.counts = W.split(text)
        self.code = W.codes(flat)
        hashes, of, self.at = W.windows(self.code, self.counts, window)
        self.window_hash = hashes
        part, _, _ = W.windows(self.code, np.array([len(self.code)]), PART)
        span, size, least = window - PART + 1, 1, part
        while size * 2 <= span:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        anchor = least[self.at]
        n = len(self.at)
        new = np.ones(n, bool)
        if n:
            new[1:] = (anchor[1:] != anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (of[1:] != of[:-1])
            # Periodic text: a window that equals one at most ``span`` before it starts a piece of its own,
            # so that no piece repeats itself; and a run longer than its anchor's reach is cut.
            for period in range(1, min(span + 1, n)):
                new[period:] |= hashes[period:] == hashes[:-period]
            run = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
            new |= run % span == 0
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.first, [n]]))
        self.anchor, self.of = anchor[self.first], of[self.first]
        ends = hashes[self.first + self.size - 1] if n else hashes
        self.hash = W.mix(W.mix(hashes[self.first] + self.size.astype(np.uint64)) + ends) if n else hashes
        base = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.word = self.at[self.first]
        self.start = self.word - base[self.of] if n else self.word


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, from, to): word spans covered by repeated windows; ``row`` is xxhash64(doc_id, text)."""
    bound_batches(docs.sparkSession)
    keyed = _keyed(docs)
    sc = docs.sparkSession.sparkContext

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in W.chunks(batches):
            anchor, n = np.unique(Pieces(text, window).anchor, return_counts=True)
            yield pa.record_batch([_longs(anchor), _longs(n)], ["anchor", "n"])

    seen = keyed.select("text").mapInArrow(anchors, "anchor long, n long")
    shared = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bitmap = share_value(docs.sparkSession, key_bitmap(shared, "anchor", 26))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in W.chunks(batches):
            found = Pieces(text, window)
            ok = in_bitmap(bitmap.value, found.anchor)
            row = np.asarray(part.column(1))[found.of[ok]]
            yield pa.record_batch([_longs(x) for x in (row, found.anchor[ok], found.hash[ok], found.size[ok], found.start[ok])], ["row", "anchor", "piece", "size", "start"])

    all_pieces = materialize(keyed.select("text", "row").mapInArrow(pieces, "row long, anchor long, piece long, size long, start long"), "pieces")
    distinct = materialize(all_pieces.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.any_value("size").alias("size")), "distinct-pieces")
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("single")).where("kinds > 1 and single > 0")
    # Only shards that hold a piece seen once need their words.
    need = materialize(distinct.join(kinds.select("anchor", "kinds"), "anchor"), "needed-pieces")
    wanted = share_value(docs.sparkSession, key_bitmap(need, "piece", 26))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in W.chunks(batches):
            found = Pieces(text, window)
            ok = np.flatnonzero(in_bitmap(wanted.value, found.hash) & in_bitmap(bitmap.value, found.anchor))
            _, once = np.unique(found.hash[ok], return_index=True)
            ok = ok[once]
            sizes = found.size[ok] + window - 1
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(found.word[ok], sizes)
            yield pa.record_batch([_longs(found.hash[ok]), W.list_array(found.code[index], offsets)], ["piece", "codes"])

    words = keyed.select("text").mapInArrow(spelled, "piece long, codes array<long>")
    # Content decides the hash, so any task's spelling will do.
    spelling = need.join(words.groupBy("piece").agg(F.any_value("codes").alias("codes")), "piece")
    spelling = materialize(spelling, "spelled-pieces")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, list]] = []
        anchor = None

        def flush() -> list[tuple[int, int, int, int]]:
            automaton = SuffixAutomaton()
            for _, n, codes in shard:
                automaton.add(codes, n)
            automaton.close()
            return [(anchor, piece, a, b) for piece, n, codes in shard if n == 1 for a, b in spans_of(automaton.statistics(codes, 2), window)]

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["anchor", "piece", "a", "b"])

        for batch in batches:
            rows: list = []
            for key, piece, n, codes in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != anchor:
                    rows += flush() if shard else []
                    shard, anchor = [], key
                shard.append((piece, n, codes))
            yield batch_of(rows)
        yield batch_of(flush() if shard else [])

    schema = "anchor long, piece long, a long, b long"
    small = spelling.where(F.col("kinds") <= SHARD_PIECES).select("anchor", "piece", "n", "codes")
    by_automaton = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(stream, schema)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            code = np.asarray(lists.flatten()).view(np.uint64)
            hashes, of, at = W.windows(code, np.diff(offsets), window)
            anchor, piece, n = (np.asarray(batch.column(k))[of] for k in range(3))
            yield pa.record_batch([_longs(x) for x in (anchor, piece, n, at - (offsets[:-1] - offsets[0])[of], hashes)], ["anchor", "piece", "n", "a", "hash"])

    large = spelling.where(F.col("kinds") > SHARD_PIECES).select("anchor", "piece", "n", "codes")
    large = materialize(large.mapInArrow(opened, "anchor long, piece long, n long, a long, hash long"), "hot-windows")
    hot = large.groupBy("hash").agg(F.sum("n").alias("total")).where("total > 1").select("hash")
    by_window = large.where("n = 1").join(hot, "hash", "left_semi").select("anchor", "piece", "a", (F.col("a") + window).alias("b"))
    whole = distinct.where("n > 1").select("anchor", "piece", F.lit(0).cast("long").alias("a"), (F.col("size") + window - 1).alias("b"))
    spans = materialize(by_automaton.union(by_window).union(whole), "piece-spans")
    return all_pieces.join(spans, ["anchor", "piece"]).select("row", (F.col("start") + F.col("a")).alias("from"), (F.col("start") + F.col("b")).alias("to"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the kept words joined by a space) for every row."""
    spans = repeated_spans(docs, window).groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = _keyed(docs).join(materialize(spans, "spans"), "row", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in W.chunks(batches):
            flat, counts = W.split(text)
            base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            mark = np.zeros(len(flat) + 1, np.int64)
            lists = part.column(2)
            pairs = lists.flatten()
            if len(pairs):
                sizes = np.diff(np.asarray(lists.offsets)) if lists.null_count == 0 else np.array([len(x) if x is not None else 0 for x in lists.to_pylist()])
                begin = np.repeat(base[:-1], sizes)
                np.add.at(mark, begin + np.asarray(pairs.field(0)), 1)
                np.add.at(mark, begin + np.asarray(pairs.field(1)), -1)
            gone = np.cumsum(mark[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            kept_words = flat.filter(pa.array(~gone))
            ends = base - total[base]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), kept_words.cast(pa.string())), " ").to_pylist()
            out = [part.column(0).cast(pa.int64()), _longs(counts), _longs(np.diff(total[base])), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch(out + [pa.array(kept, pa.string())] if keep_text else out, names + ["kept"] if keep_text else names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else ""))
