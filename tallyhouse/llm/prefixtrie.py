"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns (role, text). Distinct sequences are ranked in lexicographic order of
the MD5 of their turns; a node's subtree is then the interval of all nodes from itself to the last node of the last
sequence that starts with it, in the order (first sequence, depth). Leaves and savings of subtrees are differences of
prefix sums over that order.

1. Places within conversations, and the hash of every prefix, are differences of running totals over globally sorted
   rows (``running``): range partitions are summed one by one, their totals are added up by the driver (a row each).
   A prefix's hash is the XOR of hashes of its turns with their places, twice 64 bits.
2. Equal sequences are one row from there on. They are ranked in blocks of ``BLOCK`` turns, then in blocks of ``BLOCK``
   ranks, and so on; distinct blocks are sorted by range. No conversation is gathered as a whole.
3. Nodes are groups of equal prefix hashes: first and last rank, members and smallest member.
4. Preorder is one more global sort; subtree ends are looked up by the last rank.
5. The ids of the conversations that end at a node are joined up in sorted pieces and hashed as a stream; SHA-256 reads its
   input in order, so one task reads the pieces of a node, one at a time.

Defined results: rows without a conv_id are left out; a null turn comes first; turns of a conversation that share
their number stand in the order of the MD5 of role and text; repeated rows are turns of their own; null role or text
is empty; an empty table has no nodes; conversations without turns belong to the root; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, materialize

#: Turns, or ranks of blocks, that are gathered into one block.
BLOCK = 16
#: Most first turns that a rebuilt conversation takes from another, and the distance of conversations that are taken from.
MOST_SHARED, APART = 8, 5
#: Conversation ids in one piece of text.
PIECE = 4096


def running(df: DataFrame, order: list[Column], label: str, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``at`` (place in the global order, from 0) and ``run_<c>``: sum or XOR of long column ``c`` up to and with the row.

    Every range partition is one stream with a carry; one row for each partition reaches the driver.
    """
    spark = df.sparkSession
    columns, totals = df.columns, [*sums, *xors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        carry = dict.fromkeys(totals, np.int64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for c in totals:
                own = np.asarray(batch.column(columns.index(c)))
                out.append(np.cumsum(own) + carry[c] if c in sums else np.bitwise_xor.accumulate(own) ^ carry[c])
                carry[c] = out[-1][-1]
            at = place + np.arange(batch.num_rows)
            place += batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at), *map(pa.array, out)], [*columns, "__part", "at", *(f"run_{c}" for c in totals)])

    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("at", *(f"run_{c}" for c in totals))]])
    stored = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), label)
    parts = stored.groupBy("__part").agg(F.count("*").alias("n"), *[(F.sum if c in sums else F.bit_xor)(c).alias(c) for c in totals]).orderBy("__part").collect()
    before, rows = [0] * (1 + len(totals)), []
    for one in parts:
        rows.append((one["__part"], *before))
        before = [before[0] + one["n"], *(b + one[c] if c in sums else b ^ one[c] for b, c in zip(before[1:], totals, strict=True))]
    offsets = spark.createDataFrame(rows, ", ".join(["__part int", "__n long", *(f"__{c} long" for c in totals)]))
    plus = {"at": F.col("at") + F.col("__n")} | {f"run_{c}": F.col(f"run_{c}") + F.col(f"__{c}") if c in sums else F.col(f"run_{c}").bitwiseXOR(F.col(f"__{c}")) for c in totals}
    return stored.join(F.broadcast(offsets), "__part").withColumns(plus).select(*columns, *plus)


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, label, bytes) of every turn, pos from 1, and (conv_id, n) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("label"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("salt"),
    )
    placed = running(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("label"), F.col("salt")], "turns").drop("salt", "turn")
    convs = materialize(placed.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("n")), "conversations")
    turns = placed.join(convs.select("conv_id", "start"), "conv_id").select("conv_id", (F.col("at") - F.col("start") + 1).alias("pos"), "label", "bytes")
    return materialize(turns, "placed-turns"), convs.select("conv_id", "n")


def share_first_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns of rebuilt conversations: c takes its first h turns from conversation c - c % 5, h = crc32(c) % 9, and goes on with its own after h."""
    shared = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1), "base": F.col("conv_id") - F.col("conv_id") % APART})
    lengths = convs.where(F.col("conv_id") % APART == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shared = materialize(shared.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv_id", "base", "h", "taken"), "shared")
    own = turns.join(shared, "conv_id").where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "label", "bytes")
    first = turns.where((F.col("conv_id") % APART == 0) & (F.col("pos") <= MOST_SHARED)).select(F.col("conv_id").alias("base"), "pos", "label", "bytes")
    return own.union(first.join(shared.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "label", "bytes"))


def rank_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, rank) for the sequences of (conv_id, pos, label): ranks are in lexicographic order, equal for equal sequences."""
    level = turns.select("conv_id", (F.col("pos") - 1).alias("k"), F.col("label").alias("item"))
    while True:
        block = F.floor(F.col("k") / BLOCK).cast("long")
        blocks = level.groupBy("conv_id", block.alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("o"), "item"))).alias("some"))
        blocks = materialize(blocks.select("conv_id", "k", F.col("some.item").alias("some")), "blocks")
        distinct = blocks.select("some").distinct()
        ranks = materialize(distinct.repartitionByRange("some").sortWithinPartitions("some").withColumn("item", F.monotonically_increasing_id()), "ranks")
        level = materialize(blocks.join(ranks, "some").select("conv_id", "k", "item"), "ranked")
        if level.where("k > 0").isEmpty():
            return level.select("conv_id", F.col("item").alias("rank"))


def _ends(convs: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256): the hash of the ascending ids that share a last prefix, comma-joined."""
    key, order = ("p1", "p2", "depth"), ("p1", "p2", "depth", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, d, ids = (np.asarray(batch.column(k)) for k in range(4))
            if not len(ids):
                continue
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1])])
            new[::PIECE] = True
            at = np.flatnonzero(new)
            text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(at, [*at[1:], len(ids)], strict=True)]
            yield pa.record_batch([pa.array(a[at]), pa.array(b[at]), pa.array(d[at]), pa.array(ids[at]), pa.array(text, pa.string())], [*order, "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for a, b, d, piece in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if (a, b, d) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (a, b, d), hashlib.sha256(piece.encode())
                else:
                    digest.update(f",{piece}".encode())
            yield _rows(done)
        if now is not None:
            yield _rows([(*now, digest.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        a, b, d, h = zip(*done, strict=True) if done else ((), (), (), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.string())], [*key, "ends_sha256"])

    sorted_ids = convs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialize(sorted_ids.mapInArrow(pieces, "p1 long, p2 long, depth long, conv_id long, piece string"), "id-pieces")
    return cut.repartition(*key).sortWithinPartitions(*order).mapInArrow(hashed, "p1 long, p2 long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, pos, label, bytes), for all conversations (conv_id), with or without turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    node's interval in preorder: ``start`` and ``end`` (with itself and its last descendant, from 0).
    """
    bound_batches(turns.sparkSession)
    hashed = turns.select("conv_id", "pos", "label", "bytes", F.xxhash64("label", "pos").alias("x1"), F.xxhash64(F.lit("again"), "pos", "label").alias("x2"))
    rows = running(hashed, [F.col("conv_id"), F.col("pos")], "prefixes", xors=("x1", "x2")).drop("at")
    rows = materialize(rows, "rebuilt")
    before = [F.max(F.when(F.col("pos") == 1, F.col(f"run_{x}").bitwiseXOR(F.col(x)))).alias(f"{x}_before") for x in ("x1", "x2")]
    last = F.max(F.struct("pos", "run_x1", "run_x2")).alias("last")
    full = rows.groupBy("conv_id").agg(*before, last)
    full = full.select("conv_id", "x1_before", "x2_before", F.col("last.run_x1").bitwiseXOR(F.col("x1_before")).alias("p1"), F.col("last.run_x2").bitwiseXOR(F.col("x2_before")).alias("p2"), F.col("last.pos").alias("depth"))
    zero = F.lit(0).cast("long")
    whole = convs.select("conv_id").join(full, "conv_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("p1", "p2", "depth")})
    whole = materialize(whole, "whole")

    distinct = whole.groupBy("p1", "p2", "depth").agg(F.min("conv_id").alias("lead"), F.count("*").alias("copies"))
    leads = materialize(distinct.where("depth > 0").select(F.col("lead").alias("conv_id"), "copies").join(whole.select("conv_id", "x1_before", "x2_before"), "conv_id"), "leads")
    led = rows.join(leads, "conv_id")
    ranks = rank_sequences(led.select("conv_id", "pos", "label"))
    prefix = lambda x: F.col(f"run_{x}").bitwiseXOR(F.col(f"{x}_before"))
    members = led.join(ranks, "conv_id").select("conv_id", "copies", "rank", F.col("pos").alias("depth"), prefix("x1").alias("p1"), prefix("x2").alias("p2"), "x1", "x2", "bytes")
    nodes = members.groupBy("p1", "p2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.any_value("x1").alias("x1"), F.any_value("x2").alias("x2"), F.any_value("bytes").alias("bytes")
    )
    nodes = nodes.select("p1", "p2", "depth", "conv_id", "n_convs", "first", "last", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "bytes")
    least, n = whole.agg(F.min("conv_id"), F.count("*")).first()
    highest = ranks.agg(F.max("rank")).first()[0]
    root = [(0, 0, 0, least, n, -1, -1 if highest is None else highest, 0, 0, 0)] if n else []
    root = turns.sparkSession.createDataFrame(root, ", ".join(f"{c} long" for c in nodes.columns))
    nodes = materialize(nodes.union(root), "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, ["p1", "p2", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    counted = counted.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("bytes")})
    order = materialize(running(counted, [F.col("first"), F.col("depth")], "preorder", sums=("leaf", "saving")), "numbered")
    ends = order.groupBy(F.col("first").alias("last")).agg(F.max(F.struct("at", "run_leaf", "run_saving")).alias("end"))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = order.join(ends, "last").join(parents, ["q1", "q2", "depth"], "left").join(_ends(whole), ["p1", "p2", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end.run_leaf") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("end.run_saving") - F.col("run_saving") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.col("at").alias("start"), F.col("end.at").alias("end"),
    )


def conversation_trie(conversations: DataFrame, share: bool = False) -> DataFrame:
    """``prefix_trie`` of a table (conv_id, turn, role, text); with ``share``, of conversations that take over first turns (``share_first_turns``)."""
    bound_batches(conversations.sparkSession)
    turns, convs = placed_turns(conversations)
    return prefix_trie(share_first_turns(turns, convs) if share else turns, convs)
