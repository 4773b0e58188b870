"""Trie of conversation prefixes by vertical bitmaps.

Texts leave the first stage as 128-bit digests of (role, text) with their size in bytes. Whole conversations are dealt to
shards; a shard numbers its conversations and indexes them vertically: (position, turn) -> bitset of the
conversations that have that turn there, and length -> bitset of those that end there. A depth-first walk intersects
the bitset of a node with the postings of the next position: the lowest member left names the posting to meet, the
intersection is a child, and its members are struck off, so a node costs one intersection for each child. Popcounts
are the members, node & ends the list of conversations that end at the node.

A prefix has the same key (digest of its parent's key and its last turn) in all shards, so nodes of shards
are summed by key, with a combine before the shuffle: a prefix that a third of all conversations share is one row of each
shard. Sums over subtrees take rounds of doubling: after round i a node holds the sums of its descendants less than 2^i
below, and hands them to its ancestor 2^i above; rounds grow with the logarithm of the depth. Lists of ends are joined to
text in blocks of `block` numbers, and the blocks go through the digest in order.

Defined results: rows without conv_id are left out; null role or text is empty; turns are ordered by turn, nulls first,
then by the digest of role and text, so rows that repeat are turns of their own; a conversation without turns after `rebuild` ends at the
root; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ROOT = bytes(16)
NODE = "key binary, parent binary, depth int, bytes long, conv_id long, n_convs long, ends array<long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def slim_turns(table: DataFrame, span: int = 1024) -> DataFrame:
    """(conv_id, pos from 0, turn: digest of role and text, bytes of the text).

    Positions are counted by blocks of `span` turn numbers first, so a very long conversation is not numbered in one task.
    """
    rows = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    told = rows.select("conv_id", "at", F.floor(F.col("at") / span).alias("part"), digest.alias("turn"), F.octet_length("text").cast("long").alias("bytes"))
    parts = told.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("at").asc_nulls_first(), "turn")) - 1
    numbered = told.withColumn("inner", inner)
    return numbered.join(parts, (F.col("conv_id") == F.col("c")) & F.col("part").eqNullSafe(F.col("p"))).select("conv_id", (F.col("before") + F.col("inner")).cast("int").alias("pos"), "turn", "bytes")


def rebuild(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """turns -> (conv_id, pos, turn, bytes): the first h turns of the group's first conversation, then the own turns behind h.

    Every conversation also has a row with pos -1. A base hands out at most `most` - 1 turns to at most 2 * `group` - 1 others.
    """
    convs = turns.select("conv_id").distinct()
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.where(F.col("pos") >= head)
    begin = convs.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head.alias("h"))
    lent = begin.join(turns.where(F.col("pos") < most - 1), (F.col("base") == F.col("conv_id")) & (F.col("pos") < F.col("h"))).select(F.col("c").alias("conv_id"), "pos", "turn", "bytes")
    marks = convs.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("bytes"))
    # a base may be shorter than h: own turns then follow without a gap
    rows = own.select("conv_id", "pos", "turn", "bytes").union(lent).union(marks)
    return rows


def child_key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.md5(parent + turn).digest()


def shard_trie(convs: list[tuple[int, list[tuple[bytes, int]]]]) -> Iterator[tuple]:
    """convs: (conv_id, turns as (digest, bytes)), ids ascending -> rows of NODE by a depth-first walk over bitsets."""
    postings: dict[tuple[int, bytes], int] = {}
    ends: dict[int, int] = {}
    for n, (_, turns) in enumerate(convs):
        bit = 1 << n
        for at, (turn, _) in enumerate(turns):
            postings[at, turn] = postings.get((at, turn), 0) | bit
        ends[len(turns)] = ends.get(len(turns), 0) | bit

    def members(bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    stack = [(ROOT, None, 0, 0, (1 << len(convs)) - 1)]
    while stack:
        key, parent, depth, size, bits = stack.pop()
        over = bits & ends.get(depth, 0)
        yield key, parent, depth, size, convs[(bits & -bits).bit_length() - 1][0], bits.bit_count(), [convs[i][0] for i in members(over)]
        left = bits & ~over
        while left:
            turn, own = convs[(left & -left).bit_length() - 1][1][depth]
            child = left & postings[depth, turn]
            left &= ~child
            stack.append((child_key(key, turn), key, depth + 1, own, child))


def _walk(table: pa.Table) -> pa.Table:
    """All rows of one shard: conv_id, pos, turn, bytes."""
    convs: dict[int, list] = {}
    for conv, pos, turn, size in zip(*(table.column(c).to_pylist() for c in ("conv_id", "pos", "turn", "bytes"))):
        own = convs.setdefault(conv, [])
        if pos >= 0:
            own.append((pos, turn, size))
    rows = list(shard_trie([(conv, [(t, n) for _, t, n in sorted(convs[conv])]) for conv in sorted(convs)]))
    names = ("key", "parent", "depth", "bytes", "conv_id", "n_convs", "ends")
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, ids), sorted by key and part -> (key, digest of the parts joined by commas)."""
    key, state, keys, found = None, None, [], []
    for batch in batches:
        for now, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if now != key:
                if key is not None:
                    keys.append(key), found.append(state.hexdigest())
                key, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found)], ["key", "ends_sha256"])
            keys, found = [], []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def end_digests(ends: DataFrame, block: int = 1024) -> DataFrame:
    """ends(key, conv_id), each pair once -> (key, ends_sha256); a block holds at most `block` ids."""
    part = F.floor(F.col("conv_id") / block)
    blocks = ends.groupBy("key", part.alias("part")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    return blocks.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_digests, "key binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame, shard_rows: int = 20_000, block: int = 1024, apart: int = 5) -> DataFrame:
    """(conv_id, pos, turn, bytes) -> one row per prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rebuilt = cut(rebuilt)
    shards = max(16, rebuilt.count() // shard_rows)
    # conversations that borrow from one base stay together; groups are small
    shard = F.pmod(F.xxhash64(F.col("conv_id") - F.pmod("conv_id", F.lit(apart))), F.lit(shards))
    local = cut(rebuilt.withColumn("shard", shard).groupBy("shard").applyInArrow(_walk, NODE))
    nodes = local.groupBy("key").agg(F.first("parent").alias("parent"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    below = local.where("depth > 0").select("parent", "key").distinct().groupBy("parent").agg(F.count("*").alias("n")).select(F.col("parent").alias("key"), "n")
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.coalesce("n", F.lit(0))).drop("n")
    nodes = cut(nodes)
    deepest = nodes.agg(F.max("depth").alias("d")).first().d or 0
    top = nodes.where("depth = 0").select("conv_id").first()
    sums = cut(nodes.select("key", F.col("parent").alias("up"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    step = 1
    while step <= deepest:
        up = sums.where(F.col("depth") >= step).select(F.col("up").alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(-1).alias("depth"), "leaves", "saved")
        grown = sums.union(up).groupBy("key").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # who is two steps up; the root is known
        ups = sums.where((F.col("depth") > step) & (F.col("depth") != 2 * step)).select("key", "up").join(sums.select(F.col("key").alias("up"), F.col("up").alias("next")), "up").select("key", "next")
        grown = grown.join(ups, "key", "left")
        sums = cut(grown.select("key", F.when(F.col("depth") == 2 * step, F.lit(ROOT)).otherwise(F.col("next")).alias("up"), "depth", "leaves", "saved"))
        step *= 2
    ends = end_digests(local.select("key", F.explode("ends").alias("conv_id")), block)
    # nodes below the root know its number, so the join has no row for them
    parents = nodes.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv"))
    full = nodes.join(sums.select("key", "leaves", "saved"), "key").join(ends, "key", "left")
    first = full.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top.conv_id if top else None).cast("long")))
    rest = full.where("depth > 1").join(parents, "parent").withColumn("parent_conv_id", F.col("parent_conv"))
    wanted = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
              F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    return first.select(*wanted).union(rest.select(*wanted))
