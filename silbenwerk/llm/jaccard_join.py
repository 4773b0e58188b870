"""N-gram Jaccard join: sets of word shingles, linked where 100·|A∩B| >= 75·|A∪B|, exactly.

The join skips by set relations (Wang et al. 2017) on both levels of that paper. On the level of the
index, lists are cut into blocks by size and position, and pairs of blocks that cannot hold a link are
skipped whole. On the level of answers, highly similar sets form a family around a representative:
only representatives stand in the lists, and a member's answers are derived from the representative's
by the shingles in which the two differ.

1. `_index`: every set in hash order, cut after the positions that any partner must share at least
   `extra` members of. The members go to hash buckets, packed: one row holds all members that one
   batch of documents has in one bucket.
2. `_frequencies`: a bucket counts its members; only members that two batches' sets share go back.
3. `_rare_first`: a set with fewer than `needed` shared members has no partner and is skipped whole.
   The others put their members in the order of frequency and enter the index lists with the first
   ones only. An entry knows its position: how many shared members follow.
   `_thinned`: the sets of the long lists are a crowd. A set with more than a quarter of members that
   no other set of the crowd has cannot link there and leaves the long lists.
4. `_families`: each list names a representative, the set with the least share of such members, of
   several one drawn by hash; so the text that many near copies come from, where it is there, stands for them. A set that
   is linked with the one that most of its lists name joins its family and keeps the difference only. Equal sets are one
   class from the start, so a family holds different texts.
5. `_candidates`: pairs of families within a list. Short lists are joined; long ones are compared in
   pairs of blocks, and what leaves a block are pairs whose bitmaps do not rule out a link.
6. Representatives of those pairs are compared on their whole sets. Two families of one set each are
   decided by that; of others the triangle inequality of the Jaccard distance drops the distant ones.
7. `_member_links`: the members of the larger family against themselves and against all members of
   its partners, in blocks: with D = S Δ R, |S∩T| = |R| - |R-S| - |R-T| + |D_S ∩ D_T|, so that only
   differences are compared. A block sends back a number for each set, never the pairs. Members so
   near their representative that any two of them are linked are counted without comparing.

Links within a family connect it, so components are formed over families. Comparing the members of a
family takes time that is quadratic in the number of its different texts outside that core.

Every link is decided on whole sets of 64-bit shingle hashes. Positions, bitmaps and frequencies use
short hashes: a collision there costs time, never a link.

Defined results: null, empty and white texts have no shingles and link with nothing; fewer than
five words count as one shingle; rows with equal sets share a component; rows that repeat a doc_id
are answered each, whatever their texts and their order; null doc_ids are kept, and a component of
such rows only has a null id; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, components, cut, lean_batches, lean_group, no_rows
from .shingles import byte_chunks, shingle_sets, signatures

PERCENT = 75
FAR = (100 - PERCENT) / 100  # distance of two sets that are just linked
EXTRA = 0.15  # share of a set that the prefix holds beyond the shortest one
NARROW = 1_000_000  # prefix members in one packed batch
LONG = 32  # families in a list that is compared in blocks
LIST_BLOCK = 512  # families of one block of a list
BLOCK_SETS, BLOCK_MEMBERS = 1_500, 400_000  # about so much of a family is compared at once
CHUNK = 200_000  # bytes of text that become shingles at once
PAIRS, COLUMNS, STRIP = 1 << 18, 1_024, 128  # of a block: pairs of members, columns and rows that are in memory at once
INDEX = "kind int, doc_id long, text_hash long, s1 long, s2 long, n long, batch string, ix int, bucket int, data binary"


def least_overlap(n: np.ndarray) -> np.ndarray:
    return (PERCENT * n + 99) // 100


def extra(n: np.ndarray) -> np.ndarray:
    """Members of both prefixes that two linked sets share at least; n: the size of the larger one."""
    return np.maximum(1, (n * EXTRA).astype(np.int64))


def needed(n: np.ndarray) -> np.ndarray:
    """The same for a set of size n and any partner."""
    return np.minimum(extra(n), extra(least_overlap(n)))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _index(docs: DataFrame, buckets: int, shingle: int) -> DataFrame:
    shift = np.uint64(64 - int(buckets).bit_length() + 1)

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        ids, th, s1, s2, sizes = ([x for part in held for x in part[i]] for i in range(5))
        batch, n = uuid.uuid4().hex[:16], len(ids)
        yield _rows(0, n, doc_id=ids, text_hash=th, s1=s1, s2=s2, n=sizes, batch=[batch] * n, ix=range(n))
        size = np.array(sizes, np.int64)
        # of equal sets in the batch, the one with the least doc_id goes to the buckets
        none = np.array([x is None for x in ids])
        key = np.array([x or 0 for x in ids], np.int64)
        a, b = np.array(s1, np.int64), np.array(s2, np.int64)
        order = np.lexsort((np.arange(n), key, none, b, a))
        first = np.ones(n, bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        lead = np.zeros(n, bool)
        lead[order[first]] = True
        ix, hashes = np.concatenate([p[5] for p in held]), np.concatenate([p[6] for p in held])
        ix, hashes = ix[lead[ix]], hashes[lead[ix]]
        place = (hashes >> shift).astype(np.int64)
        order = np.argsort(place, kind="stable")
        ix, hashes, place = ix[order].astype("<u2"), (hashes[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), place[order]
        found, start = np.unique(place, return_index=True)
        ends = np.append(start[1:], len(place))
        data = [hashes[a:b].tobytes() + ix[a:b].tobytes() for a, b in zip(start, ends)]
        yield _rows(1, len(found), batch=[batch] * len(found), bucket=found.tolist(), data=data)
        yield _rows(2, 1, batch=[batch], bucket=[-1], data=[size.astype("<i8").tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, members = [], 0, 0
        for batch in batches:
            keys, th = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, texts in byte_chunks(batch, most=CHUNK):
                n, h = shingle_sets(texts, shingle)
                a, b = signatures(n, h)
                size = n - least_overlap(n) + extra(n)
                owner = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < size[owner]
                if held and (rows + len(n) > 60_000 or members + inside.sum() > NARROW):
                    yield from pack(held)
                    held, rows, members = [], 0, 0
                own = slice(first, first + len(n))
                held.append((keys[own], th[own], a.tolist(), b.tolist(), n.tolist(), owner[inside] + rows, h[inside]))
                rows, members = rows + len(n), members + int(inside.sum())
        if held:
            yield from pack(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_hash().alias("text_hash")).mapInArrow(lean_batches(run), INDEX)


def _rows(kind: int, rows: int, **given) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "doc_id": pa.int64(), "text_hash": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "n": pa.int64(), "batch": pa.string(), "ix": pa.int32(), "bucket": pa.int32(), "data": pa.binary()}
    given["kind"] = [kind] * rows
    return pa.RecordBatch.from_arrays([pa.array(list(given[c]), t) if c in given else pa.nulls(rows, t) for c, t in kinds.items()], list(kinds))


def _unpack(data: bytes, width: int, kinds: list[str]) -> list[np.ndarray]:
    n, out, at = len(data) // width, [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _frequencies(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: for each batch, the members that occur twice or more in the bucket, with their numbers."""
    bucket = int(group["bucket"].iloc[0])
    parts = [_unpack(d, 6, ["<u4", "<u2"]) for d in group["data"]]
    hashes = np.concatenate([p[0] for p in parts])
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    count = np.minimum(count, 65535).astype("<u2")[inverse]
    out, at = [], 0
    for batch, (h, ix) in zip(group["batch"], parts):
        own = count[at:at + len(h)]
        at += len(h)
        keep = own >= 2
        if keep.any():
            out.append((batch, bucket, h[keep].tobytes() + ix[keep].tobytes() + own[keep].tobytes()))
    return pd.DataFrame(out, columns=["batch", "bucket", "data"]) if out else no_rows("batch", "bucket", "data")


def _rare_first(group: pd.DataFrame) -> pd.DataFrame:
    """One batch: the index members of its sets, and how many shared members each has from there on."""
    size = np.zeros(0, np.int64)
    ix, key, count = [], [], []
    for bucket, data in zip(group["bucket"], group["data"]):
        if bucket < 0:
            size = np.frombuffer(data, "<i8")
        else:
            h, i, c = _unpack(data, 8, ["<u4", "<u2", "<u2"])
            ix.append(i.astype(np.int64))
            key.append(h.astype(np.int64) | (np.int64(bucket) << 32))
            count.append(c.astype(np.int64))
    if not ix or not len(size):
        return no_rows("batch", "ix", "shared", "keys")
    ix, key, count = np.concatenate(ix), np.concatenate(key), np.concatenate(count)
    order = np.lexsort((key, count, ix))
    ix, key = ix[order], key[order]
    shared = np.bincount(ix, minlength=len(size))
    room = shared - needed(size) + 1
    rank = np.arange(len(ix)) - (np.cumsum(shared) - shared)[ix]
    keep = rank < room[ix]
    ix, key = ix[keep], key[keep]
    if not len(ix):
        return no_rows("batch", "ix", "shared", "keys")
    found, start = np.unique(ix, return_index=True)
    return pd.DataFrame({"batch": [group["batch"].iloc[0]] * len(found), "ix": found.astype(np.int32), "shared": shared[found].astype(np.int64), "keys": np.split(key, start[1:])})


def _set_table(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, n, members (sorted 64-bit hashes), mark of the classes in nodes(node, doc_id, text_hash, s1, s2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, s1, s2 = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for first, texts in byte_chunks(batch, most=CHUNK):
                n, h = shingle_sets(texts, shingle)
                a, b = signatures(n, h)
                parts, marks = np.split(h, np.cumsum(n)[:-1]), _marks(n, h)
                # two texts may share a short hash; only the class's own one counts
                good = [i for i in range(len(n)) if a[i] == s1[first + i] and b[i] == s2[first + i]]
                yield pa.RecordBatch.from_arrays([pa.array([node[first + i] for i in good], pa.int64()), pa.array([int(n[i]) for i in good], pa.int64()), pa.array([parts[i].astype("<u8").tobytes() for i in good], pa.binary()), pa.array([marks[i] for i in good], pa.binary())], ["node", "n", "members", "mark"])

    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_hash().alias("own_hash"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(nodes, (texts.own_hash == nodes.text_hash) & texts.own_id.eqNullSafe(nodes.doc_id)).select("node", "text", "s1", "s2")
    return rows.mapInArrow(lean_batches(run), "node long, n long, members binary, mark binary").dropDuplicates(["node"])


def _marks(n: np.ndarray, h: np.ndarray) -> list[bytes]:
    """A bitmap of each set: bit i tells whether an odd number of members has the residue i. Halves fold by XOR."""
    out = []
    for part in np.split(h, np.cumsum(n)[:-1]):
        bits = max(64, 1 << int(2 * len(part) - 1).bit_length()) if len(part) else 64
        odd = np.bincount((part & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def _folded(mark: np.ndarray, words: int) -> np.ndarray:
    while len(mark) > words:
        mark = mark[:len(mark) // 2] ^ mark[len(mark) // 2:]
    return mark


def _positions(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which members of x are in seen; both ascend."""
    if not len(seen):
        return np.zeros(len(x), bool)
    return seen[np.minimum(np.searchsorted(seen, x), len(seen) - 1)] == x


def _compared(pairs: DataFrame, sets: DataFrame, differences: bool) -> DataFrame:
    """pairs(a, b, ...) -> a, b, common, total: sizes of intersection and union.

    With differences, linked pairs only, and delta: the members that one of the two has, ascending;
    dropped: how many of those b has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, seen = [], None, None
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), y.as_py()
                if y != last:
                    last, seen = y, np.frombuffer(y, "<u8")
                both = _positions(x, seen)
                c = int(both.sum())
                total = len(x) + len(seen) - c
                if not differences:
                    rows.append((a, b, c, total))
                elif 100 * c >= PERCENT * total:
                    delta = np.sort(np.concatenate([x[~both], seen[~_positions(seen, x)]]))
                    rows.append((a, b, c, total, delta.tobytes(), len(seen) - c))
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
            names = ["a", "b", "common", "total", "delta", "dropped"][:6 if differences else 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[:len(names)])], names)

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    schema = "a long, b long, common long, total long" + (", delta binary, dropped long" if differences else "")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean_batches(run), schema)


def _may_link(n: str, m: str):
    return (100 * F.least(F.col(n), F.col(m)) >= PERCENT * F.greatest(F.col(n), F.col(m)))


def _thinned(entries: DataFrame, sets: DataFrame, turns: int = 3) -> DataFrame:
    """The entries without those in long lists of sets that cannot link with any other set of a long list.

    Sets that meet in a long list are all in the crowd of such sets, so members that no other set of the
    crowd has are in no intersection there. A set with too many of them leaves the long lists, and those
    that it leaves behind may then have too many as well. odd: percent of such members, 0 outside the crowd.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(m.as_py(), "<i8") for m in batch.column(1)]
            for lo in range(0, len(parts), 256):
                own = parts[lo:lo + 256]
                node = np.repeat(batch.column(0).to_numpy()[lo:lo + 256], [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(own))], ["node", "member"])

    size = lambda df: df.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > LONG).select("key")
    long = cut(entries.join(size(entries), "key", "left_semi"))
    found = long
    for _ in range(turns):
        crowd = cut(found.select("node", "n").distinct())
        rows = sets.join(crowd, "node", "left_semi").select("node", "members").mapInArrow(lean_batches(run), "node long, member long")
        # counts only: members that a whole crowd has are combined before they are dealt
        alone = rows.groupBy("member").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
        odd = cut(crowd.join(alone, "node").select("node", F.floor(100 * F.col("alone") / F.col("n")).alias("odd")))
        gone = odd.where(F.col("odd") > 100 - PERCENT)
        if gone.isEmpty():
            break
        found = cut(found.join(gone, "node", "left_anti"))
    out = entries.join(size(entries), "key", "left_anti").unionByName(found)
    return out.join(odd, "node", "left").select("key", "node", "n", "left", F.coalesce("odd", F.lit(0)).alias("odd"))


def _families(entries: DataFrame, sets: DataFrame, nodes: DataFrame, turns: int = 3) -> DataFrame:
    """Members of families: node, fam (their representative), d, delta, dropped. All other nodes are families of their own.

    The first turn is over all lists; later ones only over lists that many sets without a family share.
    """
    found, rows = None, entries
    for turn in range(turns):
        # of a crowd, a set that has little of its own is near the others
        drawn = F.min(F.struct("odd", F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "n")).alias("rep")
        reps = rows.groupBy("key").agg(drawn, F.count("*").alias("m")).where(F.col("m") > (LONG if turn else 1))
        named = rows.join(reps.select("key", F.col("rep.node").alias("rep"), F.col("rep.n").alias("rep_n")), "key").where(F.col("node") != F.col("rep")).where(_may_link("n", "rep_n"))
        votes = named.groupBy("node", "rep").agg(F.count("*").alias("votes"))
        best = votes.groupBy("node").agg(F.max(F.struct("votes", F.xxhash64("rep").alias("draw"), "rep")).alias("best")).select(F.col("node").alias("a"), F.col("best.rep").alias("b"))
        joined = cut(_compared(best, sets, True), nodes)
        # a representative of others keeps a family of its own
        joined = cut(joined.join(joined.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), nodes)
        joined = joined.select(F.col("a").alias("node"), F.col("b").alias("fam"), (1 - F.col("common") / F.col("total")).alias("d"), "delta", "dropped")
        found = joined if found is None else found.unionByName(joined)
        if turn + 1 < turns:
            taken = found.select("node").union(found.select("fam")).distinct()
            rows = cut(entries.join(taken, "node", "left_anti"))
            if rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > LONG).isEmpty():
                break
    return found


def _list_block(group: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of a list (or one with itself): pairs of families whose bitmaps allow a link."""
    order = np.argsort(group["fam"].to_numpy(), kind="stable")
    fam, n, r, side, left = (group[c].to_numpy()[order] for c in ("fam", "rep_n", "radius", "side", "left"))
    low, high = (group[c].to_numpy()[order] for c in ("low", "high"))
    mark = [np.frombuffer(m, "<u8") for m in group["mark"].iloc[order]]
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    out = []
    by_words = {}
    for j in b:
        by_words.setdefault(len(mark[j]), []).append(j)
    for words, own in by_words.items():
        own = np.array(own)
        base = np.stack([mark[j] for j in own])
        for i in a:
            w = min(words, len(mark[i]))
            fit = (fam[own] > fam[i]) if b is a else (fam[own] != fam[i])
            fit &= (100 * np.minimum(high[i], high[own]) >= PERCENT * np.maximum(low[i], low[own]))
            fit &= np.minimum(left[i], left[own]) >= extra(np.maximum(low[i], low[own]))
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            other = base[at]
            while other.shape[1] > w:
                other = other[:, :other.shape[1] // 2] ^ other[:, other.shape[1] // 2:]
            odd = np.bitwise_count(other ^ _folded(mark[i], w)).sum(1).astype(np.int64)
            # |A - B| + |B - A| is at least the number of marks that differ
            near = 2 * odd / (n[i] + n[own[at]] + odd) <= FAR + r[i] + r[own[at]] + 1e-9
            for j in own[at[near]]:
                out.append((min(fam[i], fam[j]), max(fam[i], fam[j])))
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"]) if out else no_rows("a", "b")


def _candidates(entries: DataFrame, family: DataFrame, sets: DataFrame) -> DataFrame:
    """entries(key, node, n, left), family(node, fam) -> pairs a < b of families that may hold a link."""
    info = family.groupBy("fam").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("d").alias("radius"), F.max(F.when(F.col("node") == F.col("fam"), F.col("n"))).alias("rep_n"))
    lists = entries.join(family.select("node", "fam"), "node").groupBy("key", "fam").agg(F.max("left").alias("left"))
    lists = cut(lists.join(lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key").join(info, "fam"))
    rows = lists.where(F.col("m") <= LONG)
    names = ["fam", "left", "low", "high"]
    x, y = (rows.select("key", *[F.col(c).alias(f"{p}_{c}") for c in names]) for p in "xy")
    largest = F.greatest("x_low", "y_low")
    share = F.greatest(F.lit(1), F.floor(largest * EXTRA))
    fit = (F.col("x_fam") < F.col("y_fam")) & (100 * F.least("x_high", "y_high") >= PERCENT * largest) & (F.least("x_left", "y_left") >= share)
    short = x.join(y, "key").where(fit).select(F.col("x_fam").alias("a"), F.col("y_fam").alias("b")).distinct()
    # long lists: blocks by size and position
    level = F.floor(F.log("rep_n") / np.log(1 / (1 - FAR) ** 3)).cast("int")
    rows = lists.where(F.col("m") > LONG).withColumn("level", level).withColumn("place", F.floor(F.log2("left")).cast("int"))
    whole = rows.groupBy("key", "level", "place").agg(F.count("*").alias("k"))
    rows = rows.join(whole, ["key", "level", "place"]).withColumn("part", F.pmod(F.xxhash64("fam"), F.ceil(F.col("k") / LIST_BLOCK)).cast("int"))
    rows = cut(rows.join(sets.select(F.col("node").alias("fam"), "mark"), "fam").withColumn("block", F.xxhash64("level", "place", "part")))
    blocks = rows.groupBy("key", "block").agg(F.max("level").alias("level"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("left").alias("left"))
    x, y = (blocks.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ["block", "level", "low", "high", "left"]]) for p in "xy")
    largest = F.greatest("x_low", "y_low")
    share = F.greatest(F.lit(1), F.floor(largest * EXTRA))
    fit = (F.col("x_block") <= F.col("y_block")) & (F.abs(F.col("x_level") - F.col("y_level")) <= 1) & (100 * F.least("x_high", "y_high") >= PERCENT * largest) & (F.least("x_left", "y_left") >= share)
    both = cut(x.join(y, "key").where(fit).select("key", "x_block", "y_block"))
    sides = both.select("key", F.col("x_block").alias("block"), "x_block", "y_block", F.lit(0).alias("side"))
    sides = sides.union(both.where("x_block <> y_block").select("key", "y_block", "x_block", "y_block", F.lit(1)))
    dealt = rows.select("key", "block", "fam", "left", "low", "high", "rep_n", "radius", "mark").join(sides, ["key", "block"])
    long = dealt.groupBy("key", "x_block", "y_block").applyInPandas(lean_group(_list_block), "a long, b long")
    return _sieved(short, info, sets).union(long).distinct()


def _sieved(pairs: DataFrame, info: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of families whose bitmaps do not rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            slack = np.asarray(batch.column(6)) + np.asarray(batch.column(7))
            for x, n, y, m, s in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), slack):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                w = min(len(x), len(y))
                odd = int(np.bitwise_count(_folded(x, w) ^ _folded(y, w)).sum())
                keep.append(2 * odd <= (FAR + s + 1e-9) * (n + m + odd))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    marked = info.select("fam", "radius").join(sets.select(F.col("node").alias("fam"), "mark", "n"), "fam")
    left = marked.toDF("a", "xr", "x", "xn")
    right = marked.toDF("b", "yr", "y", "yn")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "xn", "y", "yn", "xr", "yr").mapInArrow(lean_batches(run), "a long, b long")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b, as a matrix."""
    n, m = len(a), len(b)
    out = np.zeros((n, m), np.int32)
    if not sum(map(len, a)) or not sum(map(len, b)):
        return out
    row = np.repeat(np.arange(n + m, dtype=np.int32), [len(x) for x in a + b])
    column = np.concatenate(a + b)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    new = np.ones(len(column), bool)
    new[1:] = column[1:] != column[:-1]
    column = np.cumsum(new) - 1
    del order, new
    left = row < n
    held = np.bincount(column[left], minlength=column[-1] + 1), np.bincount(column[~left], minlength=column[-1] + 1)
    # members that few sets hold: their pairs one by one
    dense = held[0] * held[1] > 64
    rare = ~dense & (held[0] > 0) & (held[1] > 0)
    x, y = row[left & rare[column]], row[~left & rare[column]] - n
    each, other = held[0][rare], held[1][rare]
    times = np.repeat(other, each)  # partners of each entry of x
    first = np.repeat(np.cumsum(other) - other, each)
    upto, lo = np.cumsum(times), 0
    while lo < len(x):  # an entry has at most 64 partners
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right"))
        many = times[lo:hi]
        partner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[lo:hi], many)
        at, add = np.unique(np.repeat(x[lo:hi].astype(np.int64), many) * m + y[partner], return_counts=True)
        out.ravel()[at] += add.astype(np.int32)
        lo = hi
    # the others: a product of matrices, some columns at a time
    number = np.cumsum(dense) - 1
    keep = dense[column]
    row, column = row[keep], number[column[keep]]
    for lo in range(0, int(dense.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        held = np.zeros((n + m, int(min(COLUMNS, dense.sum() - lo))), np.float32)
        held[row[at], column[at] - lo] = 1
        for top in range(0, n, STRIP):
            out[top:top + STRIP] += (held[top:min(n, top + STRIP)] @ held[n:].T).astype(np.int32)  # at most COLUMNS: exact
    return out


def _host_block(group: pd.DataFrame) -> pd.DataFrame:
    """Blocks of families with their partners: for each set the number of rows that it is linked with, and the families that it joins."""
    out = []
    for (host, i, j), own in group.groupby(["host", "i", "j"]):
        pivot = np.frombuffer(own.loc[own["side"] == 2, "members"].iloc[0], "<u8")
        own = own[own["side"] < 2]
        side, node, fam, weight, size, d = (own[c].to_numpy() for c in ("side", "node", "fam", "weight", "n", "d"))
        delta, lost = [], own["dropped"].to_numpy().astype(np.int64)
        for k, x in enumerate(own["members"]):
            x = np.frombuffer(x, "<u8")
            if fam[k] != host:  # a guest comes with its whole set
                both = _positions(pivot, x)
                lost[k] = len(pivot) - both.sum()
                x = np.concatenate([pivot[~both], x[~_positions(x, pivot)]])
            delta.append(x)
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1)
        same = i == j and j >= 0
        if same:
            b = a
        if not len(a) or not len(b):
            continue
        both = _common([delta[k] for k in a], [delta[k] for k in b])
        mine, theirs, met = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.zeros(len(b), bool)
        for lo in range(0, len(a), STRIP):
            own = slice(lo, min(len(a), lo + STRIP))
            common = len(pivot) - lost[a[own]][:, None] - lost[b][None, :] + both[own]
            linked = 100 * common >= PERCENT * (size[a[own]][:, None] + size[b][None, :] - common)
            if j >= 0:  # two of the core are counted elsewhere
                linked &= ~((2 * d[a[own]] <= FAR)[:, None] & (2 * d[b] <= FAR)[None, :])
            if same:
                linked[np.arange(len(linked)), np.arange(own.start, own.stop)] = False
            mine[own] = linked @ weight[b]
            theirs += linked.T @ weight[a[own]]
            met |= linked.any(0)
        out.append(pd.DataFrame({"node": node[a], "others": mine, "fam": host, "to": host}))
        if not same:
            out.append(pd.DataFrame({"node": node[b], "others": theirs, "fam": np.where(met, fam[b], host), "to": host}))
    return pd.concat(out) if out else no_rows("node", "others", "fam", "to")


def _member_links(family: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """family(node, fam, n, d, delta, dropped, weight), pairs(host, guest) -> node, others, fam, to.

    others: the weight of classes that a class is linked with; fam, to: two families that a link joins.
    """
    host = pairs.groupBy("host").agg(F.count("*").alias("guests"))
    sizes = family.groupBy("fam").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    blocks = lambda k, size: F.greatest(F.ceil(F.col(size) / BLOCK_MEMBERS), F.ceil(F.col(k) / BLOCK_SETS)).cast("int")
    guests = pairs.join(family.select(F.col("fam").alias("guest"), F.col("fam"), "node", "n", "d", "weight"), "guest")
    guests = cut(guests.select("host", "fam", "node", "n", "d", "weight"))
    theirs = guests.groupBy("host").agg(F.count("*").alias("gk"), F.sum("n").alias("gsize")).select("host", blocks("gk", "gsize").alias("others"))
    hosts = sizes.join(host.withColumnRenamed("host", "fam"), "fam", "left").where("k > 1 or guests > 0").select(F.col("fam").alias("host"), blocks("k", "size").alias("own"), "k", "size")
    hosts = cut(hosts.join(theirs, "host", "left").withColumn("others", F.coalesce("others", F.lit(0))))
    # the members: against themselves (i <= j) and against the blocks of guests (j = -1 - block)
    members = family.select(F.col("fam").alias("host"), "fam", "node", "n", "d", "weight", "delta", "dropped").join(hosts.select("host", "own", "others", "k"), "host")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    itself = F.when(F.col("k") > 1, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    against = F.when(F.col("others") > 0, F.sequence(F.lit(-1), -F.col("others"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    members = members.withColumn("j", F.explode(F.concat(itself, against)))
    inner = (F.col("j") >= 0) & (F.col("j") < F.col("block"))
    members = members.select("host", "fam", "node", "n", "d", "weight", F.col("delta").alias("members"), "dropped", F.when(inner, F.col("j")).otherwise(F.col("block")).alias("i"), F.when(inner, F.col("block")).otherwise(F.col("j")).alias("j"), F.when(inner, 1).otherwise(0).alias("side"))
    # of two different blocks, the one with the larger number is the second side
    guests = guests.join(hosts.select("host", "own", "others"), "host").withColumn("j", (-1 - F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    guests = guests.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).join(sets.select("node", "members"), "node")
    guests = guests.select("host", "fam", "node", "n", "d", "weight", "members", F.lit(0).cast("long").alias("dropped"), "i", "j", F.lit(1).alias("side"))
    pivots = hosts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    upward = F.when(F.col("k") > 1, F.sequence(F.col("i"), F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    pivots = pivots.withColumn("j", F.explode(F.concat(upward, against))).join(sets.select(F.col("node").alias("host"), "members"), "host")
    none = F.lit(0).cast("long")
    pivots = pivots.select("host", F.col("host").alias("fam"), F.col("host").alias("node"), none.alias("n"), F.lit(0.0).alias("d"), none.alias("weight"), "members", none.alias("dropped"), "i", "j", F.lit(2).alias("side"))
    # families of one block meet in one group, as many as fill a block
    small = hosts.where("own = 1 and others <= 1").agg(F.sum("size").alias("size"), F.sum("k").alias("k")).first()
    groups = max(int(small.size or 0) // BLOCK_MEMBERS, int(small.k or 0) // BLOCK_SETS) + 1
    kind = hosts.select("host", F.when((F.col("own") > 1) | (F.col("others") > 1), F.xxhash64("host")).alias("alone"))
    rows = members.unionByName(guests).unionByName(pivots).join(kind, "host")
    single = F.col("alone").isNotNull()
    rows = rows.withColumn("place", F.coalesce("alone", F.pmod(F.xxhash64("host"), F.lit(groups)))).withColumn("gi", F.when(single, F.col("i")).otherwise(-9)).withColumn("gj", F.when(single, F.col("j")).otherwise(-9))
    found = rows.groupBy("place", "gi", "gj").applyInPandas(lean_group(_host_block), "node long, others long, fam long, to long")
    # the core: any two are linked by the triangle inequality
    core = family.where(2 * F.col("d") <= FAR)
    total = core.groupBy("fam").agg(F.sum("weight").alias("all"), F.count("*").alias("k")).where("k > 1")
    sure = core.join(total, "fam").select("node", (F.col("all") - F.col("weight")).alias("others"), "fam", F.col("fam").alias("to"))
    return found.unionByName(sure)


def link_classes(docs: DataFrame, shingle: int = 5, bucket_bytes: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_hash, n, node; nodes in lists: node, comp, others).

    node numbers the classes of equal sets; others is the number of rows in the classes that it is linked with.
    """
    scratch = Scratch(docs.sparkSession)
    buckets = buckets_for(docs, bucket_bytes)
    try:
        packed = scratch.keep(_index(docs, buckets, shingle), "kind")
        slim = packed.where("kind = 0").select("doc_id", "text_hash", "s1", "s2", "n", "batch", "ix")
        lead = slim.groupBy("s1", "s2").agg(F.max("n").alias("n"), F.count("*").alias("weight"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "batch", "ix", "text_hash")).alias("lead"))
        lead = cut(lead.select("s1", "s2", "n", "weight", "lead.doc_id", "lead.text_hash", F.monotonically_increasing_id().alias("node"), "lead.batch", "lead.ix"))
        members = cut(slim.select("doc_id", "text_hash", "s1", "s2", "n").join(lead.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "text_hash", "n", "node"))
        shared = packed.where("kind = 1").select("batch", "bucket", "data").groupBy("bucket").applyInPandas(lean_group(_frequencies), "batch string, bucket int, data binary")
        sizes = packed.where("kind = 2").select("batch", "bucket", "data")
        index = shared.union(sizes).groupBy("batch").applyInPandas(lean_group(_rare_first), "batch string, ix int, shared long, keys array<long>")
        lists = scratch.keep(index.join(lead, ["batch", "ix"]).select("node", "doc_id", "text_hash", "s1", "s2", "n", "weight", "shared", "keys"))
        entries = lists.select("node", "n", "shared", F.posexplode("keys").alias("rank", "key"))
        busy = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
        entries = scratch.keep(entries.join(busy, "key").select("key", "node", "n", (F.col("shared") - F.col("rank")).alias("left")))
        wanted = cut(lists.select("node", "doc_id", "text_hash", "s1", "s2", "n", "weight").join(entries.select("node").distinct(), "node", "left_semi"))
        sets = scratch.keep(_set_table(docs, wanted.select("node", "doc_id", "text_hash", "s1", "s2"), shingle))
        entries = scratch.keep(_thinned(entries, sets))
        joined = _families(entries, sets, wanted.count())
        family = wanted.select("node", "n", "weight").join(joined, "node", "left")
        family = scratch.keep(family.select("node", F.coalesce("fam", "node").alias("fam"), "n", "weight", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("delta", F.lit(b"")).alias("delta"), F.coalesce("dropped", F.lit(0)).alias("dropped")))
        info = cut(family.groupBy("fam").agg(F.count("*").alias("k"), F.max("d").alias("radius"), F.sum("weight").alias("weight")))
        checked = cut(_compared(_candidates(entries, family, sets), sets, False))
        checked = checked.join(info.toDF("a", "ak", "ar", "aw"), "a").join(info.toDF("b", "bk", "br", "bw"), "b")
        one = (F.col("ak") == 1) & (F.col("bk") == 1)
        direct = checked.where(one & (100 * F.col("common") >= PERCENT * F.col("total")))
        near = 1 - F.col("common") / F.col("total") <= FAR + F.col("ar") + F.col("br") + 1e-9
        larger = (F.col("ak") > F.col("bk")) | ((F.col("ak") == F.col("bk")) & (F.col("a") < F.col("b")))
        pairs = cut(checked.where(~one & near).select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("guest")))
        inner = cut(_member_links(family, pairs, sets))
        links = direct.select(F.col("a").alias("node"), F.col("bw").alias("others")).union(direct.select("b", "aw")).union(inner.select("node", "others"))
        edges = direct.select("a", "b").union(inner.where("fam <> to").select("fam", "to"))
        comp = components(edges.distinct()).withColumnRenamed("node", "fam")
        found = family.select("node", "fam").join(comp, "fam", "left").select("node", F.coalesce("comp", "fam").alias("comp"))
        others = links.groupBy("node").agg(F.sum("others").alias("others"))
        return members, cut(found.join(others, "node", "left").select("node", "comp", F.coalesce("others", F.lit(0)).alias("others")))
    finally:
        scratch.drop()


def near_duplicate_classes(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_links, component_id, class_id.

    n_links is the number of other rows whose sets link with the row's own, equal ones included.
    class_id is the least doc_id of the rows with an equal set. Rows without words form no component:
    such a row's component_id is its own doc_id.
    """
    rows, found = link_classes(docs, shingle)
    # per class first, so that no group of copies meets in one task
    own = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("class_id"), (F.count("*") - 1).alias("copies"))
    own = own.join(found, "node", "left").select("node", "class_id", F.coalesce("comp", "node").alias("comp"), (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_links"))
    least = own.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    own = cut(own.join(least, "comp").select("node", "class_id", "component_id", "n_links"))
    out = rows.join(own, "node", "left")
    some = F.col("n") > 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents without near duplicates: one row of each component stays, that with the least doc_id.

    A row is known by doc_id and text, so texts that share a doc_id are decided each. Rows without
    doc_id come last in their component. Texts without words stay, also where they repeat. Nulls in
    other columns and clashing names do not matter; an empty table gives an empty result.
    """
    rows, found = link_classes(docs, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    texts = rows.where("n > 0").groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = texts.groupBy("node").agg(F.min(F.struct(order.alias("at"), "rows")).alias("kept")).join(found, "node", "left")
    kept = first.groupBy(F.coalesce("comp", "node")).agg(F.min("kept").alias("kept")).select("kept.at.*", "kept.rows")
    kept = cut(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "rows"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    keyed = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_hash().alias("own_hash"), F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("some"), whole)
    at = (F.col("own_hash") == F.col("kept_hash")) & F.col("own_id").eqNullSafe(F.col("kept_id"))
    found = keyed.where("some").join(kept, at)
    once = found.where("rows = 1").select("whole.*")
    # of rows with one doc_id and text the least stays, so that reruns agree; a map column has no order and no part in it
    ordered = F.struct(*[F.col(f"whole.`{f.name}`") for f in docs.schema.fields if not f.dataType.simpleString().count("map<") and f.dataType.simpleString() not in ("variant", "interval")])
    again = found.where("rows > 1").groupBy("own_id", "own_hash").agg(F.min_by("whole", ordered).alias("whole")).select("whole.*")
    return once.unionByName(again).unionByName(keyed.where("not some").select("whole.*")).select([f"`{c}`" for c in docs.columns])
