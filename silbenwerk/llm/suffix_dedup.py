"""Suffix-array dedup: removes every byte covered by a string of `span` bytes that occurs elsewhere too.

Sorting all suffixes in one place is not an option, so strings that may be equal are brought into
one shard first. Of the `GRAM`-byte substrings in a window of `span` bytes, the one with the least
hash is the window's anchor; equal windows have equal anchors at equal offsets. Neighbouring
windows with the same anchor form a run, whose context is the text that they cover.

1. `_anchors`: the runs of every text, packed by hash bucket of the anchor; one row holds all runs
   that one batch of documents has in one bucket.
2. `_compare`: a bucket finds anchors that occur twice or more. Runs whose whole context is equal
   to another's are repeated throughout. An anchor that occurs once is dropped. What remains are
   anchors with different contexts: the ends of repeats.
3. Those contexts, one of each kind, go to shards by anchor. A shard is a text of some megabytes
   whose suffix array is built by external induced sorting (`induced`); two neighbours in it with a
   common prefix of `span` bytes and more are repeated windows. An anchor with more contexts than a
   shard should hold (the edge of a passage that many documents have) is not brought together:
   `_windows` gives each of its windows as a digest, and digests that occur twice are repeated.
4. Each text gets the union of its repeated windows, and the rest is what is kept.

Shards are sorted in memory, which their size bounds: their number follows the input, and no anchor
adds more than `shard_runs` contexts to one. The queue of the induction spills, its results do not.
Buckets grow with the occurrences of an anchor, 16 bytes for each.

Defined results: a null text is an empty one; texts shorter than `span` keep everything; of equal
texts of at least `span` bytes nothing is kept in any; rows that repeat a doc_id are documents of
their own; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, buckets_for, cut, lean_batches, lean_group, no_rows
from .induced import suffix_array
from .pieces import mix64
from .shingles import byte_chunks, powers

SPAN, GRAM = 200, 96
NARROW = 150_000  # runs in one packed batch
CHUNK = 200_000  # bytes of text whose windows are hashed at once; a byte takes some 100 in arrays
ROWS = 1_000  # whole texts that are rewritten at once
PACKED = "kind int, batch string, bucket int, data binary, ids array<long>, f1 array<long>, f2 array<long>"
SPANS = "array<struct<lo:int,hi:int>>"


def runs_of(texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text index, anchor hash, context hash, first and last window start in the text) of every run."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if sizes.max(initial=0) < span:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    data = np.frombuffer(b"".join(texts), np.uint8)
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
        n = len(data) - gram + 1
        grams = mix64((run[gram:] - run[:n]) * down[:n])
        wide = span - gram + 1
        # least hash in each window of `wide` positions, the leftmost of equals: block-wise running minima
        key = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = ((grams >> np.uint64(32)) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        blocks = key.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - wide + 1
        anchor = (np.minimum(behind[:windows], ahead[wide - 1:wide - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        room = np.maximum(0, sizes - span + 1)
        at = np.arange(int(room.sum())) + np.repeat(start - (np.cumsum(room) - room), room)  # valid window starts
        owner = np.repeat(np.arange(len(texts)), room)
        mine = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        lo, hi, a, doc = at[head], at[tail], mine[head], owner[head]
        context = mix64((run[hi + span] - run[lo]) * down[lo] + mix64(((a - lo) << 32 | (hi - lo)).astype(np.uint64)))
    return doc, grams[a], context, lo - start[doc], hi - start[doc]


def _anchors(docs: DataFrame, buckets: int, span: int) -> DataFrame:
    """docs(f1, f2, doc_id, text)."""
    bits = int(buckets).bit_length() - 1

    def row(kind, batch, bucket, data, ids=None, f1=None, f2=None):
        return (kind, batch, bucket, data, ids, f1, f2)

    def pack(held: list) -> pa.RecordBatch:
        batch = uuid.uuid4().hex[:16]
        ids, f1, f2 = ([x for p in held for x in p[i]] for i in range(3))
        doc, h, g, lo, hi = (np.concatenate([p[i] for p in held]) for i in range(3, 8))
        rows = [row(0, batch, -1, doc.astype("<u4").tobytes() + lo.astype("<u4").tobytes() + hi.astype("<u4").tobytes(), ids, f1, f2)]
        place = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        found, start = np.unique(place[order], return_index=True)
        low, ctx, ix = (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), g[order].astype("<u8"), order.astype("<u4")
        for b, s, e in zip(found.tolist(), start, np.append(start[1:], len(order))):
            rows.append(row(1, batch, b, ctx[s:e].tobytes() + low[s:e].tobytes() + ix[s:e].tobytes()))
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "batch", "bucket", "data", "ids", "f1", "f2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, runs = [], 0, 0
        for batch in batches:
            f1, f2, ids = (batch.column(i).to_pylist() for i in range(3))
            for first, texts in byte_chunks(batch, 3, CHUNK):
                doc, h, g, lo, hi = runs_of(texts, span)
                if held and runs + len(doc) > NARROW:
                    yield pack(held)
                    held, rows, runs = [], 0, 0
                end = first + len(texts)
                held.append((ids[first:end], f1[first:end], f2[first:end], doc + rows, h, g, lo, hi))
                rows, runs = rows + len(texts), runs + len(doc)
        if held:
            yield pack(held)

    return docs.select("f1", "f2", "doc_id", "text").mapInArrow(lean_batches(run), PACKED)


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: runs that are repeated (1), that need comparing (2), or both (3)."""
    bucket = int(group["bucket"].iloc[0])
    ctx, low, ix = [], [], []
    for data in group["data"]:
        n = len(data) // 16
        ctx.append(np.frombuffer(data, "<u8", n))
        low.append(np.frombuffer(data, "<u4", n, 8 * n))
        ix.append(np.frombuffer(data, "<u4", n, 12 * n))
    owner = np.repeat(np.arange(len(group)), [len(x) for x in ix])
    ctx, low, ix = np.concatenate(ctx), np.concatenate(low), np.concatenate(ix)
    order = np.lexsort((ctx, low))
    c, l = ctx[order], low[order]
    new_l = np.ones(len(c), bool)
    new_l[1:] = l[1:] != l[:-1]
    new_c = new_l.copy()
    new_c[1:] |= c[1:] != c[:-1]
    class_of, anchor_of = np.cumsum(new_c) - 1, np.cumsum(new_l) - 1
    copies = np.bincount(class_of)[class_of]
    kinds = np.bincount(anchor_of[new_c])[anchor_of]
    flag = (copies >= 2) * 1 + ((kinds >= 2) & new_c) * 2
    keep = np.flatnonzero(flag)
    at = order[keep]
    by = np.argsort(owner[at], kind="stable")
    at, keep = at[by], keep[by]
    found, start = np.unique(owner[at], return_index=True)
    out = []
    for o, s, e in zip(found.tolist(), start, np.append(start[1:], len(at))):
        out.append((group["batch"].iloc[o], bucket, ix[at[s:e]].astype("<u4").tobytes() + l[keep[s:e]].astype("<u4").tobytes() + flag[keep[s:e]].astype("<u1").tobytes()))
    return pd.DataFrame(out, columns=["batch", "bucket", "data"]) if out else no_rows("batch", "bucket", "data")


def joined_spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open intervals; intervals that touch are one."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    cut_at = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    return list(zip(lo[np.append(0, cut_at)].tolist(), hi[np.append(cut_at - 1, len(hi) - 1)].tolist()))


MARKS = f"f1 long, f2 long, spans {SPANS}, open array<struct<anchor:long,lo:int,hi:int>>"


def _marks(span: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """One batch: repeated spans of its texts, and the runs that need comparing."""
        base = group[group["bucket"] < 0]
        rest = group[group["bucket"] >= 0]
        empty = no_rows("f1", "f2", "spans", "open")
        if not len(base) or not len(rest):
            return empty
        doc, lo, hi = np.frombuffer(base["data"].iloc[0], "<u4").reshape(3, -1).astype(np.int64)
        f1, f2 = np.asarray(base["f1"].iloc[0]), np.asarray(base["f2"].iloc[0])
        ix, low, flag, bucket = [], [], [], []
        for b, data in zip(rest["bucket"], rest["data"]):
            n = len(data) // 9
            ix.append(np.frombuffer(data, "<u4", n))
            low.append(np.frombuffer(data, "<u4", n, 4 * n).astype(np.int64))
            flag.append(np.frombuffer(data, "<u1", n, 8 * n))
            bucket.append(np.full(n, b, np.int64))
        ix, low, flag, bucket = (np.concatenate(x) for x in (ix, low, flag, bucket))
        order = np.argsort(ix, kind="stable")
        ix, anchor, flag = ix[order], ((bucket << 32) | low)[order], flag[order]
        owner = doc[ix]
        found, start = np.unique(owner, return_index=True)
        rows = []
        for d, s, e in zip(found.tolist(), start, np.append(start[1:], len(ix))):
            own, kind = ix[s:e], flag[s:e]
            full, part = own[(kind & 1) > 0], (kind & 2) > 0
            spans = joined_spans(lo[full], hi[full] + span)
            rows.append((f1[d], f2[d], [{"lo": a, "hi": b} for a, b in spans], [{"anchor": int(k), "lo": int(lo[i]), "hi": int(hi[i])} for k, i in zip(anchor[s:e][part], own[part])]))
        return pd.DataFrame(rows, columns=["f1", "f2", "spans", "open"]) if rows else empty

    return run


def _contexts(rows: DataFrame, span: int) -> DataFrame:
    """rows(f1, f2, doc_id, text, open): the texts of the runs that need comparing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for f1, f2, text, own in zip(batch.column(0), batch.column(1), batch.column(3), batch.column(batch.num_columns - 1)):
                text = text.as_py() or b""
                for r in own.as_py():
                    out.append((f1.as_py(), f2.as_py(), r["anchor"], r["lo"], text[r["lo"]:r["hi"] + span]))
                    size += len(out[-1][4])
                if size > 4_000_000:
                    yield _context_rows(out)
                    out, size = [], 0
            if out:
                yield _context_rows(out)

    return rows.mapInArrow(lean_batches(run), "f1 long, f2 long, anchor long, lo int, piece binary")


def _windows(pieces: DataFrame, span: int) -> DataFrame:
    """pieces(f1, f2, anchor, lo, piece) -> f1, f2, lo, digest of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            f1, f2, lo = (batch.column(i).to_numpy() for i in (0, 1, 3))
            for first in range(0, batch.num_rows, 1_000):
                texts = [t.as_py() for t in batch.column(4)[first:first + 1_000]]
                many = np.array([len(t) - span + 1 for t in texts], np.int64)
                own = np.repeat(np.arange(len(texts)), many)
                at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
                digests = [hashlib.blake2b(t[k:k + span], digest_size=16).digest() for t in texts for k in range(len(t) - span + 1)]
                own += first
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((f1[own], f2[own], lo[own] + at, digests), kinds)], ["f1", "f2", "lo", "digest"])

    return pieces.select("f1", "f2", "anchor", "lo", "piece").mapInArrow(lean_batches(run), "f1 long, f2 long, lo int, digest binary")


def _context_rows(out: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["f1", "f2", "anchor", "lo", "piece"])


def _sorted_shard(span: int, memory: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """One shard: windows that the suffix array finds at two places, as spans."""
        group = group.drop_duplicates(["f1", "f2", "lo", "anchor"])
        pieces = group["piece"].tolist()
        sizes = np.array([len(p) for p in pieces], np.int64)
        text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # 255 occurs in no UTF-8 text
        del pieces
        sa, lcp = suffix_array(text, span, memory)
        twice = lcp >= span
        hit = np.zeros(len(text), bool)
        hit[sa[twice]] = True
        hit[sa[:-1][twice[1:]]] = True
        del sa, lcp, twice
        at = np.flatnonzero(hit)
        start = np.cumsum(sizes + 1) - sizes - 1
        owner = np.searchsorted(start, at, "right") - 1
        inside = at - start[owner] <= sizes[owner] - span  # a window that runs into the next piece is none
        at, owner = at[inside], owner[inside]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1 if len(at) else head
        own = owner[head]
        first = group["lo"].to_numpy()[own] if len(own) else np.zeros(0, np.int64)
        return pd.DataFrame({"f1": group["f1"].to_numpy()[own], "f2": group["f2"].to_numpy()[own], "lo": (first + at[head] - start[own]).astype(np.int32), "hi": (first + at[tail] - start[own] + span).astype(np.int32)})

    return run


def repeated_spans(docs: DataFrame, span: int = SPAN, bucket_bytes: int = 1_000_000, shard_runs: int = 10_000, memory: int = 64_000_000) -> tuple[DataFrame, DataFrame]:
    """(keyed docs: f1, f2, doc_id, text, the other columns; spans: f1, f2, spans)."""
    scratch = Scratch(docs.sparkSession)
    buckets = buckets_for(docs, bucket_bytes)
    text = F.coalesce(F.col("text"), F.lit(""))
    f1, f2 = F.xxhash64(text), F.xxhash64(F.lit(7), F.coalesce(F.col("doc_id"), F.lit(-1)), text)
    others = [F.col(f"`{c}`").alias(f"own_{c}".replace(".", "_dot_")) for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.select(f1.alias("f1"), f2.alias("f2"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), *others)
    try:
        packed = scratch.keep(_anchors(keyed, buckets, span), "kind")
        flags = packed.where("kind = 1").select("batch", "bucket", "data").groupBy("bucket").applyInPandas(lean_group(_compare), "batch string, bucket int, data binary")
        none = F.lit(None).cast("array<long>")
        both = flags.select("batch", "bucket", "data", none.alias("f1"), none.alias("f2")).unionByName(packed.where("kind = 0").select("batch", "bucket", "data", "f1", "f2"))
        marks = both.groupBy("batch").applyInPandas(lean_group(_marks(span)), MARKS)
        marks = cut(marks.groupBy("f1", "f2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("open")).alias("open")))
    finally:
        scratch.drop()
    shards = max(1, int(marks.agg(F.sum(F.size("open"))).first()[0] or 0) // shard_runs)
    # the texts are dealt by the same key here and in remove_repeats, so that Spark shuffles them once
    opened = keyed.join(marks.where(F.size("open") > 0).select("f1", "f2", "open"), ["f1", "f2"]).select(*keyed.columns, "open")
    pieces = _contexts(opened, span)
    hot = cut(marks.select(F.explode("open.anchor").alias("anchor")).groupBy("anchor").count().where(F.col("count") > shard_runs).select("anchor"))
    more = None
    if not hot.isEmpty():
        pieces = cut(pieces)
        # each has more than shard_runs contexts, so there are few; the planner broadcasts them if they are small enough
        windows = cut(_windows(pieces.join(hot, "anchor", "left_semi"), span))
        # rows of equal documents share f1 and f2: their windows are repeated in any case
        twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        more = windows.join(twice, "digest").select("f1", "f2", "lo", (F.col("lo") + span).cast("int").alias("hi"))
        pieces = pieces.join(hot, "anchor", "left_anti").select("f1", "f2", "anchor", "lo", "piece")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = pieces.groupBy("shard").applyInPandas(lean_group(_sorted_shard(span, memory)), "f1 long, f2 long, lo int, hi int")
    if more is not None:
        found = found.union(more)
    more = found.groupBy("f1", "f2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = marks.where(F.size("spans") > 0).select("f1", "f2", "spans").unionByName(more).groupBy("f1", "f2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return keyed, spans


def whole_characters(text: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The span widened so that it cuts no character of UTF-8."""
    while lo > 0 and lo < len(text) and text[lo] & 0xC0 == 0x80:
        lo -= 1
    while hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi += 1
    return lo, hi


def _kept(text: bytes, union: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in union:
        parts.append(text[at:max(at, lo)])
        at = max(at, hi)
    return b"".join(parts) + text[at:]


def _union(own) -> list[tuple[int, int]]:
    own = own.as_py() or []
    return joined_spans(np.array([s["lo"] for s in own], np.int64), np.array([s["hi"] for s in own], np.int64))


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (over the bytes that are left)."""
    keyed, spans = repeated_spans(docs.select("doc_id", "text"), span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, own in zip(batch.column(2), batch.column(3), batch.column(4)):
                text, union = text.as_py() or b"", _union(own)
                kept = _kept(text, union)
                out.append((key.as_py(), len(text), len(text) - len(kept), len(union), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return keyed.join(spans, ["f1", "f2"], "left").select(*keyed.columns, "spans").mapInArrow(lean_batches(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents without their repeated strings, whole characters going where a span cuts one.

    n_chars follows the text. Documents of which nothing is left go; those that were empty or null stay, as empty ones. Rows that repeat, and
    rows with one doc_id and text, lose the same strings and are answered each; nulls and clashing or dotted names in other columns do not matter;
    an empty table gives an empty result.
    """
    keyed, spans = repeated_spans(docs, span)
    schema = docs.schema
    names = ["doc_id" if c == "doc_id" else "text" if c == "text" else f"own_{c}".replace(".", "_dot_") for c in docs.columns]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            texts, sizes, keep = [], [], []
            for text, own in zip(batch.column(3), batch.column(batch.num_columns - 1)):
                text, union = text.as_py() or b"", _union(own)
                left = _kept(text, [whole_characters(text, *s) for s in union]).decode("utf-8", "ignore") if union else text.decode("utf-8", "ignore")
                texts.append(left)
                sizes.append(len(left))
                keep.append(bool(left) or not text)
            columns = [pa.array(texts, pa.string()) if n == "text" else pa.array(sizes, pa.int64()) if n == "own_n_chars" else batch.column(batch.schema.get_field_index(n)) for n in names]
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
            yield whole.filter(pa.array(keep, pa.bool_()))

    return keyed.join(spans, ["f1", "f2"], "left").select(*keyed.columns, "spans").mapInArrow(lean_batches(run), schema)
