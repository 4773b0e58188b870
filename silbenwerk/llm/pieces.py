"""SentencePiece encoding by sampling, and lossless decoding.

The lattice of a pre-token holds all ways to cut it into pieces of the vocabulary. Forward
filtering sums their probabilities from the left, once for each prefix of a chunk's distinct
pre-tokens, level by level; backward sampling then walks from a pre-token's last node to the root, choosing each piece with its share
of the mass that arrives. The walks of all pre-tokens of a batch advance together, as arrays. The
random numbers are a hash of the seed, the row's key, the pre-token's place and the step, so a
row's pieces do not depend on how rows are dealt to tasks or on a task being run again.

Pre-tokens: a blank with the word after it, a word without one, or a single white-space character;
they tile the text. A literal separator sign and every character that is no piece is spelled as
bytes, so decoding gives back every text exactly.

Defined results: null and empty texts have no pieces; a null key counts as key 0; rows that
repeat get the same pieces; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean_batches
from .lattice import DEFAULT_MODEL, Lattice, Vocabulary, vocabulary

UNIT = re.compile(r" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")
SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, piece_sha256 string, decoded_sha256 string, lossless boolean, piece_ids array<int>"


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, places: np.ndarray, step: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        x = mix64(x ^ (places * np.uint64(0xD1B54A32D192ED03)))
        x = mix64(x + np.uint64(step + 1) * np.uint64(0x8CB92BA72F3D8DD7))
    return (x >> np.uint64(11)) * (1.0 / (1 << 53))


def sample_paths(lattice: Lattice, nodes: np.ndarray, keys: np.ndarray, places: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backward walks from nodes to the root: (unit, step, piece) of every piece, steps from the right."""
    upto, parent, piece = lattice.upto, lattice.parent, lattice.piece
    at, live, step = nodes.copy(), np.flatnonzero(nodes), 0
    units, steps, found = [], [], []
    while len(live):
        here = at[live]
        # edge ends are stored as node + cumulative probability, so one search serves all nodes
        draw = np.minimum(here + uniform(keys[live], places[live], step, seed), np.nextafter(here + 1.0, 0.0))
        edge = np.searchsorted(upto, draw, "right")
        units.append(live)
        steps.append(np.full(len(live), step, np.int32))
        found.append(piece[edge])
        at[live] = parent[edge]
        live = live[at[live] > 0]
        step += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(units), np.concatenate(steps), np.concatenate(found)) if units else (none, none, none)


def encode_texts(texts: list[str], keys: list[int], vocab: Vocabulary, theta: float, seed: int) -> list[np.ndarray]:
    """Piece ids of every text."""
    number: dict[str, int] = {}
    of = number.setdefault
    ids, sizes = [], []
    for text in texts:
        units = UNIT.findall(text)
        ids.append(np.fromiter((of(u, len(number)) for u in units), np.int64, len(units)))
        sizes.append(len(units))
    lattice = Lattice(vocab, theta, list(number))
    nodes = lattice.node[np.concatenate(ids)] if number else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        key = np.asarray(keys, np.int64).astype(np.uint64)[row]
    place = (np.arange(len(nodes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    unit, step, piece = sample_paths(lattice, nodes, key, place, seed)
    # units ascending, steps descending: the pieces in the order of the text
    order = np.lexsort((-step, unit))
    unit, piece = unit[order], piece[order]
    spelled = piece < 0
    if spelled.any():
        chars = {c: [vocab.byte_ids[b] for b in chr(-c - 1).encode("utf-8", "surrogatepass")] for c in np.unique(piece[spelled]).tolist()}
        width = np.ones(len(piece), np.int64)
        width[spelled] = [len(chars[c]) for c in piece[spelled].tolist()]
        start = np.cumsum(width) - width
        out = np.repeat(piece, width)
        for i in np.flatnonzero(spelled).tolist():
            out[start[i]:start[i] + width[i]] = chars[int(piece[i])]
        unit, piece = np.repeat(unit, width), out
    ends = np.searchsorted(row[unit] if len(unit) else np.zeros(0, np.int64), np.arange(len(texts)), "right")
    return np.split(piece.astype(np.int32), ends[:-1]) if len(texts) else []


def chunks(batch: pa.RecordBatch, most_bytes: int = 1_000_000) -> Iterator[tuple[list, list]]:
    """(keys, texts) of some rows at a time; a text that alone is longer makes a chunk of its own."""
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        text = text.as_py() or ""
        if texts and size + len(text) > most_bytes:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key.as_py())
        texts.append(text)
        size += len(text)
    if texts:
        yield keys, texts


def encode_copies(docs: DataFrame, model: str = DEFAULT_MODEL, theta: float = 1.0, seed: int = 1) -> DataFrame:
    """`encode` for documents that repeat: equal rows (doc_id, text) are numbered, and each copy has a sample of its own.

    The columns are those of `encode` without the ids, and copy (0, 1, ...); the first copy's sample is that of `encode`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    alike = Window.partitionBy("doc_id", "of_text").orderBy(F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("of_text")).withColumn("copy", F.row_number().over(alike) - 1)
    key = F.when(F.col("copy") == 0, F.coalesce("doc_id", F.lit(0))).otherwise(F.xxhash64("doc_id", "copy"))
    ids = F.struct(key.alias("key"), "doc_id", "copy")
    return _encoded(rows.select(ids.alias("ids"), "text"), model, theta, seed)


def _encoded(rows: DataFrame, model: str, theta: float, seed: int) -> DataFrame:
    """rows(ids: key, doc_id, copy; text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        is_byte = np.zeros(max(vocab.texts) + 1, bool)
        is_byte[vocab.byte_ids] = True
        for batch in batches:
            for ids, texts in chunks(batch):
                found = encode_texts(texts, [x["key"] for x in ids], vocab, theta, seed)
                decoded = [b"".join(map(vocab.texts.__getitem__, x.tolist())) for x in found]
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["doc_id"] for x in ids], pa.int64()),
                    pa.array([x["copy"] for x in ids], pa.int32()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([int(is_byte[x].sum()) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    pa.array([a == b for a, b in zip(raw, decoded)]),
                ], ["doc_id", "copy", "n_pieces", "n_byte_pieces", "piece_sha256", "decoded_sha256", "lossless"])

    return rows.mapInArrow(lean_batches(run), "doc_id long, copy int, n_pieces long, n_byte_pieces long, piece_sha256 string, decoded_sha256 string, lossless boolean")


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, theta: float = 1.0, seed: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per document: counts, digests of the pieces and of the decoded text, and piece_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        is_byte = np.zeros(max(vocab.texts) + 1, bool)
        is_byte[vocab.byte_ids] = True
        for batch in batches:
            for keys, texts in chunks(batch):
                found = encode_texts(texts, [k or 0 for k in keys], vocab, theta, seed)
                decoded = [b"".join(map(vocab.texts.__getitem__, ids.tolist())) for ids in found]
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([int(is_byte[x].sum()) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    pa.array([a == b for a, b in zip(raw, decoded)]),
                    pa.array(found if with_ids else [None] * len(found), pa.list_(pa.int32())),
                ], ["doc_id", "n_pieces", "n_byte_pieces", "piece_sha256", "decoded_sha256", "lossless", "piece_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean_batches(run), SCHEMA)


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, piece_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [None if ids is None else vocab.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_ids").mapInArrow(run, "doc_id long, text string")
