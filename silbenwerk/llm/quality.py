"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of `PASSAGE` bytes, all of them, however long it is. A passage is
described by the shares of byte classes and byte pairs in it and encoded by a small tanh layer; a
gated attention layer (Ilse et al. 2018) weighs the passages of a bag, and a logistic unit scores
the weighted mean. The weights are learned jointly from document labels alone.

The model is fitted on at most `max_docs` labelled documents, those with the least hash of their
doc_id, outside the held-out remainder; only their passage vectors, at most `max_passages` spread
evenly over a document, come to the driver. Scoring reads every byte of every text where it lies:
no shuffle, and one narrow pass.

Defined results: null and empty texts are one empty passage and get a score like any other; rows
that repeat are scored alike; labels that are null count as missing, and of several labels for a
doc_id the largest holds; without labels of both kinds every score is 0.5; an empty table gives
an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc_mod

PASSAGE = 400
PAIR_BINS = 32
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_passages long"


def _classes() -> np.ndarray:
    """A class for each byte: kinds of letters, digits, white space, and each ASCII sign by itself."""
    out = np.zeros(256, np.int64)
    signs = 8
    for b in range(256):
        ch = chr(b)
        if b >= 0x80:
            out[b] = 1 if b < 0xC0 else 2
        elif ch.islower():
            out[b] = 3
        elif ch.isupper():
            out[b] = 4
        elif ch.isdigit():
            out[b] = 5
        elif ch in "\n\r":
            out[b] = 6
        elif b <= 0x20 or b == 0x7F:
            out[b] = 7
        else:
            out[b] = signs
            signs += 1
    return out


CLASS = _classes()
N_CLASS = int(CLASS.max()) + 1
N_FEATURES = N_CLASS + PAIR_BINS + 3


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of passages of every text, feature rows of all passages)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum(n) - n
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(first, sizes) + inside // PASSAGE
    total = int(n.sum())
    length = np.maximum(1, np.bincount(at, minlength=total))
    kinds = CLASS[data]
    share = np.bincount(at * N_CLASS + kinds, minlength=total * N_CLASS).reshape(total, N_CLASS)
    out = np.zeros((total, N_FEATURES), np.float32)
    out[:, :N_CLASS] = share / length[:, None]
    if len(data) > 1:
        same = at[1:] == at[:-1]
        pair = ((data[:-1].astype(np.int64) * 769 + data[1:].astype(np.int64) * 31) >> 3) % PAIR_BINS
        pairs = np.bincount((at[1:] * PAIR_BINS + pair)[same], minlength=total * PAIR_BINS).reshape(total, PAIR_BINS)
        out[:, N_CLASS:N_CLASS + PAIR_BINS] = pairs / length[:, None]
        out[:, -3] = np.bincount(at[1:][same & (data[1:] == data[:-1])], minlength=total) / length
        blank = (kinds == 6) | (kinds == 7)
        out[:, -2] = np.bincount(at[1:][same & blank[1:] & ~blank[:-1]], minlength=total) / length * 8
    out[:, -1] = np.log1p(np.repeat(sizes, n)) / 10
    return n, out


class AttentionModel:
    """x -> h = tanh(xA + a); weight = softmax of w·(tanh(hV) * sigmoid(hU)) in the bag; score = sigmoid(c·Σ weight h + b)."""

    def __init__(self, n_in: int, hidden: int = 16, gate: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"A": rng.normal(0, 1 / np.sqrt(n_in), (n_in, hidden)), "a": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)), "w": np.zeros(gate), "c": rng.normal(0, 0.3, hidden), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(n_in), np.ones(n_in)

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["A"] + p["a"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        g = t * s
        e = g @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        k = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(k[:, None] * h, first)
        return {"h": h, "t": t, "s": s, "g": g, "k": k, "z": z, "first": first, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["b"][0])))}

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, n)["y"]

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.02, decay: float = 1e-3) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        p, m, v = self.p, {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for i in range(1, rounds + 1):
            f = self.forward(x, n)
            h, t, s, k = f["h"], f["t"], f["s"], f["k"]
            d = (f["y"] - y) / len(y)
            dz = np.repeat(d, n)[:, None] * p["c"]
            dk = (dz * h).sum(1)
            de = k * (dk - np.repeat(np.add.reduceat(k * dk, f["first"]), n))
            dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
            dh = (k[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grad = {"A": x.T @ dh, "a": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": f["g"].T @ de, "c": f["z"].T @ d, "b": np.array([d.sum()])}
            for q in p:
                gq = grad[q] + decay * p[q] * (q not in "ab")
                m[q], v[q] = 0.9 * m[q] + 0.1 * gq, 0.999 * v[q] + 0.001 * gq * gq
                p[q] = p[q] - rate * (m[q] / (1 - 0.9**i)) / (np.sqrt(v[q] / (1 - 0.999**i)) + 1e-8)


def text_chunks(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        text = text.as_py() or b""
        if texts and size + len(text) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(key.as_py())
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_passages: int = 64, folds: int = 5, held: int = 0) -> AttentionModel | None:
    """None without labels of both kinds."""
    known = labels.where("quality is not null and doc_id is not null").where(crc_mod(F.col("doc_id"), folds) != held).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # a bounded table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = iter(batch.column(2).to_pylist())
            for ids, texts in text_chunks(batch):
                n, x = passages(texts)
                parts = [p[np.linspace(0, len(p) - 1, min(len(p), max_passages)).astype(int)] for p in np.split(x, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([next(label) for _ in ids], pa.int32()), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], ["doc_id", "y", "x"])

    got = sorted((r.doc_id, r.y, bytes(r.x)) for r in rows.mapInArrow(vectors, "doc_id long, y int, x binary").collect())
    if len({y for _, y, _ in got}) < 2:
        return None
    parts = [np.frombuffer(x, "<f4").reshape(-1, N_FEATURES) for _, _, x in got]
    model = AttentionModel(N_FEATURES)
    model.fit(np.concatenate(parts).astype(np.float64), np.array([len(p) for p in parts]), np.array([y for _, y, _ in got], float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages."""
    model = fit_quality(docs, labels, folds=folds, held=held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = iter(batch.column(2).to_pylist())
            for ids, texts in text_chunks(batch):
                n, x = passages(texts)
                score = np.full(len(ids), 0.5) if model is None else np.round(model.score(x.astype(np.float64), n), 9)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([next(out) for _ in ids], pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(n)], ["doc_id", "held_out", "score", "predicted", "n_passages"])

    held_out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out.alias("held_out")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    Null and empty texts are scored as texts without passages; rows that repeat are judged alike; an empty table gives an empty
    result. Without labels of both kinds there is no model, and all documents stay.
    """
    model = fit_quality(docs, labels)
    if model is None:
        return docs
    at, arrow = [docs.columns.index(c) for c in ("doc_id", "text")], to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(at[0]), batch.column(at[1]).cast(pa.binary())], ["doc_id", "text"])
            keep = []
            for _, texts in text_chunks(pair):
                n, x = passages(texts)
                keep.append(np.round(model.score(x.astype(np.float64), n), 9) >= threshold)
            batch = batch.filter(pa.array(np.concatenate(keep), pa.bool_())) if keep else batch
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow)], schema=arrow)

    # plain names: Spark reads a dot in the names of what is mapped
    return docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).mapInArrow(run, docs.schema)
