"""Toxicity: a linear-chain conditional random field tags toxic words; documents follow from its marginals.

Documents are labelled, not words, so labelled tokens are derived first: a feature of words (the
whole lower-cased word, or its beginning) that is far more frequent in toxic than in other
training documents marks the words that have it, in toxic documents only. On these tokens a
two-state chain is trained by gradient ascent on its likelihood; forward-backward gives each
token's probability of being toxic. A document's score is a logistic function of its largest
marginal, their sum, and its length; tokens above one half form the offending spans.

Fitted on at most `max_docs` labelled documents of each kind with at most `max_chars` characters,
those with the least hash of their doc_id, outside the held-out remainder. Scoring reads every
whole text where it lies, without a shuffle.

Defined results: null and empty texts have no tokens and are scored by the document layer alone;
rows that repeat are scored alike; null labels count as missing, and of several labels for a
doc_id the largest holds; without labels of both kinds every score is 0; an empty table gives an
empty result; other columns are ignored.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

TOKEN = re.compile(r"\S+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
HEADS = (3, 4, 5, 6)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_toxic_tokens long, spans array<struct<start:int,end:int>>"


def features(token: str) -> list[str]:
    word = EDGE.sub("", token)
    if not word:
        return []
    return ["=" + word] + ["^" + word[:k] for k in HEADS if len(word) > k]


def time_major(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts the t-th tokens of all sequences side by side, longest sequence first; how many each t has."""
    rank = np.argsort(-sizes, kind="stable")
    start = np.cumsum(sizes) - sizes
    steps = int(sizes.max(initial=0))
    alive = np.searchsorted(np.sort(-sizes), -np.arange(steps), "left")  # sequences longer than t
    place = np.concatenate([start[rank[:k]] + t for t, k in enumerate(alive.tolist())]) if steps else np.zeros(0, np.int64)
    return place, alive


class Chain:
    """Two states, 0 and toxic: emission log-odds per token, transition log-weights, and a start log-odds."""

    def __init__(self):
        self.trans, self.start = np.zeros((2, 2)), 0.0

    def marginals(self, emission: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of every token, and the expected number of each transition."""
        place, alive = time_major(sizes)
        if not len(place):
            return np.zeros(0), np.zeros((2, 2))
        w = np.exp(self.trans)
        e = emission[place]
        ends = np.cumsum(alive)
        forward, backward, scale = np.empty((len(e), 2)), np.ones((len(e), 2)), 1.0
        lift = np.stack([np.ones(len(e)), np.exp(np.clip(e, -30, 30))], 1)
        prior = np.array([1.0, np.exp(self.start)])
        for t, k in enumerate(alive.tolist()):
            lo = ends[t] - k
            before = prior[None, :] if t == 0 else forward[ends[t - 1] - alive[t - 1]:][:k] @ w
            f = before * lift[lo:lo + k]
            forward[lo:lo + k] = f / f.sum(1, keepdims=True)
        for t in range(len(alive) - 1, 0, -1):
            k, lo, up = alive[t], ends[t] - alive[t], ends[t - 1] - alive[t - 1]
            b = (lift[lo:lo + k] * backward[lo:lo + k]) @ w.T
            backward[up:up + k] = b / b.sum(1, keepdims=True)
        both = forward * backward
        gamma = both / both.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(1, len(alive)):
            k, lo, up = alive[t], ends[t] - alive[t], ends[t - 1] - alive[t - 1]
            joint = forward[up:up + k, :, None] * w[None] * (lift[lo:lo + k] * backward[lo:lo + k])[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        out = np.empty(len(e))
        out[place] = gamma[:, 1]
        return out, expected


def document_inputs(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, p, len(sizes))
    most = np.zeros(len(sizes))
    np.maximum.at(most, owner, p)
    return np.stack([np.ones(len(sizes)), most, np.log1p(total * 4), np.log1p(1000 * total / np.maximum(sizes, 20)), np.log1p(sizes)], 1)


class ToxicityModel:
    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias, self.chain, self.doc = 0.0, Chain(), np.zeros(5)
        self.mean, self.scale = np.zeros(5), np.ones(5)
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emission(self, token: str) -> float:
        out = self.known.get(token)
        if out is None:
            if len(self.known) > 300_000:
                self.known.clear()
            out = self.known[token] = self.bias + sum(self.weights.get(f, 0.0) for f in features(token))
        return out

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [TOKEN.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(x) for x in tokens], np.int64)
        of = self.emission
        return self.chain.marginals(np.array([of(w) for x in tokens for w in x], float), sizes)[0], sizes

    def score(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-((document_inputs(p, sizes) - self.mean) / self.scale) @ self.doc))

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray, max_features: int = 20_000, rounds: int = 30) -> None:
        tokens = [TOKEN.findall(t.lower()) for t in texts]
        toxic, other = Counter(), Counter()
        for x, label in sorted(zip(tokens, y), key=lambda p: -p[1]):
            own = {f for w in set(x) for f in features(w)}
            if label:
                toxic.update(own)
            else:  # only features of toxic documents can become a weight
                other.update(f for f in own if f in toxic)
        n1, n0 = float((y == 1).sum()), float((y == 0).sum())
        odds = {}
        for f, a in toxic.items():
            b = other.get(f, 0)
            if a >= 4:
                lo = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
                odds[f] = (lo / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), lo)
        chosen = sorted((f for f, (z, lo) in odds.items() if z > 2.5 and lo > 0.7), key=lambda f: (-odds[f][0], f))[:max_features]
        seeds = {f for f in chosen if odds[f][0] > 3.5 and odds[f][1] > 1.2}
        index = {f: i for i, f in enumerate(chosen)}
        words: dict[str, int] = {}
        ids = np.array([words.setdefault(w, len(words)) for x in tokens for w in x], np.int64)
        own = [[index[f] for f in features(w) if f in index] for w in words]
        marked = np.array([any(chosen[i] in seeds for i in x) for x in own])
        row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        col = np.array([i for x in own for i in x], np.int64)
        sizes = np.array([len(x) for x in tokens], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        gold = (marked[ids] & (y[owner] == 1)).astype(float)
        follows = np.zeros(len(ids), bool)
        follows[1:] = owner[1:] == owner[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:-1][follows[1:]].astype(int), gold[1:][follows[1:]].astype(int)), 1)
        theta, bias = np.array([0.5 * odds[f][1] for f in chosen]), -4.0
        acc, acc_b, acc_t = np.full(len(chosen), 1e-8), 1e-8, np.full((2, 2), 1e-8)
        for _ in range(rounds):
            score = np.full(len(words), bias)
            np.add.at(score, row, theta[col])
            p, expected = self.chain.marginals(score[ids], sizes)
            g = np.bincount(ids, gold - p, len(words))
            gt = np.bincount(col, g[row], len(chosen)) - 0.3 * theta if len(chosen) else theta
            gb, gm = float(g.sum()), seen - expected
            acc, acc_b, acc_t = acc + gt * gt, acc_b + gb * gb, acc_t + gm * gm
            theta, bias = theta + 0.4 * gt / np.sqrt(acc), bias + 0.4 * gb / np.sqrt(acc_b)
            self.chain.trans = self.chain.trans + 0.2 * gm / np.sqrt(acc_t)
        self.weights, self.bias = dict(zip(chosen, np.round(theta, 6).tolist())), float(np.round(bias, 6))
        self.chain.trans = np.round(self.chain.trans, 6)
        score = np.full(len(words), self.bias)
        np.add.at(score, row, theta[col])
        p, _ = self.chain.marginals(score[ids], sizes)
        x = document_inputs(p, sizes)
        self.mean[1:], self.scale[1:] = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-6
        x = (x - self.mean) / self.scale
        for _ in range(25):  # Newton steps
            q = 1 / (1 + np.exp(-x @ self.doc))
            h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(5)
            self.doc = self.doc + np.linalg.solve(h, x.T @ (weight * (y - q)) - 0.05 * self.doc)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_chars: int = 6_000, folds: int = 4, held: int = 2) -> ToxicityModel | None:
    """None without labels of both kinds."""
    known = labels.where("toxic is not null and doc_id is not null").where(crc_mod(F.col("doc_id"), folds) != held).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):
        return None
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("y = 1").orderBy(*order).limit(max_docs).union(known.where("y = 0").orderBy(*order).limit(2 * max_docs))  # a bounded table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= max_chars).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
    got = sorted((r.doc_id, r.text, r.y) for r in rows.collect())
    y = np.array([r[2] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    model = ToxicityModel()
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    model.fit([r[1] for r in got], y, weight / weight.mean())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_toxic_tokens, spans."""
    model = fit_toxicity(docs, labels, folds=folds, held=held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pieces import chunks

        for batch in batches:
            out = iter(batch.column(2).to_pylist())
            for ids, texts in chunks(batch, 3_000_000):
                if model is None:
                    score, hot, spans = np.zeros(len(ids)), [0] * len(ids), [[] for _ in ids]
                else:
                    p, sizes = model.tag(texts)
                    score, spans, hot = np.round(model.score(p, sizes), 9), [], []
                    for text, own in zip(texts, np.split(p, np.cumsum(sizes)[:-1])):
                        bad = set(np.flatnonzero(own >= 0.5).tolist())
                        hot.append(len(bad))
                        spans.append([{"start": m.start(), "end": m.end()} for i, m in enumerate(TOKEN.finditer(text)) if i in bad] if bad else [])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([next(out) for _ in ids], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)),
                    pa.array(hot, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ], ["doc_id", "held_out", "score", "predicted", "n_toxic_tokens", "spans"])

    held_out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")).mapInArrow(run, SCHEMA)
