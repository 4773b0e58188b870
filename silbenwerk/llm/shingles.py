"""Sets of word shingles as 64-bit hashes, computed with array operations over many texts at once."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .pieces import mix64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            ones = np.full(n, BASE, np.uint64)
            ones[:1] = 1
            back = np.full(n, INVERSE, np.uint64)
            back[:1] = 1
            up, down = np.cumprod(ones), np.cumprod(back)
        if n > 4_000_000:
            return up, down  # a single very long text: not kept
        _powers["up"], _powers["down"] = up, down
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of its text), in order."""
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    blank = BLANK[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
        words = mix64((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return words, np.searchsorted(np.cumsum(sizes), start, "right")


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(set size of every text, the sets' hashes one after the other, each set ascending)."""
    words, owner = word_hashes(texts)
    n = len(texts)
    counts = np.bincount(owner, minlength=n)
    with np.errstate(over="ignore"):
        factors = mix64(np.arange(1, k + 1, dtype=np.uint64) * BASE) | np.uint64(1)
        if len(words) >= k:
            whole = np.flatnonzero(owner[k - 1:] == owner[:len(owner) - k + 1])
            total = np.zeros(len(whole), np.uint64)
            for j in range(k):
                total += words[whole + j] * factors[j]
            hashes, docs = mix64(total), owner[whole]
        else:
            hashes, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            first = np.searchsorted(owner, few)
            own = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = counts[few] > j
                own[has] += words[first[has] + j] * factors[j]
            hashes = np.concatenate([hashes, mix64(own + counts[few].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))])
            docs = np.concatenate([docs, few])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return np.bincount(docs, minlength=n), hashes


def signatures(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every set, as two signed 64-bit sums of its mixed members."""
    with np.errstate(over="ignore"):
        ends = np.cumsum(sizes)
        out = []
        for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)):
            run = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(mix64(hashes ^ salt), out=run[1:])
            out.append(mix64(run[ends] - run[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def byte_chunks(batch: pa.RecordBatch, column: int = 1, most: int = 2_000_000, rows: int = 20_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of some rows at a time; a text that alone is longer makes a chunk of its own."""
    texts, first, size = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        text = text.as_py() or b""
        if texts and (size + len(text) > most or len(texts) == rows):
            yield first, texts
            texts, first, size = [], i, 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts
