"""M2: the weighted distance of many pairs at once, and with it M7: what two words share at their ends.

Pairs of like lengths form a block. What a letter costs that is missing, too many or another one is
set down for the whole block first, as arrays; the table of distances is then pulled cell by cell
from the cells before it, for all pairs of the block together.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .. import constants as K

APART = 999.0  # words whose lengths differ by more than MOST_APART
MOST_APART, BLOCK = 3, 4096
HARD_SOFT = [ord(a) << 32 | ord(b) for a, b in K.HARD_SOFT]

_derived, _not_derived = re.compile(K.DERIVED), re.compile(K.NOT_DERIVED)


def _key_table() -> tuple[dict[int, int], np.ndarray]:
    """A number for each key, and what it costs to hit one key for another; number 0 is any other letter."""
    keys = [(ch, x0 + i, y) for y, (row, x0) in enumerate(K.KEY_ROWS) for i, ch in enumerate(row)]
    place = np.array([(x, y) for _, x, y in keys])
    far = np.sqrt(((place[:, None] - place[None]) ** 2).sum(-1))
    cost = np.ones((len(keys) + 1, len(keys) + 1))
    cost[1:, 1:] = np.where(far <= K.NEAR_KEY[0], K.NEAR_KEY[1], np.where(far <= K.DIAGONAL_KEY[0], K.DIAGONAL_KEY[1], 1.0))
    return {ord(ch): i + 1 for i, (ch, _, _) in enumerate(keys)}, cost


KEY_NUMBER, KEY_COST = _key_table()


def letters(words: list[str], fill: int) -> np.ndarray:
    """Code points of the words, one row each, filled up with a value that no letter has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), size.max(initial=0)), fill, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _neighbours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.full((len(x), 1), -9, np.int32)
    return np.hstack([edge, x[:, :-1]]), np.hstack([x[:, 1:], edge])


def _is(x: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(x, [ord(c) for c in chars])


def _silent(x: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An h after a vowel, neither first nor last."""
    return _is(x, "h") & _is(before, "aeiouäöü") & (np.arange(x.shape[1]) + 1 < size[:, None])


def _wants_link(word: str, at: int) -> bool:
    """Is the s at this place of the meant word one that its first part calls for?"""
    head = word[:at]
    return at >= 3 and len(word) - at > 3 and (head in K.LINK_S_STEMS or (_derived.search(head) is not None and _not_derived.search(head) is None))


def _too_many(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    before, after = _neighbours(x)
    return np.select([(x == before) | (x == after), _silent(x, before, size)], [K.DOUBLED, K.SILENT_TYPED], 1.0)


def _missing(y: np.ndarray, size: np.ndarray, words: list[str]) -> np.ndarray:
    before, after = _neighbours(y)
    link = np.zeros(y.shape, bool)
    known: dict[tuple[str, int], bool] = {}
    for i, j in zip(*(at.tolist() for at in np.nonzero(_is(y, "s")))):
        if j >= 3:
            key = words[i], j
            if key not in known:
                known[key] = _wants_link(*key)
            link[i, j] = known[key]
    schwa = _is(y, "e") & _is(before, "h") & _is(after, "n")
    return np.select([(y == before) | (y == after), link, _silent(y, before, size), schwa], [K.DOUBLED, K.LINK, K.SILENT_MEANT, K.SCHWA], 1.0)


def _another(x: np.ndarray, y: np.ndarray, typed: list[str], meant: list[str]) -> np.ndarray:
    """What it costs that the typed word has x[i] where y[j] is meant: i, j, pairs."""
    known = np.zeros(int(max(x.max(initial=0), y.max(initial=0), *KEY_NUMBER)) + 1, np.int8)
    known[list(KEY_NUMBER)] = list(KEY_NUMBER.values())
    kx, ky = known[np.maximum(x, 0)], known[np.maximum(y, 0)]
    cost = KEY_COST[kx.T[:, None], ky.T[None]]
    cost[x.T[:, None] == y.T[None]] = 0.0
    m, n = (np.array([len(w) for w in words]) for words in (typed, meant))
    # a hard letter for a soft one at the end of a stem: both words go on alike behind it
    for ending in K.STEM_ENDINGS:
        rows = np.flatnonzero((m > len(ending)) & (n > len(ending)))
        for k, c in enumerate(ending):
            rows = rows[(x[rows, m[rows] - len(ending) + k] == ord(c)) & (y[rows, n[rows] - len(ending) + k] == ord(c))]
        i, j = m[rows] - len(ending) - 1, n[rows] - len(ending) - 1
        p, q = x[rows, i].astype(np.int64), y[rows, j].astype(np.int64)
        hard = np.isin(np.minimum(p, q) << 32 | np.maximum(p, q), HARD_SOFT)
        cost[i[hard], j[hard], rows[hard]] = K.HARDENED
    return cost


def _rewritten(x: np.ndarray, y: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, np.ndarray, float]]]:
    """For each cell, the rewrites that end there: letters of either word, which pairs, cost."""
    out: dict[tuple[int, int], list[tuple[int, int, np.ndarray, float]]] = {}

    columns, held = {"x": np.ascontiguousarray(x.T), "y": np.ascontiguousarray(y.T)}, {}

    def holds(side: str, c: str) -> np.ndarray:
        if (side, c) not in held:
            held[side, c] = columns[side] == ord(c)
        return held[side, c]

    def ends(side: str, part: str) -> dict[int, np.ndarray]:
        width = len(columns[side]) - len(part) + 1
        if width <= 0:
            return {}
        own = np.logical_and.reduce([holds(side, c)[k:k + width] for k, c in enumerate(part)])
        return {int(e) + len(part): own[e] for e in np.flatnonzero(own.any(axis=1))}

    for a, b, cost in K.REWRITES:
        left, right = ends("x", a), ends("y", b)
        for i, own in left.items():
            for j, other in right.items():
                rows = np.flatnonzero(own & other)
                if len(rows):
                    out.setdefault((i, j), []).append((len(a), len(b), rows, cost))
    return out


def weighted_block(typed: list[str], meant: list[str]) -> np.ndarray:
    """Distances of the pairs of one block of lower-cased words."""
    m, n = (np.array([len(w) for w in words]) for words in (typed, meant))
    x, y = letters(typed, -1), letters(meant, -2)
    drop, add = (np.ascontiguousarray(c.T) for c in (_too_many(x, m), _missing(y, n, meant)))
    other, rules = _another(x, y, typed, meant), _rewritten(x, y)
    table = np.full((x.shape[1] + 1, y.shape[1] + 1, len(typed)), np.inf)
    table[0, 0] = 0.0
    for i in range(x.shape[1] + 1):
        for j in range(y.shape[1] + 1):
            cell = table[i, j]
            if i:
                np.minimum(cell, table[i - 1, j] + drop[i - 1], out=cell)
            if j:
                np.minimum(cell, table[i, j - 1] + add[j - 1], out=cell)
            if i and j:
                np.minimum(cell, table[i - 1, j - 1] + other[i - 1, j - 1], out=cell)
            if i > 1 and j > 1:
                rows = np.flatnonzero((x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1]))
                cell[rows] = np.minimum(cell[rows], table[i - 2, j - 2, rows] + K.SWAPPED)
            for p, q, rows, cost in rules.get((i, j), ()):
                cell[rows] = np.minimum(cell[rows], table[i - p, j - q, rows] + cost)
    out = table[m, n, np.arange(len(typed))]
    out[np.abs(m - n) > MOST_APART] = APART
    return out


def weighted_pairs(typed: list[str], meant: list[str]) -> np.ndarray:
    """M2: the cheapest way from each typed to its meant word; 999 if lengths differ by more than 3."""
    a, b = [w.lower() for w in typed], [w.lower() for w in meant]
    out = np.zeros(len(a))
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    for lo in range(0, len(order), BLOCK):
        part = order[lo:lo + BLOCK]
        out[part] = weighted_block([a[k] for k in part], [b[k] for k in part])
    return out


@F.pandas_udf(DoubleType())
def weighted_distance(typed: pd.Series, meant: pd.Series) -> pd.Series:
    """M2 as a column; null where a word is null."""
    good = (typed.notna() & meant.notna()).to_numpy()
    out = np.full(len(typed), np.nan)
    if good.any():
        out[good] = weighted_pairs(typed[good].tolist(), meant[good].tolist())
    return pd.Series(out).astype("float64").where(good, None)


def shared_ends(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """M7: letters shared at the beginning (a first sound that is only written in another way counts 0.7) and at the end."""
    def heads(x: list[str], y: list[str]) -> np.ndarray:
        p, q = letters(x, -1), letters(y, -2)
        width = min(p.shape[1], q.shape[1])
        return np.cumprod(p[:, :width] == q[:, :width], axis=1).sum(1) if width else np.zeros(len(x), np.int64)

    head = heads(a, b).astype(float)
    apart = np.flatnonzero(head == 0)  # a first sound matters only where the first letters differ
    apart = apart[np.array([any(a[k].startswith(p) and b[k].startswith(q) for p, q in K.SOUNDS_ALIKE) for k in apart.tolist()], bool)]
    rest = heads([a[k][1:] for k in apart], [b[k][1:] for k in apart])
    head[apart] = np.where(rest >= 1, rest + 1 - 0.3, head[apart])
    return head, heads([w[::-1] for w in a], [w[::-1] for w in b]).astype(float)


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("m2", "prefix", "tail")]))
def pair_measures(typed: pd.Series, meant: pd.Series) -> pd.DataFrame:
    """M2 and both numbers of M7 for lower-cased words, which are not null."""
    a, b = typed.tolist(), meant.tolist()
    head, tail = shared_ends(a, b)
    return pd.DataFrame({"m2": weighted_pairs(a, b), "prefix": head, "tail": tail})
