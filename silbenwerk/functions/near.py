"""K1 and M3: restricted distances of many pairs, and the pairs of two lists that lie within a distance.

The table of distances is kept as bits of one machine word for each pair (Hyyrö's recurrence), so a letter of
the meant word costs some operations on arrays, however long the typed word is. Typed words beyond 63
letters go through the plain table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .distance import letters

MOST_BITS, TILE, PAIRS = 63, 1 << 19, 1 << 14


def restricted(a: list[str], b: list[str], blind_first: bool = False) -> np.ndarray:
    """Restricted Damerau-Levenshtein distances of many pairs at once, cell by cell."""
    la, lb = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    x, y = letters(a, -1), letters(b, -2)
    m, n = x.shape[1], y.shape[1]
    lx, ly = x, y
    if blind_first:
        # the first letter in either case; only its lower-cased form is needed
        lx, ly = x.copy(), y.copy()
        for low, words in ((lx, a), (ly, b)):
            if low.shape[1]:
                low[:, 0] = [ord(w[0].lower()[0]) if w else -3 for w in words]
    table = np.zeros((m + 1, n + 1, len(a)), np.int16)
    table[:, 0] = np.arange(m + 1)[:, None]
    table[0] = np.arange(n + 1)[:, None]

    def same(i: int, j: int, free: bool) -> np.ndarray:
        if not (blind_first and free):
            return x[:, i] == y[:, j]
        # the typed word's first letter against a place of the other word
        other = ly[:, 0] if j == 0 else np.array([ord(w[j].lower()[0]) if len(w) > j else -4 for w in b])
        return (x[:, i] == y[:, j]) | (lx[:, i] == other)

    for i in range(1, m + 1):
        for j in range(1, n + 1):
            v = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + ~same(i - 1, j - 1, i == 1))
            if i > 1 and j > 1:
                swap = same(i - 1, j - 2, False) & same(i - 2, j - 1, i == 2)
                v = np.where(swap, np.minimum(v, table[i - 2, j - 2] + 1), v)
            table[i, j] = v
    return table[la, lb, np.arange(len(a))]


def _folded(points: np.ndarray) -> np.ndarray:
    """The first sign of each letter's lower-cased form: never more of them than letters."""
    known, at = np.unique(points, return_inverse=True)
    return np.array([ord(chr(c).lower()[0]) if c >= 0 else c for c in known.tolist()], points.dtype)[at].reshape(points.shape)


def _bags(points: np.ndarray) -> np.ndarray:
    """Bits of the letters that a word holds once and twice: an edit sets one of them and clears one at the most."""
    out = np.zeros(len(points), np.uint64)
    for column in points.T:
        bit = np.where(column >= 0, np.uint64(1) << (column % 32).astype(np.uint64), np.uint64(0))
        out |= np.where(out & bit != 0, bit << np.uint64(32), bit)
    return out


def _places(points: np.ndarray, alphabet: np.ndarray, blind_first: bool, kind: type) -> np.ndarray:
    """For each word and letter of the alphabet, the bits of the word's places that hold it."""
    out = np.zeros((len(points), len(alphabet)), kind)
    if not len(alphabet):
        return out
    rows = np.arange(len(points))
    for i, column in enumerate(points.T):
        code = np.minimum(np.searchsorted(alphabet, column), len(alphabet) - 1)
        hit = alphabet[code] == column
        out[rows[hit], code[hit]] |= kind(1 << i)
    if blind_first and points.shape[1]:
        out[_folded(points[:, :1]) == _folded(alphabet)[None]] |= kind(1)
    return out


def _by_bits(places: np.ndarray, rows: np.ndarray, codes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of pairs: typed words as rows of places with m letters, meant words (all of one length) as codes."""
    kind = places.dtype.type
    flat, start = places.ravel(), rows.astype(np.int64) * places.shape[1]
    one, last = kind(1), kind(1) << (m - 1).astype(kind)
    vp, vn, d0, old = np.full(len(rows), ~kind(0)), np.zeros(len(rows), kind), np.zeros(len(rows), kind), np.zeros(len(rows), kind)
    score = m.astype(np.int32)
    for column in codes.T:
        pm = flat[start + column]
        swap = ((~d0 & pm) << one) & old
        d0 = (((pm & vp) + vp) ^ vp) | pm | vn | swap
        hp, hn = vn | ~(d0 | vp), d0 & vp
        score += (hp & last) != 0
        score -= (hn & last) != 0
        hp, hn = (hp << one) | one, hn << one
        vp, vn, old = hn | ~(d0 | hp), hp & d0, pm
    return score


def distances(a: list[str], b: list[str], blind_first: bool = False) -> np.ndarray:
    """Restricted Damerau-Levenshtein distances of the pairs; blind_first: the typed word's first letter in either case."""
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.where(la == 0, lb, 0)
    long_ = np.flatnonzero(la > MOST_BITS)
    for lo in range(0, len(long_), 1024):
        part = sorted(long_.tolist(), key=lambda k: (la[k], lb[k]))[lo:lo + 1024]
        out[part] = restricted([a[k] for k in part], [b[k] for k in part], blind_first)
    todo = np.flatnonzero((la > 0) & (la <= MOST_BITS))
    todo = todo[np.lexsort((la[todo], lb[todo]))]
    ends = np.flatnonzero(np.diff(lb[todo])) + 1
    for group in np.split(todo, ends):
        for lo in range(0, len(group), PAIRS):
            part = group[lo:lo + PAIRS]
            typed, rows = np.unique(np.array([a[k] for k in part], object), return_inverse=True)
            y = letters([b[k] for k in part], -2)
            alphabet, codes = np.unique(y, return_inverse=True)
            kind = np.uint32 if la[part].max() < 32 else np.uint64
            step = max(1, (1 << 22) // max(1, len(alphabet)))  # words at a time, so that their places stay small
            x = letters(typed.tolist(), -1)
            codes = codes.reshape(y.shape)
            for at in range(0, len(typed), step):
                own = np.flatnonzero((rows >= at) & (rows < at + step))
                out[part[own]] = _by_bits(_places(x[at:at + step], alphabet, blind_first, kind), rows[own] - at, codes[own], la[part[own]])
    return out


def near_pairs(typed: list[str], meant: list[str], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both lists and distance of all pairs within d, the typed word's first letter in either case; all pairs of a typed word come in one turn.

    Words of like lengths are compared in tiles: bags of letters first, what they leave exactly.
    """
    m_all, n_all = (np.array([len(w) for w in words], np.int64) for words in (typed, meant))
    alphabet = np.array(sorted({ord(c) for c in set().union(*meant)}), np.int32)
    groups = {}
    for n in np.unique(n_all).tolist():
        at = np.flatnonzero(n_all == n)
        points = letters([meant[k] for k in at], -2)
        groups[n] = at, _bags(_folded(points)), np.searchsorted(alphabet, points)
    for m in np.unique(m_all).tolist():
        reach = [n for n in range(max(0, m - d), m + d + 1) if n in groups]
        if not reach:
            continue
        mine = np.flatnonzero(m_all == m)
        step = max(1, min(1 << 12, (1 << 22) // max(1, len(alphabet))))  # words at a time, so that their places stay small
        tile = max(1, TILE // max(len(groups[n][0]) for n in reach))
        for lo in range(0, len(mine), step):
            own = mine[lo:lo + step]
            words = [typed[k] for k in own]
            points = letters(words, -1)
            bags = _bags(_folded(points))
            places = _places(points, alphabet, True, np.uint32 if m < 32 else np.uint64) if 0 < m <= MOST_BITS else None
            for top in range(0, len(own), tile):
                found = []
                for n in reach:
                    at, theirs, codes = groups[n]
                    # s letters differ where the lengths differ by e and s + e edits are allowed: 2 s + e bits
                    near = np.bitwise_count(bags[top:top + tile, None] ^ theirs[None]) <= 2 * d - abs(m - n)
                    rows, cands = np.divmod(np.flatnonzero(near), len(at))
                    rows += top
                    if places is None:
                        dist = restricted([words[k] for k in rows], [meant[k] for k in at[cands]], True) if m else np.full(len(rows), n)
                    else:
                        dist = np.concatenate([np.zeros(0, np.int32), *(_by_bits(places, rows[k:k + PAIRS], codes[cands[k:k + PAIRS]], np.full(len(rows[k:k + PAIRS]), m)) for k in range(0, len(rows), PAIRS))])
                    good = dist <= d
                    found.append((own[rows[good]], at[cands[good]], dist[good]))
                yield tuple(np.concatenate(x) for x in zip(*found))
