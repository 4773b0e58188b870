"""A vocabulary of scored pieces, and tries over pre-tokens that hold forward scores at their nodes.

The vocabulary file of a public tokenizer gives the pieces and their order; it is read, never
trained. A piece's unigram probability follows its rank by Zipf's law. A character that is no
piece is spelled as its UTF-8 bytes, each with the probability of the last rank.
"""
from __future__ import annotations

import math
import os
from array import array
from functools import lru_cache

import numpy as np

DEFAULT_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        total = math.log(sum(1 / (r + 3) for r in range(len(ranked))))
        #: A blank stands for the word separator, so a literal separator sign is no piece.
        self.ids = {sp.id_to_piece(i).replace(SPACE, " "): i for i in plain if sp.id_to_piece(i)}
        logp = {i: -math.log(r + 3) - total for r, i in enumerate(ranked)}
        self.pieces = {p: (i, logp[i]) for p, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_logp = -math.log(len(ranked) + 3) - total
        #: Ends of pieces, () where they are none themselves: a candidate grows to the left only
        #: while it still is the end of some piece.
        self.ends: dict[str, tuple] = {p[k:]: () for p in self.ids for k in range(len(p))}
        self.ends.update(self.pieces)
        self.longest = max(map(len, self.pieces))
        self._table = None
        self.texts: dict[int, bytes] = {i: p.encode() for p, i in self.ids.items()}
        self.texts.update({i: bytes([b]) for b, i in enumerate(self.byte_ids)})

    def ends_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all ends of pieces, ascending, with the piece (-1: none) and its log-probability."""
        if self._table is None:
            with np.errstate(over="ignore"):
                rows = []
                for end, hit in self.ends.items():
                    run, _ = running_hash(np.array([ord(c) for c in end], np.uint64))
                    rows.append((int(run[-1] + np.uint64(len(end))), *(hit or (-1, 0.0))))
            rows.sort()
            self._table = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        return self._table

    def decode(self, ids) -> str:
        """The exact text of a sequence of piece ids."""
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class CountTrie:
    """Best unigram score and its number of pieces for every prefix of the pre-tokens inserted.

    A node stands for a prefix; its score is computed once, when the first pre-token that has the
    prefix is inserted, from the scores of the nodes above it. The count at a pre-token's last
    node is its number of tokens. `max_nodes` bounds the memory: a full trie is emptied.
    """

    def __init__(self, vocab: Vocabulary, max_nodes: int = 600_000):
        self.vocab, self.max_nodes = vocab, max_nodes
        self.clear()

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.score, self.count, self.spelled = array("d", [0.0]), array("i", [0]), array("i", [0])
        self.terminal: dict[bytes, tuple[int, int]] = {}

    def insert(self, token: str) -> int:
        following, score, count, spelled = self.next, self.score, self.count, self.spelled
        ends = self.vocab.ends
        node, path = 0, [0]
        for at, ch in enumerate(token, 1):
            child = following.get((node, ch))
            if child is None:
                best, n, b = -math.inf, 0, 0
                # spelling by bytes is open only where the character itself is no piece
                if not ends.get(ch):
                    k = len(ch.encode("utf-8", "surrogatepass"))
                    best, n, b = score[node] + k * self.vocab.byte_logp, count[node] + k, spelled[node] + k
                start = at - 1
                while start >= 0:
                    hit = ends.get(token[start:at])
                    if hit is None:
                        break
                    if hit:
                        up = path[start]
                        s = score[up] + hit[1]
                        if s > best or (s == best and count[up] + 1 < n):
                            best, n, b = s, count[up] + 1, spelled[up]
                    start -= 1
                child = len(score)
                following[(node, ch)] = child
                score.append(best)
                count.append(n)
                spelled.append(b)
            node = child
            path.append(node)
        return node

    def tokens(self, word: bytes) -> tuple[int, int]:
        """Number of tokens, and of byte tokens among them, of a pre-token (with its separator)."""
        out = self.terminal.get(word)
        if out is None:
            if len(self.score) > self.max_nodes:
                self.clear()
            node = self.insert(" " + word.decode("utf-8", "surrogatepass"))
            out = self.terminal[word] = (self.count[node], self.spelled[node])
        return out


class Lattice:
    """Forward-filtered lattices of many pre-tokens over one trie, built level by level as arrays.

    Node v stands for a prefix of some pre-tokens. Its edges (parent, piece) are the pieces that end
    there; `upto` holds v plus their cumulative shares of the mass that arrives, so that the array
    ascends over all nodes. piece < 0 spells the character -piece - 1 as bytes. Node 0 is the root.
    """

    def __init__(self, vocab: Vocabulary, theta: float, tokens: list[str]):
        sizes = np.array([len(t) for t in tokens], np.int64)
        order = np.argsort(-sizes, kind="stable")
        chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        run, down = running_hash(chars)
        start = (np.cumsum(sizes) - sizes)[order]
        alive = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")  # tokens of d and more characters
        keys, values, logps = vocab.ends_table()
        alpha, paths = [np.zeros(1)], [np.zeros(len(tokens), np.int64)]
        parents, pieces, upto, total = [], [], [], 1
        self.node = np.zeros(len(tokens), np.int64)
        scores = np.zeros(1)
        for depth, k in enumerate(alive.tolist(), 1):
            end = start[:k] + depth
            ch = chars[end - 1].astype(np.int64)
            _, first, which = np.unique(paths[depth - 1][:k] << 21 | ch, return_index=True, return_inverse=True)
            n = len(first)
            at, ups, ids, masses = end[first], [], [], []
            live = np.arange(n)
            for length in range(1, min(depth, vocab.longest) + 1):
                h = (run[at[live]] - run[at[live] - length]) * down[at[live] - length] + np.uint64(length)
                spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found = keys[spot] == h
                up = paths[depth - length][first[live]]
                value, mass, parent = np.full(n, NONE), np.full(n, -np.inf), np.zeros(n, np.int64)
                hit = found & (values[spot] >= 0)
                if length == 1:
                    # spelling by bytes is open only where the character itself is no piece
                    c = ch[first]
                    width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                    value, mass, parent = -c - 1, scores[up] + theta * vocab.byte_logp * width, up.copy()
                own = live[hit]
                value[own], parent[own] = values[spot[hit]], up[hit]
                mass[own] = scores[up[hit]] + theta * logps[spot[hit]]
                ups.append(parent), ids.append(value), masses.append(mass)
                live = live[found]
                if not len(live):
                    break
            mass = np.stack(masses, 1)
            top = mass.max(1)
            share = np.exp(mass - top[:, None])
            scores = np.append(scores, top + np.log(share.sum(1)))
            part = np.cumsum(share, 1) / share.sum(1)[:, None]
            there = mass > -np.inf
            last = there.shape[1] - 1 - np.argmax(there[:, ::-1], 1)
            part[np.arange(n), last] = 1.0
            new = total + np.arange(n)
            upto.append((np.minimum(part, 1.0) + new[:, None])[there])
            parents.append(np.stack(ups, 1)[there])
            pieces.append(np.stack(ids, 1)[there])
            paths.append(new[which])
            total += n
        for depth, k in enumerate(alive.tolist(), 1):
            self.node[order[:k]] = paths[depth][:k]
        none = np.zeros(0, np.int64)
        self.parent = np.concatenate(parents) if parents else none
        self.piece = np.concatenate(pieces) if pieces else none
        self.upto = np.concatenate(upto) if upto else np.zeros(0)


NONE = np.iinfo(np.int64).min
BASE = 0x9E3779B97F4A7C15


def running_hash(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of chars times powers, and inverse powers, modulo 2**64: hashes of all substrings."""
    from .shingles import powers

    up, down = powers(len(chars) + 1)
    run = np.zeros(len(chars) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((chars + np.uint64(1)) * up[:len(chars)], out=run[1:])
    return run, down
