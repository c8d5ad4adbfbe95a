"""A lexicon of words with ids, as a minimal acyclic transducer in one file that workers map into memory.

States with the same continuations are one state, so suffixes are shared. Every arc carries a number; the sum of the numbers along a word's path is the word's rank among
the words, by which its ids are found. The file holds flat arrays; workers of one machine that map it share its pages. All words of a
batch walk it together, one byte at a time.
"""

from __future__ import annotations

import mmap

import numpy as np

from dossier.llm.textarrays import U, mix

_ARRAYS = (("arc", np.uint32), ("to", np.int32), ("skip", np.int32), ("final", np.uint8), ("cut", np.int64), ("ids", np.int32))
_END = 0x9E3779B97F4A7C15


def compiled(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file's content. ``words``: distinct, not empty, in byte order.

    Arrays: ``arc`` (state and byte, ascending), ``to`` and ``skip`` (its target and number), ``final`` (of states), ``cut`` and ``ids`` (of words). State 0 is the start.
    """
    m = len(words)
    length = np.fromiter(map(len, words), np.int64, m)
    top = int(length.max()) if m else 0
    text = np.zeros((m, top + 1), np.int32)  # a byte is itself plus one, so that 0 is the end
    flat, at = np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(m), length)
    text[at, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat.astype(np.int32) + 1
    # The trie: node k of depth d is the k-th distinct prefix of d bytes. Words are sorted, so a prefix is new where it differs from the word before.
    new = np.ones(m, bool)
    new[1:] = False
    node, depths = np.zeros(m, np.int64), []  # of each depth: parent, byte and number of its nodes
    for d in range(top):
        change = np.zeros(m, bool)
        change[1:] = text[1:, d] != text[:-1, d]
        if m:
            new[0] = True
        new |= change
        here = new & (text[:, d] > 0)
        i = np.flatnonzero(here)
        depths.append((node[i], text[i, d] - 1))
        node = np.cumsum(here) - 1
    counts = [1, *[len(p) for p, _ in depths]]
    ends = [np.zeros(c, bool) for c in counts]
    node = np.zeros(m, np.int64)
    for d in range(top + 1):
        if d:
            parent, byte = depths[d - 1]
            key = parent * 256 + byte
            alive = length >= d
            node[alive] = np.searchsorted(key, node[alive] * 256 + text[alive, d - 1] - 1)
        ends[d][node[length == d]] = True
    # From the deepest nodes up: a signature of each node's continuations, and how many words continue it. Nodes of one signature are one state.
    sign = [(e.astype(U) + U(1)) * U(_END) for e in ends]
    below = [e.astype(np.int64) for e in ends]
    for d in range(top, 0, -1):
        parent, byte = depths[d - 1]
        sign[d] = mix(sign[d])
        np.add.at(sign[d - 1], parent, mix(sign[d] ^ (byte.astype(U) + U(1)) * U(_END)))
        np.add.at(below[d - 1], parent, below[d])
    sign[0] = mix(sign[0])
    everything = np.concatenate(sign)
    _, first, state = np.unique(everything, return_index=True, return_inverse=True)
    swap = np.arange(len(first))
    swap[[0, state[0]]] = swap[[state[0], 0]]  # the start is state 0
    state = swap[state]
    base = np.concatenate([[0], np.cumsum(counts)])
    chosen = np.zeros(len(everything), bool)
    chosen[first] = True
    arcs = []
    for d in range(top):
        parent, byte = depths[d]
        own = base[d] + parent
        skip = np.cumsum(below[d + 1]) - below[d + 1]
        lead = np.zeros(counts[d], np.int64)
        heads = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
        lead[parent[heads]] = skip[heads]
        skip = skip - lead[parent] + ends[d][parent]
        use = chosen[own]
        arcs.append(np.stack([state[own[use]] * 256 + byte[use], state[base[d + 1] :][: counts[d + 1]][use], skip[use]]))
    arc = np.concatenate(arcs, axis=1) if arcs else np.zeros((3, 0), np.int64)
    arc = arc[:, np.argsort(arc[0])]
    final = np.zeros(len(first), np.uint8)
    final[state[np.flatnonzero(chosen)]] = np.concatenate(ends)[chosen]
    n = np.fromiter(map(len, ids), np.int64, m)
    made = dict(arc=arc[0], to=arc[1], skip=arc[2], final=final, cut=np.concatenate([[0], np.cumsum(n)]), ids=np.fromiter((i for x in ids for i in x), np.int32, int(n.sum())))
    parts = [np.array([len(made[name]) for name, _ in _ARRAYS], np.int64).tobytes()]
    for name, kind in _ARRAYS:
        raw = made[name].astype(kind).tobytes()
        parts.append(raw + bytes(-len(raw) % 8))
    out = b"".join(parts)
    # Signatures are hashes: a walk over every word proves that the automaton holds the words, each with its rank, and no others.
    cuts = np.cumsum(length)
    if m and (int(below[0][0]) != m or (Lexicon(out).ranks(flat, cuts - length, cuts) != np.arange(m)).any()):
        raise ValueError("two states of the lexicon share a signature")
    return out


class Lexicon:
    """A compiled lexicon, from its content or mapped from its file."""

    def __init__(self, content: bytes | mmap.mmap):
        size, at = np.frombuffer(content, np.int64, len(_ARRAYS)).tolist(), 8 * len(_ARRAYS)
        arrays = {}
        for (name, kind), n in zip(_ARRAYS, size, strict=True):
            arrays[name] = np.frombuffer(content, kind, n, at)
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        self.arc, self.to, self.skip, self.final, self.cut, self.ids = (arrays[name] for name, _ in _ARRAYS)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The rank of each byte span among the words, -1 for a span that isn't one."""
        out = np.full(len(s), -1, np.int64)
        i = np.flatnonzero(e > s)
        if not len(self.arc):
            return out
        i = i[np.argsort(s[i] - e[i], kind="stable")]  # longest first: those with a k-th byte are a prefix
        left, at = (e - s)[i], s[i].copy()
        state, rank = np.zeros(len(i), np.uint32), np.zeros(len(i), np.int64)
        while len(i):
            key = (state << np.uint32(8)) | data[at]
            arc = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[arc] == key
            arc, i, left, at = arc[ok], i[ok], left[ok] - 1, at[ok] + 1
            state, rank = self.to[arc].astype(np.uint32), rank[ok] + self.skip[arc]
            done = int(np.searchsorted(-left, 0, side="left"))  # those from here on have no byte left
            out[i[done:]] = np.where(self.final[state[done:]] == 1, rank[done:], -1)
            i, left, at, state, rank = i[:done], left[:done], at[:done], state[:done], rank[:done]
        return out
