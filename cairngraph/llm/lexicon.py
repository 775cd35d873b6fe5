"""A minimal acyclic transducer from byte strings to lists of token ids, stored as flat arrays that are memory-mapped.

States with the same right language are one state, so suffixes are shared.  Each transition carries the number of
accepted strings that sort before its branch; their sum along a path is the string's rank, which points into a pool
of token ids.  Look-ups run for a whole array of strings at once, one byte position at a time.
"""

from __future__ import annotations

import json

import numpy as np

from cairngraph.llm._text import mix64

_FIELDS = (("keys", np.int64), ("target", np.int32), ("output", np.int64), ("final", np.uint8), ("offset", np.int64), ("ids", np.int32))


def byte_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(uint8[n, longest], lengths), zero-padded."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    m = np.zeros((len(words), max(1, int(size.max(initial=0)))), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    m[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return m, size


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of the entries; the empty string can't be one."""
    words = sorted(w for w in entries if w)
    m, size = byte_matrix(words)
    n, longest = m.shape
    lcp = np.zeros(n, np.int64)
    if n > 1:
        same = (m[1:] == m[:-1]) & (np.arange(longest) < np.minimum(size[1:], size[:-1])[:, None])
        lcp[1:] = np.where(same.all(1), longest, (~same).argmax(1))
    # the trie, level by level: a word makes a node for each prefix that it doesn't share with the word before it
    parent, label, level_of = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    final = [np.zeros(1, bool)]
    makers, first, total = np.zeros(1, np.int64), 0, 1
    for d in range(1, longest + 1):
        own = np.flatnonzero((lcp < d) & (size >= d))
        if not len(own):
            break
        parent.append(first + np.searchsorted(makers, own, "right") - 1)
        label.append(m[own, d - 1].astype(np.int64))
        level_of.append(np.full(len(own), d))
        final.append(size[own] == d)
        makers, first, total = own, total, total + len(own)
    up, lab, depth, fin = map(np.concatenate, (parent, label, level_of, final))
    height = np.zeros(total, np.int64)
    for d in range(int(depth.max()), 0, -1):
        at = np.flatnonzero(depth == d)
        np.maximum.at(height, up[at], height[at] + 1)
    # merge states of the same height whose finality and transitions agree
    signature = fin.astype(np.uint64)
    state = np.zeros(total, np.int64)
    keep: list[np.ndarray] = []
    states = 0
    for h in range(int(height.max()) + 1):
        at = np.flatnonzero(height == h)
        _, where, inverse = np.unique(signature[at], return_index=True, return_inverse=True)
        state[at] = states + inverse
        keep.append(at[where])
        states += len(where)
        inner = at[at > 0]
        np.add.at(signature, up[inner], mix64((state[inner].astype(np.uint64) << np.uint64(9)) + lab[inner].astype(np.uint64) + np.uint64(1)))
    chosen = np.concatenate(keep)
    root = states - 1
    is_chosen = np.zeros(total, bool)
    is_chosen[chosen] = True
    edge = np.flatnonzero(is_chosen[up] & (np.arange(total) > 0))
    keys = state[up[edge]] * 256 + lab[edge]
    order = np.argsort(keys)
    keys, target = keys[order], state[edge[order]]
    accepting = fin[chosen].astype(np.int64)
    source = keys >> 8
    starts = np.searchsorted(source, np.arange(states + 1))
    count, output = accepting.copy(), np.zeros(len(keys), np.int64)
    for s in range(states):  # targets have smaller numbers
        a, b = starts[s], starts[s + 1]
        if b > a:
            c = count[target[a:b]]
            total_below = np.cumsum(c)
            output[a:b] = accepting[s] + total_below - c
            count[s] += total_below[-1]
    pool = [entries[w] for w in words]
    offset = np.cumsum([0, *map(len, pool)])
    arrays = {"keys": keys, "target": target, "output": output, "final": accepting, "offset": offset, "ids": np.array([x for p in pool for x in p])}
    head = {"root": int(root), "sizes": [len(arrays[k]) for k, _ in _FIELDS]}
    body = b"".join((data := arrays[k].astype(t).tobytes()) + b"\0" * (-len(data) % 8) for k, t in _FIELDS)
    return json.dumps(head).encode().ljust(256) + body


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        head = json.loads(bytes(whole[:256]))
        at = 256
        self.root = head["root"]
        for (name, kind), n in zip(_FIELDS, head["sizes"], strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, whole[at : at + size].view(kind))
            at += size + -size % 8

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each string among the entries, -1 if it is none."""
        m, size = byte_matrix(words)
        n = len(words)
        state, rank, result = np.full(n, self.root), np.zeros(n, np.int64), np.full(n, -1)
        alive = np.flatnonzero(size > 0)
        for d in range(m.shape[1]):
            key = state[alive] * 256 + m[alive, d]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[pos] == key
            alive, pos = alive[hit], pos[hit]
            state[alive] = self.target[pos]
            rank[alive] += self.output[pos]
            done = size[alive] == d + 1
            ended = alive[done]
            ended = ended[self.final[state[ended]] == 1]
            result[ended] = rank[ended]
            alive = alive[~done]
            if not len(alive):
                break
        return result

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.offset[rank] : self.offset[rank + 1]].tolist()
