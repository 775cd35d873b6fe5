"""Vectorised word, shingle and hash kernels over Arrow string columns.

A word is a maximal run of letters, marks and numbers (Unicode categories L, M, N) of the lower-cased text, but each
code point of a script that is written without blanks (ALONE) is a word of its own; everything else separates words:
blanks, punctuation and symbols of any script.  A null text has no words.  All kernels work on whole texts: a column is
cut into chunks of rows (never of text) so that the working set stays in cache.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 512 * 1024
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True
#: Ranges of code points of scripts without blanks: Thai, Lao, Myanmar, Khmer, Kana, Bopomofo, Han.
ALONE = ((0x0E01, 0x0E3A), (0x0E40, 0x0E4E), (0x0E81, 0x0ECE), (0x1000, 0x103F), (0x1050, 0x108F), (0x1780, 0x17D3), (0x3005, 0x3007), (0x3031, 0x3035), (0x3041, 0x3096), (0x3099, 0x309A), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x3105, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x323AF))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_P, _PINV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large_string array."""
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def row_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    _, off = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@cache
def _kinds() -> np.ndarray:
    """For each code point 0 (separates words), 1 (part of a word) or 2 (a word of its own)."""
    kind = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in ALONE:
        kind[a : b + 1] = 2
    return kind


def word_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each byte of UTF-8 ``data`` is a word's, first bytes of code points that are words, the bytes after them)."""
    n = len(data)
    inside = _WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    none = np.zeros(0, np.int64)
    if not len(lead):
        return inside, none, none
    first = data[lead]
    if first.max() < 0xE0 and lead[-1] + 1 < n:  # two bytes each, none of which is a word of its own
        part = _kinds()[(first & np.uint8(0x1F)).astype(np.int16) << 6 | data[lead + 1] & np.uint8(0x3F)] > 0
        inside[lead] = part
        inside[lead + 1] = part
        return inside, none, none
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = (first & (0x7F >> size)).astype(np.int64)
    for k in range(1, 4):
        more = np.flatnonzero((size > k) & (lead + k < n))
        point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
    kind = _kinds()[np.minimum(point, 0x10FFFF)]
    part = np.flatnonzero(kind)
    for k in range(4):
        at = lead[part[size[part] > k]] + k
        inside[at[at < n]] = True
    alone = np.flatnonzero(kind == 2)
    return inside, lead[alone], np.minimum(lead[alone] + size[alone], n)


def word_bounds(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of the words of UTF-8 ``data``; ``cut`` (one longer) marks where texts begin and end."""
    n = len(data)
    inside, first, after = word_bytes(data)
    begin, stop = inside.copy(), inside.copy()
    edge = ~inside[:-1] | cut[1:n]
    begin[1:] &= edge
    stop[:-1] &= ~inside[1:] | cut[1:n]
    if len(first):
        begin[first] = True
        stop[after - 1] = True
        before = first[first > 0] - 1
        stop[before] |= inside[before]
        after = after[after < n]
        begin[after] |= inside[after]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


class Words:
    """The words of some rows: ``row``, byte range ``start``/``end`` within ``base`` and 64-bit ``hash`` of each."""

    __slots__ = ("counts", "end", "first", "hash", "n_rows", "offsets", "row", "start")

    def __init__(self, column: pa.Array):
        raw, off = buffers(column)
        data = raw[off[0] : off[-1]]
        self.offsets = off - off[0]
        self.n_rows = len(column)
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        self.start, self.end = word_bounds(data, cut)
        up, down = _power_tables(n)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[:n], out=h[1:])
        self.hash = mix64((h[self.end] - h[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.n_rows), self.counts)


def cased_ranges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of one text in its own case; their number and order are those of the lower-cased text."""
    return word_bounds(np.frombuffer(text, np.uint8), np.zeros(len(text) + 1, bool))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words (first, end), from each first word's first to its last word's last byte."""
    raw = text.encode()
    start, end = cased_ranges(raw)
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = max(0, a), min(b, len(start))
        if a < b and start[a] >= at:
            out.append(raw[at : start[a]])
            at = int(end[b - 1])
        elif a < b:
            at = max(at, int(end[b - 1]))
    out.append(raw[at:])
    return b"".join(out).decode()


def has_words(text: str) -> bool:
    return bool(len(cased_ranges(text.encode())[0]))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of each k successive word hashes (len - k + 1 values)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix64(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle; a row of 1 to k-1 words has one shingle, all its words."""
    g = grams(words.hash, k)
    row = words.row[: len(g)]
    inside = row == words.row[k - 1 : k - 1 + len(g)] if len(g) else np.zeros(0, bool)
    g, row = g[inside], row[inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j, r in enumerate(short):
            h = words.hash[words.first[r] : words.first[r + 1]]
            extra[j] = grams(h, len(h))[0]
        g, row = np.concatenate([g, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    return g, row


def lower(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pc.utf8_lower(plain(column))
