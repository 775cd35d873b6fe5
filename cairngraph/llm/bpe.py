"""Byte-pair encoding and decoding with a minimal acyclic transducer of the corpus' frequent words.

Texts are split by the pattern of the rank files with array operations, each distinct piece of a chunk is looked up
once - in what the worker has met before, else in the memory-mapped transducer - and pieces that the lexicon lacks
are merged exactly.  Every text is decoded again; one that doesn't come back unchanged (equal 64-bit hashes of two
different pieces) is encoded anew without hashes.  No step shuffles texts.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm._shared import Scratch, local_file, publish, releasing, tune
from cairngraph.llm._text import buffers, mix64, plain, row_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in the transducer, the most frequent ones; the rest are merged. Bytes per chunk. Pieces a worker remembers, and counts before it passes them on.
LEXICON_WORDS, CHUNK, REMEMBER, COUNTED = 1 << 17, 1 << 18, 400_000, 100_000
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_cache: dict = {}


def _classes() -> np.ndarray:
    if "classes" not in _cache:
        table = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for name, k in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
            for m in regex.finditer(name + "+", every):
                table[ord(m[0][0]) : ord(m[0][-1]) + 1] = k
        table[0xD800:0xE000] = _OTHER
        _cache["classes"] = table
    return _cache["classes"]


def piece_starts(cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN begin in code points; ``rows`` holds the start of each text and the end."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cps]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    edge = first[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(edge)  # runs of one class
    run_end = np.r_[run[1:], n]
    run_kind = kind[run]
    last_of_text = first[run_end]
    start = edge
    # white space before another class: all but its last character is a piece; a last blank joins what follows
    ws = np.flatnonzero((run_kind == _SPACE) & ~last_of_text)
    tail = run_end[ws] - 1
    start[tail] = True
    blank = cps[tail] == 32
    start[run_end[ws][blank]] = False
    # contractions: an apostrophe that begins a piece, then the letters of one of the seven endings
    ap = run[(run_kind == _OTHER)]
    ap = ap[(cps[ap] == 39) & start[ap]]
    ap = ap[ap + 1 < n]
    ap = ap[~first[ap + 1]]
    one = np.isin(cps[ap + 1], [ord(c) for c in "stmd"])
    nxt = np.minimum(ap + 2, n - 1)
    pair = (ap + 2 < n) & ~first[nxt]
    two = pair & ~one & (((cps[ap + 1] == ord("r")) | (cps[ap + 1] == ord("v"))) & (cps[nxt] == ord("e")) | (cps[ap + 1] == ord("l")) & (cps[nxt] == ord("l")))
    for at, size in ((ap[one], 2), (ap[two], 3)):
        for k in range(1, size):
            start[at + k] = False
        end = at + size
        end = end[end < n]
        start[end] = True
        # a blank that opens a piece keeps opening it; white space after the ending was cut above
    return np.flatnonzero(start)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for k, v in self.rank.items():
            by_id[v] = k
        self.size = np.array([len(b) for b in by_id])
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece: of all neighbours the pair of lowest rank, leftmost first, merges until none is left."""
        rank = self.rank
        if piece in rank:
            return [rank[piece]]
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while ranks:
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 60)
        return [rank[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        rank, n = self.rank, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := rank.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if live[i] else n
            if j >= n or end[j] != stop:
                continue
            live[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a list of ids."""
        size = self.size[ids]
        jump = np.repeat(self.at[ids] - (np.cumsum(size) - size), size)
        return self.bytes[np.arange(len(jump)) + jump]


def vocabulary(path: str) -> Vocabulary:
    if ("vocabulary", path) not in _cache:
        _cache["vocabulary", path] = Vocabulary(path)
    return _cache["vocabulary", path]


def split(raw: bytes, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece starts, piece hashes, first piece of each row) of rows of UTF-8."""
    text = raw.decode("utf-8")
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        rows = offsets
    else:
        lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        rows = np.r_[0, lead][offsets]
    start = piece_starts(cps, rows)
    n = len(cps)
    if "powers" not in _cache or len(_cache["powers"][0]) <= n:
        _cache["powers"] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, CHUNK) + 1, b, np.uint64)]) for b in (_BASE, _BASE_INV)]
    up, down = _cache["powers"]
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((cps + np.uint64(1)) * up[:n], out=h[1:])
    end = np.r_[start[1:], n]
    hashes = mix64((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64)) if n else np.zeros(0, np.uint64)
    return text, start, hashes, np.searchsorted(start, rows)


class Encoder:
    """Encodes chunks; remembers the ids of the pieces it has met."""

    def __init__(self, path: str, lexicon: str | None):
        self.words = vocabulary(path)
        self.lexicon = None
        if lexicon:
            from cairngraph.llm.lexicon import Lexicon

            self.lexicon = Lexicon(local_file(lexicon))
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.offset = np.zeros(1 << 15, np.int64)
        self.filled = 0

    def _add(self, hashes: list[int], ids: list[list[int]]) -> None:
        flat = np.fromiter((x for p in ids for x in p), np.int32)
        k, base = len(self.place), self.filled
        while base + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        while k + len(ids) + 1 > len(self.offset):
            self.offset = np.r_[self.offset, np.zeros_like(self.offset)]
        self.pool[base : base + len(flat)] = flat
        self.offset[k + 1 : k + 1 + len(ids)] = base + np.cumsum([len(p) for p in ids])
        self.filled = base + len(flat)
        self.place.update(zip(hashes, range(k, k + len(ids)), strict=True))

    def encode(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each row in them)."""
        text, start, hashes, row_piece = split(raw, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if len(self.place) > REMEMBER:
            self.forget()
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        get = self.place.get
        at = [get(k, -1) for k in keys]
        new = [i for i, p in enumerate(at) if p < 0]
        if new:
            end = np.r_[start[1:], len(text)]
            pieces = [text[start[w] : end[w]].encode() for w in where[new].tolist()]
            ids: list = [None] * len(pieces)
            if self.lexicon is not None:
                for i, r in enumerate(self.lexicon.ranks(pieces).tolist()):
                    if r >= 0:
                        ids[i] = self.lexicon.ids_of(r)
            merge = self.words.merge
            ids = [merge(p) if x is None else x for p, x in zip(pieces, ids, strict=True)]
            k = len(self.place)
            self._add([keys[i] for i in new], ids)
            for j, i in enumerate(new):
                at[i] = k + j
        place = np.array(at)[inverse]
        begin, size = self.offset[place], self.offset[place + 1] - self.offset[place]
        total = np.r_[0, np.cumsum(size)]
        flat = self.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        return flat, total[row_piece]

    def encode_exactly(self, raw: bytes) -> np.ndarray:
        return np.array([i for m in regex.finditer(PATTERN, raw.decode()) for i in self.words.merge(m[0].encode())], np.int32)


def _encoder(path: str, lexicon: str | None) -> Encoder:
    """The encoder of this worker; one for another lexicon takes its place, so a reused worker holds one only."""
    if _cache.get("encoder key") != (path, lexicon):
        _cache.pop("encoder", None)
        _cache["encoder"], _cache["encoder key"] = Encoder(path, lexicon), (path, lexicon)
    return _cache["encoder"]


def encode_column(column: pa.Array, path: str = VOCABULARY, lexicon: str | None = None) -> pa.Array:
    """struct(token_ids, round_trip) of each text; null texts have no tokens."""
    encoder = _encoder(path, lexicon)
    column = plain(column)
    raw, off = buffers(column)
    flats, sizes, whole = [], [], []
    for i, j in row_chunks(column, CHUNK):
        part = raw[off[i] : off[j]]
        rel = off[i : j + 1] - off[i]
        ids, at = encoder.encode(part.tobytes(), rel)
        size = np.diff(at)
        good = np.ones(j - i, bool)
        back = encoder.words.decode(ids)
        if len(back) != len(part) or not np.array_equal(back, part):
            rows = [ids[at[r] : at[r + 1]] for r in range(j - i)]
            for r in range(j - i):
                own = part[rel[r] : rel[r + 1]]
                if not np.array_equal(encoder.words.decode(rows[r]), own):
                    rows[r] = encoder.encode_exactly(own.tobytes())
                    good[r] = np.array_equal(encoder.words.decode(rows[r]), own)
            ids, size = np.concatenate(rows), np.array([len(x) for x in rows])
        flats.append(ids)
        sizes.append(size)
        whole.append(good)
    offsets = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)
    values = np.concatenate(flats).astype(np.int32) if flats else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
    return pa.StructArray.from_arrays([lists, pa.array(np.concatenate(whole) if whole else np.zeros(0, bool))], names=["token_ids", "round_trip"])


@releasing
def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n) of texts, partial counts of a task."""

    def rows(counts: dict[int, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v[0] for v in counts.values()], pa.string()), pa.array([v[1] for v in counts.values()], pa.int64())], names=["piece", "n"])

    counts: dict[int, list] = {}
    for batch in batches:
        column = plain(batch.column(0))
        raw, off = buffers(column)
        for i, j in row_chunks(column, CHUNK):
            text, start, hashes, _ = split(raw[off[i] : off[j]].tobytes(), off[i : j + 1] - off[i])
            end = np.r_[start[1:], len(text)]
            distinct, where, n = np.unique(hashes, return_index=True, return_counts=True)
            for k, w, c in zip(distinct.tolist(), where.tolist(), n.tolist(), strict=True):
                if (old := counts.get(k)) is not None:
                    old[1] += c
                else:
                    counts[k] = [text[start[w] : end[w]], c]
            if len(counts) > COUNTED:
                yield rows(counts)
                counts = {}
    if counts:
        yield rows(counts)


def frequent_pieces(docs: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The pieces that occur at least c times in all texts, c the least count above 1 that at most ``words`` pieces reach.

    Only counts of counts and the chosen pieces reach the driver, however many pieces there are.
    """
    scratch = Scratch(docs.sparkSession)
    counted = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(count_pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    repeated = scratch.table(counted.where("n > 1"), "pieces")
    total, least = 0, None
    for r in repeated.groupBy("n").agg(F.count("*").alias("pieces")).orderBy(F.col("n").desc()).limit(words).collect():
        total += r["pieces"]
        if total > words:
            break
        least = r["n"]
    found = [] if least is None else [r.piece for r in repeated.where(F.col("n") >= least).select("piece").collect()]
    scratch.drop()
    return found


def compile_frequent(docs: DataFrame, path: str = VOCABULARY, words: int = LEXICON_WORDS) -> str:
    """Compiles the frequent pieces with their ids and publishes the file; returns its handle."""
    from cairngraph.llm.lexicon import compile_lexicon

    merge = vocabulary(path).merge
    entries = {p.encode(): merge(p.encode()) for p in frequent_pieces(docs, words)}
    return publish(docs.sparkSession, "lexicon", compile_lexicon(entries or {b" ": merge(b" ")}))


def encode(docs: DataFrame, path: str = VOCABULARY, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip), a row for each row of docs.

    Defined results: a null or empty text has no tokens; a null doc_id stays null; rows that repeat are each
    encoded; very long words are merged with a heap; other columns are not read; an empty table gives no rows.
    ``path`` is the rank file, which every executor must see at that place.
    """
    tune(docs.sparkSession)
    lexicon = compile_frequent(docs, path, words)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = encode_column(batch.column(1), path, lexicon)
            ids = s.field(0)
            n = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, n, s.field(1)], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids): the inverse of encode; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = vocabulary(path)
            texts = [None if x is None else words.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, text string")
