"""Benchmark decontamination: a generalised suffix automaton of the normalised test items.

Training words are streamed through the automaton, which gives the longest suffix that occurs in an item at every
word.  Maximal matches are removed if they exceed the length limit; besides, what a text holds of an item is removed if
its runs of LEAST words cover more of the item than the coverage limit, whichever other items hold the same words.
Array operations find the runs of LEAST words that a text shares with any item; only these stretches are streamed, as a
longer match consists of such runs.  Items of fewer words match as a whole.

The automaton is flat arrays in a file that workers map into memory.  Tasks build it from shards of the items; results
don't depend on how items fall into shards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.llm._shared import free, local_file, open_arrays, pack_arrays, publish, releasing, tune
from cairngraph.llm._text import Words, cut_words, grams, has_words, lower, plain, row_chunks

#: Words of a match that are removed whatever it covers; share of an item's words; words of a run that counts.
LENGTH, COVERAGE, LEAST = 8, 0.5, 5
#: Words of test items in one automaton (about 15 MB); more of them are several automata.
SHARD_WORDS = 250_000
_NO_ID = -(1 << 63)
_open: dict[str, Automaton] = {}
Span = tuple[int, int, tuple[int, bool, int]]


class Builder:
    """Suffix automaton of several sequences of small integers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:  # this word has followed before
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = self._state(self.len[p] + 1, dict(nxt[q]), link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def owners(self, sequences: list[list[int]]) -> np.ndarray:
        """For each state the first of the sequences that hold its string."""
        out = np.full(len(self.next), -1, np.int32)
        for k, words in enumerate(sequences):
            s = 0
            for w in words:
                s = t = self.next[s][w]
                while t > 0 and out[t] < 0:
                    out[t] = k
                    t = self.link[t]
        return out


def pack(items: list[tuple[int | None, np.ndarray]]) -> bytes:
    """The file of one automaton of (item_id, word hashes); items are numbered from the shortest, then smallest id, on."""
    items = sorted((x for x in items if len(x[1])), key=lambda x: (len(x[1]), x[0] is None, x[0] or 0, x[1].tobytes()))
    words = np.concatenate([w for _, w in items] or [np.zeros(0, np.uint64)])
    size = np.array([len(w) for _, w in items], np.int64)
    vocabulary, code = np.unique(words, return_inverse=True)
    cuts = np.r_[0, np.cumsum(size)]
    codes = [code[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    auto = Builder()
    for c in codes:
        if len(c) >= LEAST:
            auto.add(c)
    v = max(1, len(vocabulary))
    step = sorted((s * v + w, t) for s, nxt in enumerate(auto.next) for w, t in nxt.items())
    # runs of LEAST words, or a shorter item's words: (hash, item, place in the item)
    runs = [(grams(w, min(LEAST, len(w))), k) for k, (_, w) in enumerate(items)]
    h = np.concatenate([g for g, _ in runs] or [np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(runs), dtype=np.int32), [len(g) for g, _ in runs])
    place = np.concatenate([np.arange(len(g), dtype=np.int32) for g, _ in runs] or [np.zeros(0, np.int32)])
    tables = {}
    for n in range(1, LEAST + 1):
        own = np.flatnonzero(np.minimum(size, LEAST)[item] == n)
        order = own[np.lexsort((place[own], item[own], h[own]))]
        keys, first = np.unique(h[order], return_index=True)
        tables |= {f"run{n}": keys, f"from{n}": np.r_[first, len(order)].astype(np.int64), f"item{n}": item[order], f"place{n}": place[order]}
    return pack_arrays(
        vocabulary=vocabulary, step=np.array([k for k, _ in step], np.int64), to=np.array([t for _, t in step], np.int32), link=np.array(auto.link, np.int32), length=np.array(auto.len, np.int32),
        owner=auto.owners([c if len(c) >= LEAST else [] for c in codes]), size=size, ids=np.array([_NO_ID if i is None else i for i, _ in items], np.int64), **tables,
    )


class Automaton:
    """A packed automaton, memory-mapped."""

    def __init__(self, path: str):
        for name, a in open_arrays(path).items():
            setattr(self, name, a)
        self.runs = {n: tuple(getattr(self, f"{k}{n}") for k in ("run", "from", "item", "place")) for n in range(1, LEAST + 1)}

    def rank(self, k: int) -> tuple[int, bool, int]:
        """(words, no id, id) of an item: of several items the least is named."""
        i = int(self.ids[k])
        return int(self.size[k]), i == _NO_ID, i

    def _next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state that a word leads to; -1 for none, also where the word is in no item (-1)."""
        key = state.astype(np.int64) * max(1, len(self.vocabulary)) + word
        at = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
        return np.where((word >= 0) & (self.step[at] == key), self.to[at], -1)

    def statistics(self, words: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the stretches [first, end) the length of the longest match that ends there, and its state.

        All stretches are streamed side by side.
        """
        length, states = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == words, at, -1)
        order = np.argsort(first - end, kind="stable")
        first, size = first[order], (end - first)[order]
        state, matched = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for i in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -i, "left"))
            w, s, m = code[first[:live] + i], state[:live], matched[:live]
            to = self._next(s, w)
            while len(back := np.flatnonzero((to < 0) & (s > 0))):  # shorter suffixes
                s[back] = self.link[s[back]]
                m[back] = self.length[s[back]]
                to[back] = self._next(s[back], w[back])
            s[:] = np.maximum(to, 0)
            m[:] = np.where(to < 0, 0, m + 1)
            length[first[:live] + i], states[first[:live] + i] = m, s
        return length, states

    def _hits(self, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``g``, numbers) of the runs that are an item's."""
        keys = self.runs[n][0]
        if not len(keys) or not len(g):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        at = np.flatnonzero(keys[pos] == g)
        return at, pos[at]

    def leaks(self, words: Words, run_hashes: dict[int, np.ndarray], length: int, coverage: float) -> Iterator[tuple[int, Span]]:
        """(row, (first, end, item's rank)) of what exceeds a limit; spans may lie within others."""
        base = words.first
        for n in range(1, LEAST + 1):
            at, number = self._hits(run_hashes[n], n)
            inside = words.row[at] == words.row[at + n - 1]
            at, number = at[inside], number[inside]
            if not len(at):
                continue
            if n == LEAST:
                start = np.r_[True, (np.diff(at) > 1) | (np.diff(words.row[at]) > 0)]
                first, end = at[start], np.r_[at[:-1][start[1:]], at[-1]] + LEAST
                matched, state = self.statistics(words.hash, first, end)
                for a, b in zip(first.tolist(), end.tolist(), strict=True):
                    m = matched[a:b]
                    last = np.flatnonzero((m >= length) & (np.r_[m[1:], 0] <= m))  # the next word doesn't extend it
                    for i in last.tolist():
                        row = int(words.row[a])
                        e = a + i + 1 - int(base[row])
                        yield row, (e - int(m[i]), e, self.rank(int(self.owner[state[a + i]])))
            yield from self._covering(words, at, number, n, coverage)

    def _covering(self, words: Words, at: np.ndarray, number: np.ndarray, n: int, coverage: float) -> Iterator[tuple[int, Span]]:
        _, start, items, places = self.runs[n]
        low, count = start[number], start[number + 1] - start[number]
        posting = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
        where, item, place = np.repeat(at, count), items[posting].astype(np.int64), places[posting]
        pair = words.row[where] * len(self.size) + item
        # how much of each item its runs cover, each place once
        order = np.lexsort((place, pair))
        p, q = pair[order], place[order]
        new = np.full(len(p), n)
        same = p[1:] == p[:-1]
        new[1:][same] = np.minimum(n, np.diff(q)[same])
        heads = np.flatnonzero(np.r_[True, ~same])
        covered = np.add.reduceat(new, heads)
        found = p[heads][covered >= coverage * self.size[p[heads] % len(self.size)]]
        if not len(found):
            return
        keep = np.flatnonzero(np.isin(pair, found))
        order = keep[np.lexsort((where[keep], pair[keep]))]
        p, w = pair[order], where[order]
        fresh = np.r_[True, (p[1:] != p[:-1]) | (w[1:] > w[:-1] + n)]
        for a, b in zip(np.flatnonzero(fresh).tolist(), [*(np.flatnonzero(fresh)[1:] - 1).tolist(), len(p) - 1], strict=True):
            row = int(words.row[w[a]])
            yield row, (int(w[a] - words.first[row]), int(w[b] + n - words.first[row]), self.rank(int(p[a] % len(self.size))))


def widest(spans: list[Span]) -> list[Span]:
    """The spans that lie in no other, each once with its least item, in the order of places."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if not out or s[1] > out[-1][1]:
            out.append(s)
    return out


def _shards(limit: int):
    """(item_id, text) to (file) of the automata of this task's items."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(items)], pa.large_binary())], names=["file"])

        for batch in batches:
            ids, text = batch.column(0).to_pylist(), lower(batch.column(1))
            for i, j in row_chunks(text):
                words = Words(text[i:j])
                for r in range(j - i):
                    items.append((ids[i + r], words.hash[words.first[r] : words.first[r + 1]].copy()))
                    n += len(items[-1][1])
                    if n >= limit:
                        yield flush()
                        items, n = [], 0
        if n:
            yield flush()

    return run


def publish_automata(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> list[str]:
    """Builds the automata of all items in tasks and publishes them; one file at a time passes through the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    files = items.mapInArrow(_shards(shard_words), "file binary").toLocalIterator()
    return [publish(benchmark.sparkSession, "automaton", bytes(r["file"])) for r in files]


def _automaton(handle: str) -> Automaton:
    if handle not in _open:
        _open[handle] = Automaton(local_file(handle))
    return _open[handle]


def leaks_of(column: pa.Array, handles: list[str], length: int, coverage: float) -> dict[int, list[Span]]:
    """row -> (first word, end, (words of the item, no id, item_id)) of what is to be removed."""
    text, out = lower(column), defaultdict(list)
    automata = [_automaton(h) for h in handles]
    sizes = {n for a in automata for n in a.runs if len(a.runs[n][0])}
    for i, j in row_chunks(text):
        words = Words(text[i:j])
        runs = {n: grams(words.hash, n) if n in sizes else np.zeros(0, np.uint64) for n in range(1, LEAST + 1)}
        for auto in automata:
            for row, span in auto.leaks(words, runs, length, coverage):
                out[i + row].append(span)
    return {r: widest(spans) for r, spans in out.items()}


def find_leaks(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, n_words, item_words) of the spans of each document that are removed.

    A span is a maximal match of ``length`` words or more with an item, or a maximal stretch of words in runs of five
    that belong to one item of which such runs hold the share ``coverage`` or more (each of the item's words counts
    once).  An item of one to four words matches wherever all of it stands.  Words are counted from 0 in the normalised
    text.  A span within another isn't repeated; of several items of a span the shortest, then the one of the smallest
    id, is named.  Defined results: null and empty texts and items match nothing; very long texts and items are read
    whole; repeated documents are each reported, repeated items count once; a null doc_id or item_id stays null; an empty
    table on either side gives no rows; other columns are not read.
    """
    tune(docs.sparkSession)
    handles = publish_automata(benchmark, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], None if no_id else item, a, b, b - a, n) for r, found in leaks_of(batch.column(1), handles, length, coverage).items() for a, b, (n, no_id, item) in found]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "first_word", "end_word", "n_words", "item_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, first_word int, end_word int, n_words int, item_words int")


def replace_text(docs: DataFrame, cleaned: str) -> DataFrame:
    """docs with ``cleaned`` in the place of text where it isn't null, without rows that it empties of words."""
    new = {"text": F.coalesce(cleaned, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(cleaned).isNotNull(), F.length(cleaned).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    gone = F.col(cleaned).isNotNull() & (F.col(cleaned) == "")
    return docs.where(~gone).withColumns(new).drop(cleaned)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents without leaked spans (see find_leaks); a document that has no word left goes; columns stay as they are."""
    tune(docs.sparkSession)
    handles = publish_automata(benchmark, shard_words)

    @F.arrow_udf(T.StringType())
    def clean(text: pa.Array) -> pa.Array:
        found = leaks_of(text, handles, length, coverage)
        out: list[str | None] = [None] * len(text)
        if found:
            own = plain(text)
            for r, spans in found.items():
                left = cut_words(own[r].as_py(), [(a, b) for a, b, _ in spans])
                out[r] = left if has_words(left) else ""
        return pa.array(out, pa.string())

    (column,) = free(docs, "__cairn_text")
    return replace_text(docs.withColumn(column, clean.asNondeterministic()("text")), column)
