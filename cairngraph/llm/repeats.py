"""Removal of long repeated passages: equal windows of LENGTH words, brought together by the least gram that they hold.

1. Windows: every window of LENGTH words of a text has a hash and a key, the least hash of its ANCHOR-word grams, so
   equal windows have equal keys wherever they are. Successive windows mostly share their key, so a row holds a run of
   them: key, place and their hashes.
2. Blocks: a task compares the windows of some hundred thousand words at once. Of equal ones only the first (by doc_id,
   then place) goes on; the others are spans already. So a passage that all documents share is one row a block.
3. Keys: rows are dealt by key and read in the order of (key, doc_id, place), batch by batch; every window whose equal
   came before in its key repeats. What is held is the distinct windows of one key, never those of a whole component of
   documents that passages connect. A key with very many distinct windows (a short phrase of all documents, each time
   in other text) isn't used: its windows are dealt by their own hashes. A sample finds such keys; the results
   don't depend on it.
4. Spans that touch are joined, document by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.llm._shared import Scratch, checked_join, free, releasing, repeated_ids
from cairngraph.llm._text import Words, cut_words, grams, has_words, lower, plain, row_chunks
from cairngraph.llm.decontaminate import replace_text
from cairngraph.llm.rindex import window_hashes

#: Words of a passage that counts as repeated; words of an anchor; words in a block.
LENGTH, ANCHOR, BLOCK = 50, 16, 400_000
#: Distinct windows of a key, as estimated from one document of SAMPLE, beyond which they are dealt one by one.
CROWD, SAMPLE = 500_000, 64
#: A run of windows (windows is their hashes, end_word null), or a span found already (windows null).
RUNS = "key long, doc_id long, first_word int, end_word int, source_doc_id long, windows binary"
FOUND = "doc_id long, first_word int, end_word int, source_doc_id long"


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    size, y = 1, x
    while size * 2 <= width:
        y = op(y[:-size], y[size:])
        size *= 2
    rest = width - size
    return op(y[:-rest], y[rest:]) if rest else y


def windows(words: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words in ``words``, hashes, keys) of the windows of ``length`` words that lie in one row."""
    if len(words.hash) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[: len(words.row) - length + 1] == words.row[length - 1 :])
    least = _slide(grams(words.hash, anchor), length - anchor + 1, np.minimum)
    return at, window_hashes(words.hash, length)[at], least[at]


def _spans(doc: np.ndarray, first: np.ndarray, source: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, first word, end word, source) of the spans under windows that repeat; successive ones that touch are one."""
    step = np.diff(first)
    begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (step <= 0) | (step > length)])
    last = np.r_[begin[1:], len(doc)] - 1
    return doc[begin], first[begin].astype(np.int32), (first[last] + length).astype(np.int32), source[begin]


def _block(doc: np.ndarray, first: np.ndarray, whole: np.ndarray, key: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows whose equal comes before in the block; runs of the others."""
    if (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        doc, first, whole, key = doc[order], first[order], whole[order], key[order]
    n = len(doc)
    order = np.argsort(whole)
    begin = np.flatnonzero(np.r_[True, np.diff(whole[order]) != 0])
    source = np.empty(n, np.int64)
    source[order] = np.repeat(np.minimum.reduceat(order, begin), np.diff(np.r_[begin, n]))
    again = (source != np.arange(n)) & (key[source] == key)
    names = [x.split()[0] for x in RUNS.split(", ")]
    if again.any():
        d, a, b, s = _spans(doc[again], first[again], doc[source[again]], length)
        arrays = [pa.array(d), pa.array(d), pa.array(a), pa.array(b), pa.array(s), pa.nulls(len(d), pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)
    if not again.all():
        doc, first, whole, key = doc[~again], first[~again], whole[~again], key[~again]
        begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (np.diff(first) != 1) | (key[1:] != key[:-1])])
        ends = (np.r_[begin, len(doc)] * 8).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(whole)])
        m = len(begin)
        arrays = [pa.array(key[begin].view(np.int64)), pa.array(doc[begin]), pa.array(first[begin].astype(np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), runs]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _runs(length: int, anchor: int, block: int, crowded: np.ndarray):
    """Texts to runs and spans; ``crowded`` (sorted) are the keys that aren't used."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, text = batch.column(0).to_numpy(zero_copy_only=False), lower(batch.column(1))
            for i, j in row_chunks(text):
                words = Words(text[i:j])
                at, whole, key = windows(words, length, anchor)
                if len(crowded):
                    alone = crowded[np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)] == key
                    key = np.where(alone, whole, key)
                row = words.row[at]
                if len(at):
                    held.append((ids[i:j][row].astype(np.int64), at - words.first[row], whole, key))
                    n += len(at)
                if n >= block:
                    yield from _block(*(np.concatenate(x) for x in zip(*held, strict=True)), length)
                    held, n = [], 0
        if held:
            yield from _block(*(np.concatenate(x) for x in zip(*held, strict=True)), length)

    return run


def _repeated(length: int):
    """Runs in the order of (key, doc_id, first_word) to the spans of windows whose equal came before."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, held_doc = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)  # distinct windows of the last key
        for batch in batches:
            found = batch.column(5).is_null()
            if found.true_count:
                own = batch.filter(found)
                yield pa.RecordBatch.from_arrays([own.column(k) for k in range(1, 5)], names=names)
                batch = batch.filter(pc.invert(found))
            if not batch.num_rows:
                continue
            key, doc, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if key[0] != last:
                held, held_doc = held[:0], held_doc[:0]
            last = key[-1]
            same = key[1:] == key[:-1]
            need = np.r_[len(held) > 0, same] | np.r_[same, True]  # a run alone in its key repeats nothing
            kept = batch.column(5).filter(pa.array(need)).cast(pa.large_binary())
            key, doc, first = key[need], doc[need], first[need]
            ends = np.frombuffer(kept.buffers()[1], np.int64)[kept.offset : kept.offset + len(kept) + 1]
            whole = np.frombuffer(kept.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)
            size = np.diff(ends) // 8
            row = np.repeat(np.arange(len(size)), size)
            place = first[row] + np.arange(len(row)) - ((ends[:-1] - ends[0]) // 8)[row]
            m = len(held)
            key, doc, whole = np.r_[np.full(m, key[0]), key[row]], np.r_[held_doc, doc[row]], np.r_[held, whole]
            order = np.lexsort((whole, key))
            k, w = key[order], whole[order]
            begin = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])])
            source = np.empty(len(order), np.int64)
            source[order] = np.repeat(order[begin], np.diff(np.r_[begin, len(order)]))
            again = np.flatnonzero(source != np.arange(len(order)))
            if len(again):
                spans = _spans(doc[again], place[again - m], doc[source[again]], length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=names)
            distinct = order[begin]
            distinct = distinct[key[distinct] == last]
            held, held_doc = whole[distinct], doc[distinct]

    return run


def crowded_keys(docs: DataFrame, length: int, anchor: int, block: int, crowd: int) -> np.ndarray:
    """The keys, sorted, that have more than ``crowd`` distinct windows, estimated from a share of the documents."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    runs = sample.mapInArrow(_runs(length, anchor, block, np.zeros(0, np.uint64)), RUNS).where("windows is not null")
    many = runs.groupBy("key").agg(F.sum(F.octet_length("windows")).alias("n")).where(F.col("n") > 8 * crowd / SAMPLE)
    return np.sort(np.array([r["key"] for r in many.select("key").collect()], np.int64).view(np.uint64))


def find_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(doc_id, first_word, end_word, n_words, source_doc_id): the spans of ``length`` words or more that occur before.

    Every window of ``length`` normalised words whose equal occurs in a document of a smaller doc_id, or earlier in
    its own, belongs to a span; ``source_doc_id`` is a document that holds the start of the span earlier. The first
    occurrence is never marked. Words are counted from 0. Spans of a document don't touch. Defined results: a null
    doc_id, a null text and a text of fewer than ``length`` words have no spans; very long texts are read whole; rows
    that repeat a doc_id count as one document, the one of the smallest text; an empty table gives no rows; other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    if repeated_ids(docs):
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    runs = docs.mapInArrow(_runs(length, anchor, block, crowded_keys(docs, length, anchor, block, crowd)), RUNS)
    found = runs.repartition("key").sortWithinPartitions("key", "doc_id", "first_word").mapInArrow(_repeated(length), FOUND)
    in_doc = Window.partitionBy("doc_id").orderBy("first_word", "end_word", "source_doc_id")
    reach = F.max("end_word").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("first_word") <= reach, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("new").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max(F.when(F.col("new") == 1, F.col("source_doc_id"))).alias("source_doc_id"))
    return scratch.keep(spans.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "source_doc_id"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """The documents without the spans of find_repeats; a document that has no word left goes; columns stay as they are."""
    if repeated_ids(docs):
        (rank,) = free(docs, "__cairn_rank")
        w = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
        docs = docs.withColumn(rank, F.row_number().over(w)).where((F.col(rank) == 1) | F.col("doc_id").isNull()).drop(rank)
    spans = find_repeats(docs, length, anchor, block)
    column, text = free(docs, "__cairn_spans", "__cairn_text")
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "end_word")).alias(column))

    @F.arrow_udf(T.StringType())
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out: list[str | None] = [None] * len(text)
        found = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
        own = plain(text)
        for r in found.tolist():
            left = cut_words(own[r].as_py(), [(s["first_word"], s["end_word"]) for s in spans[r].as_py()])
            out[r] = left if has_words(left) else ""
        return pa.array(out, pa.string())

    joined = checked_join(docs, by_doc, "doc_id", "left")
    cleaned = joined.withColumn(text, cut.asNondeterministic()("text", column)).drop(column)
    return replace_text(cleaned, text).select(*[F.col(f"`{c}`") for c in docs.columns])
