"""Near-duplicate groups: MinHash bands, sequential Bayesian verification of signature batches, exact check.

Plan (nothing is quadratic in a group of copies, no cap on partners):

1. one pass over the texts gives each document a signature of 128 16-bit minima over its distinct 3-word shingles
   and a digest of the shingle set; documents of the same digest are equal (similarity 1) and collapse to one;
2. 32 bands of 4 minima; in every bucket with several members each member is paired with a leader that differs
   from band to band (a star: linear in the bucket);
3. a pair's signatures are compared 16 minima at a time; it goes as soon as the posterior probability (uniform
   prior) that the similarity reaches the threshold falls below the miss probability;
4. each document's best surviving pair is verified exactly on the texts, which connects most of every group;
5. what is left - surviving pairs, and pairs of one bucket, whose ends are still in different groups - is compared
   in the same way, so every pair that shares a bucket is decided or is already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.llm._shared import Scratch, checked_join, components, free, releasing, repeated_ids
from cairngraph.llm._text import Words, lower, row_chunks, shingles

SHINGLE, HASHES, BANDS, THRESHOLD, MISS, STEP = 3, 128, 32, 0.5, 0.01, 16
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SIGNATURE = "doc_id long, n_words long, digest long, sig binary"


def min_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """uint16[len(starts), HASHES]: low bits of the minima of each run of 64-bit shingle hashes."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(starts)), np.uint32)
    h, t = np.empty_like(x), np.empty_like(x)
    for j in range(HASHES):
        np.bitwise_xor(x, _XOR[j], out=h)
        np.multiply(h, _MUL[j], out=h)
        np.right_shift(h, 15, out=t)
        np.bitwise_xor(h, t, out=h)
        np.multiply(h, np.uint32(0x2C1B3C6D), out=h)
        np.minimum.reduceat(h, starts, out=out[j])
    return np.ascontiguousarray((out.T & np.uint32(0xFFFF)).astype(np.uint16))


@releasing
def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to SIGNATURE; documents without words are left out."""
    for batch in batches:
        ids, text = batch.column(0).to_numpy(zero_copy_only=False), lower(batch.column(1))
        for i, j in row_chunks(text):
            words = Words(text[i:j])
            values, row = shingles(words, SHINGLE)
            if not len(values):
                continue
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            rows = row[starts]
            sig = min_hashes(values, starts)
            ends = np.r_[starts[1:], len(values)]
            digest = np.array([np.unique(values[a:b]).sum(dtype=np.uint64) for a, b in zip(starts, ends, strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i:j][rows].astype(np.int64)), pa.array(words.counts[rows].astype(np.int64)), pa.array(digest.view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["doc_id", "n_words", "digest", "sig"],
            )


def least_matches(threshold: float, miss: float, hashes: int = HASHES, step: int = STEP) -> np.ndarray:
    """For each multiple of ``step``, the least matches m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), so that probability is P(Bin(n + 1, threshold) <= m).
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(kept, matches) of rows of signatures, compared batch by batch; a pair that is pruned is not looked at again."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * step, (k + 1) * step)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= m]
        if not len(alive):
            break
    kept = np.zeros(len(a), bool)
    kept[alive] = True
    return kept, matches


def _pruner(threshold: float, miss: float):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, miss)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in (2, 3))
            kept, matches = survivors(a, b, least)
            at = np.flatnonzero(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(matches[at])], names=["a", "b", "matches"])

    return prune


def jaccard(texts_a: pa.Array, texts_b: pa.Array) -> np.ndarray:
    """Exact similarity of the sets of shingles of each pair of texts; 0 where both have none."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        column = lower(column)
        for i, j in row_chunks(column):
            values, row = shingles(Words(column[i:j]), SHINGLE)
            cuts = np.searchsorted(row, np.arange(j - i + 1))
            out += [np.unique(values[cuts[r] : cuts[r + 1]]) for r in range(j - i)]
        return out

    result = []
    for x, y in zip(sets(texts_a), sets(texts_b), strict=True):
        common = len(np.intersect1d(x, y, assume_unique=True))
        result.append(common / max(1, len(x) + len(y) - common))
    return np.array(result)


def _verifier(threshold: float):
    @releasing
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = jaccard(batch.column(2), batch.column(3))
                at = pa.array(np.flatnonzero(sim >= threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sim).take(at)], names=["a", "b", "similarity"])

    return verify


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of every document that has a near copy.

    Two documents are near copies if the Jaccard similarity of their sets of 3-word shingles is at least
    ``threshold``; groups are the connected components, ``group_id`` the smallest doc_id, which is the one to keep.
    Defined results: a null doc_id, a null text and a text without words take no part; a text of fewer than three
    words is one shingle; very long texts are read whole; ties between pairs and leaders go by hash, then id; rows that repeat a doc_id count as one document, the one of the smallest text; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    if repeated_ids(docs):
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    signed = scratch.table(docs.mapInArrow(sign, SIGNATURE), "signatures")
    same = signed.groupBy("digest", "n_words").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.table(signed.select("doc_id", "digest", "n_words").join(same, ["digest", "n_words"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a < b"), "copies")
    rest = checked_join(signed.select(F.col("doc_id").alias("id"), "sig"), copies.select(F.col("b").alias("id")), "id", "left_anti")

    width = 2 * HASHES // BANDS
    banded = rest.select("id", F.posexplode(F.array(*[F.substring("sig", 1 + width * k, width) for k in range(BANDS)])).alias("band", "part")).select("id", F.xxhash64("band", "part").alias("bucket"))
    same_bucket = Window.partitionBy("bucket")
    members = scratch.table(
        banded.select("bucket", "id", F.count("*").over(same_bucket).alias("n"), F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id")).over(same_bucket)["id"].alias("leader")).where("n > 1").select("bucket", "id", "leader"),
        "members",
    )
    low, high = F.least("id", "leader"), F.greatest("id", "leader")
    star = members.where("id <> leader").select(low.alias("a"), high.alias("b")).distinct()

    def prune(pairs: DataFrame) -> DataFrame:
        sig = checked_join(rest, members.select("id").distinct(), "id", "left_semi")
        both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return scratch.table(both.select("a", "b", "sig_a", "sig_b").mapInArrow(_pruner(threshold, miss), "a long, b long, matches long"), "survivors")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = scratch.table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
        text = checked_join(docs, ids, "doc_id", "left_semi")
        both = pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return scratch.table(both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(threshold), "a long, b long, similarity double"), "verified")

    likely = prune(star)
    ends = likely.select(F.col("a").alias("id"), "a", "b", "matches").union(likely.select("b", "a", "b", "matches"))
    best = ends.groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct("matches", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
    first = verify(scratch.table(best, "best"))
    label = components(first, scratch)

    named = checked_join(members, label, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = named.groupBy("bucket").agg(F.countDistinct("root").alias("roots")).where("roots > 1").select("bucket")
    open_members = scratch.table(named.join(mixed, "bucket", "left_semi"), "open")
    x, y = open_members.alias("x"), open_members.alias("y")
    crossing = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    untested = crossing.distinct().join(star, ["a", "b"], "left_anti")
    waiting = likely.join(best, ["a", "b"], "left_anti").select("a", "b")
    ra, rb = (label.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    waiting = checked_join(checked_join(waiting, ra, "a", "left"), rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    second = verify(scratch.table(waiting.unionByName(prune(untested).select("a", "b")), "waiting"))

    all_edges = copies.unionByName(first.select("a", "b")).unionByName(second.select("a", "b"))
    groups = components(all_edges, scratch).select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return scratch.keep(groups.join(sizes, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("keep")))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The documents without all but one of each group of near copies; columns stay as they are.

    Documents without words or without a doc_id stay.  Rows that repeat a doc_id are one document, the one of the
    smallest text (nulls last).
    """
    gone = near_groups(docs, threshold, miss).where(~F.col("keep")).select("doc_id")
    if repeated_ids(docs):
        with_id, without = docs.where(F.col("doc_id").isNotNull()), docs.where(F.col("doc_id").isNull())
        (rank,) = free(docs, "__cairn_rank")
        w = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
        docs = with_id.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank).unionByName(without)
    return checked_join(docs, gone, "doc_id", "left_anti")
