"""Near-duplicate groups of embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Mean and covariance of all unit vectors give the principal axes; several rotations of these axes are learned over
   all vectors, each from its own start, so that the signs of the rotated vectors lose little (iterative
   quantisation); every rotation gives a code of as many balanced bits as there are dimensions.
2. The codes are cut into substrings, each the key of one Hamming table.  Their width follows the number of vectors
   (about one vector in a bucket) and their number is such that a pair at the threshold shares a bucket with the wanted
   recall, closer pairs with more (a pair within a Hamming radius below the number of its code's substrings agrees in one
   of them, and to look up each substring exactly costs fewer rows in a self-join than all substrings one bit away: 4
   exact tables find what 17 rows of the other kind do).  As the codes are of centred vectors and the threshold is of raw ones, the share is
   measured: every vector gets a partner at the threshold, and random rotations are added until enough of them are
   found; where that takes more tables than comparing all pairs does work, all pairs are compared.
3. In each bucket every member is paired with a leader that differs from table to table; pairs pass the Hamming
   distance of their whole codes, then the cosine of their own vectors.  Pairs of a bucket that are in different groups
   after that are compared too.  So every pair that shares a bucket is decided or already connected, and a group of n
   copies costs about n comparisons, not n squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.llm._shared import Scratch, checked_join, components

#: Least cosine of near copies, wanted recall of pairs at it, rounds of learning, least bits of a table's key.
THRESHOLD, RECALL, ROUNDS, LEAST_BITS = 0.9, 0.95, 8, 16


def flip_rate(cosine: float) -> float:
    """Share of bits in which the codes of two vectors differ, expected."""
    return math.acos(max(-1.0, min(1.0, cosine))) / math.pi


def tables_for(n: int, dim: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """(bits of a key, tables in a code, rotations)."""
    bits = min(dim, max(min(LEAST_BITS, dim), math.ceil(math.log2(max(2, n)))))
    hit = (1 - flip_rate(threshold)) ** bits
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
    per_code = dim // bits
    return bits, per_code, math.ceil(tables / per_code)


def _matrix(column: pa.Array) -> np.ndarray:
    """float64[rows, dim] of a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(dim: int):
    """(vec_id, embedding) to (vec_id, unit vector); what isn't a finite vector of the dimension, or is zero, goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            fits = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(v), dim), False))
            ids, v = ids.filter(fits), v.filter(fits)
            x = pc.fill_null(v.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 1e-12)
            x = (x[good] / norm[good, None]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), lists], names=["id", "v"])

    return run


def _summed(vectors: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over all batches of an array of ``size`` numbers, added up by cells in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column(0))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["cell", "x"])

    rows = vectors.select("v").mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(size)
    out[rows.cell.to_numpy()] = rows.x.to_numpy()
    return out


def learn(vectors: DataFrame, dim: int, rotations: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections[rotations, dim, dim]): bits of x are the signs of (x - mean) @ projection."""
    s = _summed(vectors, lambda x: np.r_[np.array([len(x)]), x.sum(0), (x.T @ x).ravel()], 1 + dim + dim * dim)
    n = max(1.0, s[0])
    mean = s[1 : dim + 1] / n
    cov = s[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1]
    rng = np.random.default_rng(7)
    turn = np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(rotations)])
    for _ in range(rounds):
        now = turn

        def partial(x: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            p = (x - mean) @ axes
            return np.stack([np.sign(p @ r).T @ p for r in now])

        m = _summed(vectors, partial, rotations * dim * dim).reshape(rotations, dim, dim)
        for k in range(rotations):  # the rotation that brings p closest to its signs
            u, _, vt = np.linalg.svd(m[k])
            turn[k] = (u @ vt).T
    return mean, np.stack([axes @ r for r in turn])


def _partners(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each unit vector one at the cosine ``threshold``, in a direction that depends on the vector alone."""
    noise = np.random.default_rng(11).standard_normal((1024, x.shape[1]))
    z = noise[np.ascontiguousarray(x, np.float32).view(np.uint32).sum(1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)]
    z = z - (z * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return threshold * x + math.sqrt(1 - threshold * threshold) * z / np.maximum(norm, 1e-12)


def measure(vectors: DataFrame, mean: np.ndarray, projections: np.ndarray, bits: int, per_code: int, threshold: float) -> tuple[np.ndarray, float, float]:
    """(share of partners found by the first 1, 2 .. rotations, mean and deviation of the bits in which they differ)."""
    rotations = len(projections)

    def partial(x: np.ndarray) -> np.ndarray:
        a, b = x - mean, _partners(x, threshold) - mean
        found, flips, out = np.zeros(len(x), bool), np.zeros(len(x)), np.zeros(3 + rotations)
        for r, p in enumerate(projections):
            differ = (a @ p > 0) != (b @ p > 0)
            flips += differ.sum(1)
            for k in range(per_code):
                found |= ~differ[:, k * bits : (k + 1) * bits].any(1)
            out[3 + r] = found.sum()
        out[:3] = len(x), flips.sum(), (flips * flips).sum()
        return out

    s = _summed(vectors, partial, 3 + rotations)
    n = max(1.0, s[0])
    return s[3:] / n, s[1] / n, math.sqrt(max(0.0, s[2] / n - (s[1] / n) ** 2))


def more_rotations(share: np.ndarray, recall: float) -> int:
    """Rotations that the wanted recall takes, carried on from the shares found so far; at most four times as many."""
    have = len(share)
    half = have // 2
    missed, before = 1 - share[-1], 1 - share[half - 1] if half else 1.0
    rate = math.log(max(before, 1e-9) / max(missed, 1e-9)) / (have - half)
    return min(4 * have, have + max(1, math.ceil(math.log(missed / (1 - recall)) / rate))) if rate > 1e-9 else 4 * have


def _coder(mean: np.ndarray, projections: np.ndarray, bits: int, per_code: int):
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)) - mean
            codes = np.concatenate([x @ p > 0 for p in projections], axis=1)
            dim = x.shape[1]
            keys = np.stack([codes[:, r * dim + k * bits : r * dim + (k + 1) * bits] @ weights for r in range(len(projections)) for k in range(per_code)], axis=1)
            packed = [row.tobytes() for row in np.packbits(codes, axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), lists], names=["id", "v", "code", "keys"])

    return run


def _all_pairs(n: int, block: int = 1000):
    """Keys of a vector: the pairs of blocks that hold its own, so that any two vectors share one."""
    blocks = max(1, math.ceil(n / block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda other: F.least(own, other) * blocks + F.greatest(own, other))


def _rerank(threshold: float, most: int):
    """Keeps pairs whose codes differ in at most ``most`` bits and whose cosine reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ca, cb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            near = np.flatnonzero(np.bitwise_count(ca ^ cb).sum(1) <= most)
            if not len(near):
                continue
            near_rows = pa.array(near)
            a, b = (_matrix(batch.column(k).take(near_rows)) for k in (4, 5))
            cosine = (a * b).sum(1)
            at = pa.array(np.flatnonzero(cosine >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near_rows).take(at), batch.column(1).take(near_rows).take(at), pa.array(cosine).take(at)], names=["a", "b", "cosine"])

    return run


def near_groups(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, group_id, group_size, keep) of every vector that has a near copy: cosine at least ``threshold``.

    Groups are connected components; group_id is the smallest id, which is the one to keep.  Defined results: a null
    id, a null, zero or infinite vector, and one with a null element or of another dimension than most vectors takes
    no part; rows that repeat an id count as one, the one of the smallest vector; equal vectors are always in one
    group; of dimensions that are equally frequent the larger one counts; leaders of equal hash go by id; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(embeddings.sparkSession)
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v")).where("id is not null and v is not null")
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if dims is None or not dims["d"]:
        return scratch.keep(rows.limit(0).select(F.col("id").alias(key), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("keep")))
    dim = dims["d"]
    unit = scratch.table(rows.mapInArrow(_unit(dim), "id long, v array<float>").groupBy("id").agg(F.min("v").alias("v")), "unit")
    same = unit.groupBy("v").agg(F.min("id").alias("a"), F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    copies = scratch.table(same.select("a", F.explode("ids").alias("b")).where("a < b"), "copies")
    single = checked_join(unit, copies.select(F.col("b").alias("id")), "id", "left_anti")
    n = single.count()
    bits, per_code, rotations = tables_for(n, dim, threshold, recall)
    mean, projections = learn(single, dim, rotations)
    share, flips, spread = measure(single, mean, projections, bits, per_code, threshold)
    rng, every = np.random.default_rng(8), False
    while n and share[-1] < recall and not every:
        wanted = more_rotations(share, recall)
        every = wanted * per_code > n / 4  # then comparing all pairs is less work
        if not every:
            turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(wanted - len(projections))]
            projections = np.concatenate([projections, np.stack(turns)])
            share, flips, spread = measure(single, mean, projections, bits, per_code, threshold)
    rate, total = flip_rate(threshold), len(projections) * dim
    most = total if every else math.ceil(max(total * rate + 5 * math.sqrt(total * rate * (1 - rate)), flips + 5 * spread))
    coded = scratch.table(single.mapInArrow(_coder(mean, projections, bits, per_code), "id long, v array<float>, code binary, keys array<long>"), "coded")

    in_bucket = Window.partitionBy("bucket")
    keyed = coded.select("id", F.posexplode("keys").alias("t", "k")).select("id", F.xxhash64("t", "k").alias("bucket"))
    if every:
        keyed = coded.select("id", F.explode(_all_pairs(n)).alias("bucket"))
    members = keyed.select("bucket", "id", F.count("*").over(in_bucket).alias("n"), F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id")).over(in_bucket)["id"].alias("leader")).where("n > 1")
    members = scratch.table(members.select("bucket", "id", "leader"), "members")
    star = members.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()

    def compare(pairs: DataFrame) -> DataFrame:
        side = lambda c: coded.select(F.col("id").alias(c), F.col("code").alias(f"code_{c}"), F.col("v").alias(f"v_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "code_a", "code_b", "v_a", "v_b")
        return scratch.table(both.mapInArrow(_rerank(threshold, most), "a long, b long, cosine double"), "near")

    first = compare(star)
    label = components(first, scratch)
    named = checked_join(members, label, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = named.groupBy("bucket").agg(F.countDistinct("root").alias("roots")).where("roots > 1").select("bucket")
    left = scratch.table(named.join(mixed, "bucket", "left_semi"), "open")
    x, y = left.alias("x"), left.alias("y")
    crossing = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    second = compare(crossing.distinct().join(star, ["a", "b"], "left_anti"))
    edges = copies.unionByName(first.select("a", "b")).unionByName(second.select("a", "b"))
    groups = components(edges, scratch).select(F.col("id").alias(key), F.col("root").alias("group_id"))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return scratch.keep(groups.join(sizes, "group_id").select(key, "group_id", "group_size", (F.col(key) == F.col("group_id")).alias("keep")))
