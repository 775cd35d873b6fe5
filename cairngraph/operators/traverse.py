"""Traversals.

Two engines.  ``bfs`` advances many roots together, one join a round, and carries the smallest shortest path of every
(root, node) where paths are asked for; it suits bounded depths.  ``flood`` has one set of roots and no bound: the edges
are packed once into tiles of neighbouring ids, and a round spreads distances inside every touched tile to the end, so
the number of rounds is that of the tile borders that paths cross, not that of their hops - a chain of ten thousand
units is a round or two.  Both write each round to the shared folder, so lineage doesn't grow and a lost executor costs
one round.  Row order and ties: (depth, path); parallel edges: edge_ord.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.functions import schema as S
from cairngraph.functions.storage import Scratch
from cairngraph.graph import CodeGraph

#: Rows of a frontier that is broadcast to the edges; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Neighbouring ids in a block, and edges in a tile, a block's share that is held in memory at once.
BLOCK, TILE = 1 << 16, 1 << 20
_FAR = np.iinfo(np.int64).max


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next"), "edge_type", "edge_ord")
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("next"), "edge_type", "edge_ord")
    return {"out": out, "in": back}[direction] if direction != "both" else out.unionByName(back)


def roots_of(graph: CodeGraph, roots: DataFrame | Iterable[int]) -> DataFrame:
    """One column, root: of a DataFrame's first column or of ids, which must exist."""
    if isinstance(roots, DataFrame):
        return roots.select(F.col(roots.columns[0]).cast("long").alias("root")).distinct()
    ids = list(dict.fromkeys(roots))
    graph.require(*ids)
    return graph.spark.createDataFrame([(i,) for i in ids], "root long")


def bfs(graph: CodeGraph, roots: DataFrame | Iterable[int], kinds: Iterable[str] = (), direction: str = "out", max_depth: int = -1, paths: bool = True) -> DataFrame:
    """(root, id, depth, path, via): every node within max_depth hops (-1: any) of each root, the root at depth 0.

    ``path`` is the lexicographically smallest of the shortest ones, ``via`` the type of its last edge; without ``paths``
    neither is carried.
    """
    scratch = Scratch(graph.spark)
    steps = _steps(graph.edges_of(*kinds), direction)
    steps = steps if paths else steps.select("at", "next").distinct()
    extra = [F.array("root").alias("path"), F.lit(None).cast("string").alias("via")] if paths else []
    frontier = scratch.table(roots_of(graph, roots).select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), *extra), "0")
    out, depth, n = frontier, 0, frontier.count()
    while n and (max_depth < 0 or depth < max_depth):
        side = F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier
        reached = steps.join(side, steps["at"] == side["id"]).drop("id", "depth", "at").withColumnRenamed("next", "id")
        fresh = reached.join(out.select("root", "id"), ["root", "id"], "left_anti")
        depth += 1
        if paths:
            best = fresh.groupBy("root", "id").agg(F.min(F.struct(F.concat("path", F.array("id")).alias("path"), "edge_ord", "edge_type")).alias("b"))
            new = best.select("root", "id", F.lit(depth).alias("depth"), "b.path", F.col("b.edge_type").alias("via"))
        else:
            new = fresh.select("root", "id", F.lit(depth).alias("depth")).distinct()
        frontier = scratch.table(new, str(depth))
        n = frontier.count()
        out = out.unionByName(frontier) if n else out
    return scratch.keep(out)


# -- floods: one set of roots, any depth ---------------------------------------------------------------------------


def _tiles(limit: int):
    """(block, at, next), sorted, to (block, at, next) with up to ``limit`` edges of one block packed into a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = None, [], 0

        def flush() -> pa.RecordBatch:
            at, to = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at.tobytes()]), pa.array([to.tobytes()])], names=["block", "at", "next"])

        for batch in batches:
            if not batch.num_rows:
                continue
            b, at, to = (batch.column(k).to_numpy() for k in range(3))
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (b[i] != block or n >= limit):
                    yield flush()
                    held, n = [], 0
                block = int(b[i])
                held.append((at[i:j], to[i:j]))
                n += j - i
        if held:
            yield flush()

    return run


def spread(at: np.ndarray, to: np.ndarray, ids: np.ndarray, depth: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, depths) that improve when the new ones of the known nodes spread over the edges of a tile, sorted by ``at``."""
    own, first = np.unique(at, return_index=True)
    end = np.r_[first[1:], len(at)]
    label = np.full(len(own), _FAR, np.int64)

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.minimum(np.searchsorted(own, x), max(0, len(own) - 1))
        return p, own[p] == x

    p, inside = place(ids)
    np.minimum.at(label, p[inside], depth[inside])
    start = np.unique(p[inside & new])
    waiting = start[np.argsort(label[start], kind="stable")]
    found_id, found_depth, touched = [], [], []
    front, d = waiting[:0], 0
    while len(front) or len(waiting):
        if not len(front):
            d = int(label[waiting[0]])
        k = int(np.searchsorted(label[waiting], d, "right"))
        taken, waiting = waiting[:k], waiting[k:]
        front = np.unique(np.r_[front, taken[label[taken] == d]])
        size = end[front] - first[front]
        edge = np.repeat(first[front] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        reached = np.unique(to[edge])
        p, inside = place(reached)
        better = p[inside & (label[p] > d + 1)]
        label[better] = d + 1
        touched.append(better)
        found_id.append(reached[~inside])
        found_depth.append(np.full(len(found_id[-1]), d + 1))
        front, d = better, d + 1
        waiting = waiting[~np.isin(waiting, better)] if len(waiting) else waiting  # those reached on fewer hops go with the front
    changed = np.unique(np.concatenate([*touched, waiting[:0]]))
    out_id, out_depth = np.concatenate([own[changed], *found_id]), np.concatenate([label[changed], *found_depth])
    order = np.lexsort((out_depth, out_id))
    out_id, out_depth = out_id[order], out_depth[order]
    keep = np.r_[True, out_id[1:] != out_id[:-1]] if len(out_id) else np.zeros(0, bool)
    return out_id[keep], out_depth[keep]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, next, ids, depths, news) rows to (id, depth)."""
    for batch in batches:
        for r in range(batch.num_rows):
            at, to = (np.frombuffer(batch.column(k)[r].as_py(), np.int64) for k in (0, 1))
            ids, depth, new = (batch.column(k)[r].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            out = spread(at, to, ids, depth.astype(np.int64), new.astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["id", "depth"])


def flood_steps(steps: DataFrame, roots: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(id, depth): the fewest steps (at, next) from any of the roots (id), for all that is reached."""
    scratch = Scratch(steps.sparkSession)
    of = lambda c: F.floor(F.col(c) / block).cast("long")
    sorted_ = steps.select(of("at").alias("block"), "at", "next").repartition("block").sortWithinPartitions("block", "at")
    tiles = scratch.table(sorted_.mapInArrow(_tiles(tile), "block long, at binary, next binary"), "tiles")
    known = scratch.table(roots.select(F.col(roots.columns[0]).cast("long").alias("id")).distinct().select("id", F.lit(0).cast("long").alias("depth"), F.lit(True).alias("new")), "known")
    while True:
        held = known.groupBy(of("id").alias("block")).agg(F.collect_list(F.struct("id", "depth", "new")).alias("k"), F.max("new").alias("any")).where("any")
        work = tiles.join(held, "block").select("at", "next", "k.id", "k.depth", "k.new")
        reached = work.mapInArrow(_spread, "id long, depth long")
        both = known.select("id", "depth", F.col("depth").alias("old")).unionByName(reached.select("id", "depth", F.lit(None).cast("long").alias("old")))
        merged = both.groupBy("id").agg(F.min("depth").alias("depth"), F.max("old").alias("old"))
        known = scratch.table(merged.select("id", "depth", (F.col("old").isNull() | (F.col("depth") < F.col("old"))).alias("new")), "known")
        if known.where("new").isEmpty():
            return scratch.keep(known.select("id", "depth"))


def flood(graph: CodeGraph, roots: DataFrame | Iterable[int], kinds: Iterable[str] = (), direction: str = "out") -> DataFrame:
    """(id, depth): the fewest hops from any of the roots, for all that is reached."""
    return flood_steps(_steps(graph.edges_of(*kinds), direction).select("at", "next"), roots_of(graph, roots))


def closure(graph: CodeGraph, roots: DataFrame, kinds: Iterable[str] = (), direction: str = "out") -> DataFrame:
    """(id): what any of the roots reaches, the roots among them; "either" is what they reach out, and what they reach in."""
    if direction != "either":
        return flood(graph, roots, kinds, direction).select("id")
    # both directions at once: a unit is two nodes, 2 id for the way out and 2 id + 1 for the way in
    e = graph.edges_of(*kinds)
    out = e.select((F.col("source_id") * 2).alias("at"), (F.col("target_id") * 2).alias("next"))
    back = e.select((F.col("target_id") * 2 + 1).alias("at"), (F.col("source_id") * 2 + 1).alias("next"))
    r = roots_of(graph, roots)
    both = r.select((F.col("root") * 2).alias("id")).unionByName(r.select((F.col("root") * 2 + 1).alias("id")))
    return flood_steps(out.unionByName(back), both).select(F.floor(F.col("id") / 2).cast("long").alias("id")).distinct()


def _follow(pointers: DataFrame, source: int, hops: int, scratch: Scratch) -> DataFrame:
    """(id): the nodes on the way of (id, next) pointers from a source, by doubling the jumps."""
    way = pointers.sparkSession.createDataFrame([(source,)], "id long")
    jump, far = pointers, 1
    while True:
        way = scratch.table(way.unionByName(jump.join(way, "id").select(F.col("next").alias("id"))).distinct(), "way")
        far *= 2
        if far > hops:
            return way
        later = jump.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jump = scratch.table(jump.join(later, "next").select("id", F.col("after").alias("next")), "jump")


def shortest_path(graph: CodeGraph, source: int, target: int, kinds: Iterable[str] = ()) -> DataFrame:
    """(found, path, edge_types, length): the smallest shortest path; one row, found or not. From a unit to itself: [unit].

    Floods from either end leave the units on shortest paths; each points to its smallest next one.
    """
    graph.require(source, target)
    scratch = Scratch(graph.spark)
    schema = "found boolean, path array<long>, edge_types array<string>, length int"
    if source == target:
        return graph.spark.createDataFrame([(True, [source], [], 0)], schema)
    edges = graph.edges_of(*kinds)
    ahead = flood(graph, [source], kinds, "out")
    hops = ahead.where(F.col("id") == target).first()
    if hops is None:
        return graph.spark.createDataFrame([(False, [], [], 0)], schema)
    hops = hops["depth"]
    behind = flood(graph, [target], kinds, "in").select("id", F.col("depth").alias("left"))
    on = scratch.table(ahead.where(F.col("depth") <= hops).join(behind, "id").where(F.col("depth") + F.col("left") == hops).select("id", "depth"), "on")
    a, b = on.select(F.col("id").alias("source_id"), F.col("depth").alias("da")), on.select(F.col("id").alias("target_id"), F.col("depth").alias("db"))
    steps = edges.join(a, "source_id").join(b, "target_id").where("db = da + 1")
    pointers = scratch.table(steps.groupBy(F.col("source_id").alias("id")).agg(F.min_by(F.struct("target_id", "edge_type"), F.struct("target_id", "edge_ord")).alias("s")).select("id", F.col("s.target_id").alias("next"), F.col("s.edge_type").alias("kind")), "pointers")
    way = _follow(pointers.select("id", "next"), source, hops, scratch)
    rows = way.join(on, "id").join(pointers.select("id", "kind"), "id", "left").groupBy().agg(F.array_sort(F.collect_list(F.struct("depth", "id", "kind"))).alias("p"))
    kinds_of = F.filter(F.transform("p", lambda x: x["kind"]), lambda k: k.isNotNull())
    out = rows.select(F.lit(True).alias("found"), F.transform("p", lambda x: x["id"]).alias("path"), kinds_of.alias("edge_types"), F.lit(hops).cast("int").alias("length"))
    return scratch.keep(out)


def all_paths(graph: CodeGraph, source: int, target: int, max_depth: int, kinds: Iterable[str] = ()) -> DataFrame:
    """(path, length): all simple paths of at most max_depth edges; none from a unit to itself."""
    graph.require(source, target)
    scratch = Scratch(graph.spark)
    steps = _steps(graph.edges_of(*kinds), "out").select("at", "next").distinct()
    frontier = graph.spark.createDataFrame([(source, [source])], "id long, path array<long>")
    found = graph.spark.createDataFrame([], T.StructType([T.StructField("path", T.ArrayType(T.LongType())), T.StructField("length", T.IntegerType())]))
    for depth in range(1, max_depth + 1):
        longer = steps.join(frontier, steps["at"] == frontier["id"]).where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        longer = scratch.table(longer, str(depth))
        found = found.unionByName(longer.where(F.col("id") == target).select("path", F.lit(depth).alias("length")))
        frontier = longer.where(F.col("id") != target)
        if frontier.isEmpty():
            break
    return scratch.keep(found)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges (source_id, target_id) left when nodes without an incoming or without an outgoing edge are pruned again and again."""
    scratch = Scratch(edges.sparkSession)
    e = scratch.table(edges.select("source_id", "target_id").distinct(), "edges")
    n = e.count()
    while n:
        keep = e.join(e.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi")
        keep = keep.join(e.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi").select("source_id", "target_id")
        e = scratch.table(keep, "core")
        n, before = e.count(), n
        if n == before:
            break
    return scratch.keep(e)


def cycle_witness(graph: CodeGraph, edges: DataFrame) -> list[int]:
    """The shortest cycle through the smallest unit that reaches itself, as [unit, ..., unit]; empty if there is none."""
    core = cyclic_core(edges)
    sub = CodeGraph(graph.units, core.select("*", F.lit("x").alias("edge_type"), F.lit(1).alias("edge_ord")))
    starts = core.select("source_id").distinct().orderBy("source_id")
    for r in starts.toLocalIterator():
        s = r["source_id"]
        first = core.where(F.col("source_id") == s).select(F.col("target_id").alias("id"))
        back = flood(sub, first.distinct(), (), "out").where(F.col("id") == s).first()
        if back is not None:
            near = sorted(r["id"] for r in flood(sub, [s], (), "in").where(F.col("depth") == back["depth"]).join(first.distinct(), "id").collect())
            return [s, *shortest_path(sub, near[0], s).first()["path"]]
    return []


def dfs(graph: CodeGraph, root: int, kinds: Iterable[str] = (), direction: str = "out", max_depth: int = -1, max_nodes: int = 100_000) -> list[tuple[int, int]]:
    """(id, depth) in pre-order, on the driver: for small neighbourhoods only, which ``max_nodes`` checks."""
    reach = flood(graph, [root], kinds, direction)
    reach = reach.where(F.col("depth") <= max_depth) if max_depth >= 0 else reach
    if reach.count() > max_nodes:
        raise S.DepthExceeded(f"more than {max_nodes} nodes")
    steps = _steps(graph.edges_of(*kinds), direction).join(F.broadcast(reach.select(F.col("id").alias("at"))), "at", "left_semi")
    near: dict[int, list[int]] = {}
    for r in steps.select("at", "next").distinct().orderBy("at", "next").collect():
        near.setdefault(r["at"], []).append(r["next"])
    out, seen, stack = [], set(), [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append((node, depth))
        if max_depth < 0 or depth < max_depth:
            stack += [(x, depth + 1) for x in reversed(near.get(node, [])) if x not in seen]
    return out
