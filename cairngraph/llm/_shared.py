"""Tables, files and joins shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import json
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.functions import storage
from cairngraph.functions.storage import remove, shared_dir

__all__ = ["remove", "shared_dir"]

#: Measured bytes of the rows of a side of a join up to which it is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20
#: Edges that one union-find holds (some 300 MB of Python).
UNION_EDGES = 2_000_000


def tune(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    shared_dir(spark)


class Scratch(storage.Scratch):
    """Tables in the shared folder, for operators that run Python over texts."""

    def __init__(self, spark: SparkSession):
        tune(spark)
        super().__init__(spark)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker, which later tasks reuse, hands the memory of its large arrays back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def publish(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file to the shared folder and returns the handle that ``local_file`` opens on any executor."""
    root = shared_dir(spark)
    unique = f"{name}-{uuid.uuid4().hex}"
    local = root[5:] if root.startswith("file:") else ""
    if local:
        path = os.path.join("/" + local.lstrip("/"), unique)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        return path
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{unique}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    sc.addFile(f"{root}/{unique}")
    return "added:" + unique


def pack_arrays(**arrays: np.ndarray) -> bytes:
    """One file of named arrays that ``open_arrays`` maps into memory."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (str(a.dtype), at, len(a))
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text = len(text).to_bytes(8, "little") + text.ljust(-(-len(text) // 8) * 8)
    return text + b"".join(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in arrays.values())


def open_arrays(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(bytes(whole[:8]), "little")
    first = 8 + -(-n // 8) * 8
    out = {}
    for name, (kind, at, size) in json.loads(bytes(whole[8 : 8 + n])).items():
        d = np.dtype(kind)
        out[name] = whole[first + at : first + at + size * d.itemsize].view(d)
    return out


def local_file(handle: str) -> str:
    return SparkFiles.get(handle[6:]) if handle.startswith("added:") else handle


def _width(c: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes as a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = len(kind.elementType.fields) + 1 if isinstance(kind.elementType, T.StructType) else 1
        return F.greatest(F.size(c), F.lit(0)) * 8 * inner + 32
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """About the bytes that the rows of a materialised table take, measured over all of them."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def checked_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """left joined with a materialised right, which is broadcast only if its measured size allows."""
    return left.join(F.broadcast(right) if bytes_of(right) <= most else right, on, how)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended to those that the table has already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def _contract(limit: int):
    """Edges to (id, root): what each ``limit`` edges of a task connect, without the roots (the smallest ids) themselves."""

    def united(edges: pa.RecordBatch | list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for b in edges:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        ids = np.fromiter(parent, np.int64, len(parent))
        for i in range(0, len(ids), 100_000):
            part = ids[i : i + 100_000]
            roots = np.array([root(int(x)) for x in part], np.int64)
            own = part != roots
            yield pa.RecordBatch.from_arrays([pa.array(part[own]), pa.array(roots[own])], names=["id", "root"])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, limit - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n >= limit:
                    yield from united(held)
                    held, n = [], 0
        yield from united(held)

    return run


def components(edges: DataFrame, scratch: Scratch, limit: int = UNION_EDGES) -> DataFrame:
    """(id, root) of all ends of the edges (a, b): root is the smallest id that is connected.

    Each task unites its share of the edges, at most ``limit`` at a time, into stars (id, root).  While an id has several
    roots, or a root has one itself, all of an id's roots are tied to its smallest one, roots are replaced by their
    own, and the stars are united again.  Small inputs are one share and done after the first round.
    """
    stars = edges.select(F.col("a").cast("long").alias("id"), F.col("b").cast("long").alias("root"))
    loops = scratch.table(stars.where("id = root").select("id").distinct(), "loops")
    stars = stars.where("id <> root")
    while True:
        stars = scratch.table(stars.hint("rebalance").mapInArrow(_contract(limit), "id long, root long"), "stars")
        low = scratch.table(stars.groupBy("id").agg(F.min("root").alias("root"), F.max("root").alias("top")), "low")
        parent = low.select("id", "root")
        above = parent.select(F.col("id").alias("root"), F.col("root").alias("up"))
        if low.where("root <> top").isEmpty() and parent.join(above, "root", "left_semi").isEmpty():
            roots = parent.select("root").distinct()
            ends = parent.unionByName(roots.select(F.col("root").alias("id"), "root"))
            alone = loops.join(ends.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"))
            return scratch.table(ends.unionByName(alone), "components")
        tied = stars.select("id", F.col("root").alias("other")).join(low, "id").where("other <> root").select(F.col("other").alias("id"), "root")
        stars = parent.unionByName(tied).join(above, "root", "left").select("id", F.coalesce("up", "root").alias("root")).where("id <> root").distinct()


def repeated_ids(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether several rows share an id that isn't null."""
    return not docs.select(key).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()
