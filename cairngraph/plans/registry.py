"""What a registered query is made of: a callable, its result in plain types, and the DuckDB text it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.plans import projection

Query = Callable[[SparkSession, str], DataFrame]
#: Digits of floating-point results, on both sides.
DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Results in types that any engine shares: 64-bit integers, rounded doubles, arrays joined by '>'."""

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(c.cast("double"), DIGITS).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(F.transform(c, lambda x: x.cast("string")), ">").alias(f.name)
        return c

    return df.select(*[plain(f) for f in df.schema])


def oracle(columns: str, body: str, *views: str, ctes: str = "") -> str:
    """DuckDB text: ``body`` over the projected ``views`` and further ``ctes``; columns are ``name:type``, type l, d, s or a."""
    cast = {
        "l": "CAST({0} AS BIGINT) AS {0}", "d": f"round(CAST({{0}} AS DOUBLE), {DIGITS}) AS {{0}}", "s": "{0}", "b": "CAST({0} AS BOOLEAN) AS {0}",
        "a": "coalesce(array_to_string([CAST(x AS VARCHAR) for x in {0}], '>'), '') AS {0}",
    }
    select = ", ".join(cast[kind].format(name) for name, kind in (c.split(":") for c in columns.split()))
    head = projection.sql("duckdb", *views) if views else ""
    more = ctes.strip().rstrip(",")
    with_clause = (head + (",\n" + more if more else "")) if head else ("WITH " + more if more else "")
    return with_clause.replace("WITH ", "WITH RECURSIVE ", 1) + f"\nSELECT {select} FROM (\n{body}\n) result"


def names(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


#: The queries of a traversal of many roots at once: every unit whose id is divisible by 50, over the whole graph.
ROOTS = "SELECT id FROM units WHERE id % 50 = 0"


def walk(kinds: tuple[str, ...], direction: str = "out", depth: int = 1_000_000, roots: str = ROOTS, name: str = "reach") -> str:
    """CTEs that end in ``name`` (root, id, depth, path): every node's smallest shortest path from each root.

    A keyed recursion: each (root, id) enters once, in the round of its depth, with the least of its paths.
    """
    return f"""
{name}_steps AS MATERIALIZED ({_steps(kinds, direction)}),
{name}(root, id, depth, path) USING KEY (root, id) AS (
  SELECT id, id, 0, [id] FROM ({roots}) r
  UNION SELECT root, to_id, b.d, b.p FROM (
    SELECT w.root, s.to_id, min({{'d': w.depth + 1, 'p': list_append(w.path, s.to_id)}}) AS b FROM {name} w JOIN {name}_steps s ON s.at_id = w.id
    WHERE w.depth < {depth} AND NOT EXISTS (SELECT 1 FROM recurring.{name} k WHERE k.root = w.root AND k.id = s.to_id) GROUP BY w.root, s.to_id) x)"""


def simple_paths(kinds: tuple[str, ...], depth: int, source: str, target: str, name: str = "paths") -> str:
    """CTEs that end in ``name`` (id, depth, path): the simple paths of at most ``depth`` edges from a unit that end in, or don't pass, another."""
    return f"""
{name}_steps AS MATERIALIZED ({_steps(kinds, "out")}),
{name}(id, depth, path) AS (
  SELECT id, 0, [id] FROM ({source}) r
  UNION ALL SELECT s.to_id, w.depth + 1, list_append(w.path, s.to_id) FROM {name} w JOIN {name}_steps s ON s.at_id = w.id
  WHERE w.depth < {depth} AND w.id <> ({target}) AND NOT list_contains(w.path, s.to_id))"""


def _steps(kinds: tuple[str, ...], direction: str) -> str:
    where = f"WHERE edge_type IN ({names(kinds)})" if kinds else ""
    out, back = f"SELECT source_id AS at_id, target_id AS to_id FROM edges {where}", f"SELECT target_id AS at_id, source_id AS to_id FROM edges {where}"
    steps = {"out": out, "in": back, "both": f"{out} UNION ALL {back}"}[direction]
    return f"SELECT DISTINCT at_id, to_id FROM ({steps}) s"


class Registry:
    """Queries by name, with their oracles."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: tidy(query(spark, sf_dir))
        if sql:
            self.oracles[name] = sql
