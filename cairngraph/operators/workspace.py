"""Several graphs at once: one table of units with a column ``context``, and joins of names between contexts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions import schema as S
from cairngraph.graph import CodeGraph

CONCEPTS = ("api", "auth", "cache", "config", "database", "error", "log", "payment", "user")
SUFFIXES = ("controller", "factory", "handler", "manager", "repository", "service")
ROLES = ("source", "target", "reference", "comparison")
DONE = ("ported", "verified", "skipped")


@dataclass
class Workspace:
    """Graphs by context id, in the order they were added."""

    graphs: dict[str, CodeGraph] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)

    def add(self, context: str, graph: CodeGraph, role: str = "source") -> Workspace:
        if role not in ROLES:
            raise S.QueryError(f"unknown role {role}")
        self.graphs[context], self.roles[context] = graph, role
        return self

    def units(self) -> DataFrame:
        """All units, with context and role."""
        out: DataFrame | None = None
        for name, g in self.graphs.items():
            one = g.units.select(F.lit(name).alias("context"), F.lit(self.roles[name]).alias("role"), *S.UNITS.fieldNames())
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise S.QueryError("empty workspace")
        return out

    def contexts(self) -> list[str]:
        return list(self.graphs)


def query_all(units: DataFrame, text: str) -> DataFrame:
    """(context, id, name) of the units whose name holds the text."""
    return units.where(F.lower("name").contains(text.lower())).select("context", "id", "name")


def _first_matches(units: DataFrame, name: str) -> DataFrame:
    w = Window.partitionBy("context").orderBy("id")
    return units.where(F.lower("name") == name.lower()).withColumn("no", F.row_number().over(w)).where("no = 1").drop("no")


def compare_symbol(units: DataFrame, name: str) -> DataFrame:
    """(context, id, unit_type, signature, same_type, same_signature) of the first unit of a name in each context, against the first context's."""
    first = Window.orderBy("context").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = _first_matches(units, name)
    return m.select("context", "id", "unit_type", "signature", (F.col("unit_type") == F.first("unit_type").over(first)).alias("same_type"), F.col("signature").eqNullSafe(F.first("signature").over(first)).alias("same_signature"))


def cross_reference(units: DataFrame, contexts: Sequence[str], names: DataFrame | None = None) -> DataFrame:
    """(name, found_in, missing_from) of every lower-cased name, or of those given in a column ``name``."""
    n = units.select(F.lower("name").alias("name"), "context").distinct()
    if names is not None:
        wanted = names.select(F.lower("name").alias("name")).distinct()
        n = wanted.join(n, "name", "left")
    every = F.array(*[F.lit(c) for c in sorted(contexts)])
    found = F.array_sort(F.collect_set("context"))
    return n.groupBy("name").agg(found.alias("found_in")).select("name", "found_in", F.array_except(every, "found_in").alias("missing_from"))


def _names(units: DataFrame) -> DataFrame:
    return units.select(F.lower("name").alias("name")).distinct()


def compare_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(common, only_a, only_b, similarity): one row; similarity is 2 common / (all a + all b)."""
    j = _names(a).withColumn("in_a", F.lit(1)).join(_names(b).withColumn("in_b", F.lit(1)), "name", "full_outer")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    g = j.agg(n(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("common"), n(F.col("in_b").isNull()).alias("only_a"), n(F.col("in_a").isNull()).alias("only_b"))
    total = 2 * F.col("common") + F.col("only_a") + F.col("only_b")
    return g.withColumn("similarity", F.when(total > 0, 2.0 * F.col("common") / F.greatest(F.lit(1), total)).otherwise(0.0))


def structural_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(directory, only_a, only_b) of the directories whose sets of names differ."""
    at = lambda u, c: u.select(F.regexp_replace("file_path", "/?[^/]*$", "").alias("directory"), "name").distinct().withColumn(c, F.lit(1))
    j = at(a, "in_a").join(at(b, "in_b"), ["directory", "name"], "full_outer").where("in_a is null or in_b is null")
    return j.groupBy("directory").agg(F.array_sort(F.collect_set(F.when(F.col("in_b").isNull(), F.col("name")))).alias("only_a"), F.array_sort(F.collect_set(F.when(F.col("in_a").isNull(), F.col("name")))).alias("only_b"))


def _counted(a: DataFrame, b: DataFrame, tests: list) -> DataFrame:
    parts = [u.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in tests]).select(F.explode(F.create_map(*[x for n, _ in tests for x in (F.lit(n), F.col(f"`{n}`"))])).alias("what", k)) for u, k in ((a, "in_a"), (b, "in_b"))]
    return parts[0].join(parts[1], "what").where("in_a > 0 or in_b > 0")


def conceptual_diff(a: DataFrame, b: DataFrame, concepts: Sequence[str] = CONCEPTS) -> DataFrame:
    """(concept, in_a, in_b): units whose name holds a word of the concept; concepts that neither side has are left out."""
    has = lambda c: F.greatest(*[F.lower("name").contains(w.lower()) for w in c.split()], F.lit(False))
    return _counted(a, b, [(c, has(c)) for c in concepts]).withColumnRenamed("what", "concept")


def pattern_diff(a: DataFrame, b: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(pattern, in_a, in_b): units whose name ends in one of the suffixes."""
    return _counted(a, b, [(f"*_{s}", F.lower("name").endswith(s)) for s in suffixes]).withColumnRenamed("what", "pattern")


def migration_plan(a: CodeGraph, b: DataFrame) -> DataFrame:
    """(step, id, name, phase, dependencies): units of a whose name b lacks: types, functions, tests, then the rest."""
    missing = a.units.join(b.select("name").distinct(), "name", "left_anti").select("id", "name", "unit_type")
    rank = F.when(F.col("unit_type").isin("type", "trait"), 0).when(F.col("unit_type") == "function", 1).when(F.col("unit_type") == "test", 2).otherwise(3)
    dep = a.edges_of(*S.DEPENDENCY).join(a.units.select(F.col("id").alias("target_id"), F.col("name").alias("n")), "target_id")
    deps = dep.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("n")).alias("dependencies"))
    phase = F.element_at(F.array(*[F.lit(x) for x in ("types", "functions", "tests", "rest")]), F.col("rank") + 1)
    j = missing.withColumn("rank", rank).join(deps, "id", "left")
    return j.select(F.row_number().over(Window.orderBy("rank", "id")).alias("step"), "id", "name", phase.alias("phase"), F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"))


# -- translations: (source_symbol, target_symbol, status, notes, version)


def translation_state(log: DataFrame) -> DataFrame:
    """The last row of each source_symbol, by version."""
    return log.groupBy("source_symbol").agg(F.max_by(F.struct("target_symbol", "status", "notes"), "version").alias("s")).select("source_symbol", "s.*")


def translation_progress(log: DataFrame) -> DataFrame:
    """(total, not_started, in_progress, ported, verified, skipped, percent): one row."""
    n = lambda *k: F.coalesce(F.sum(F.when(F.col("status").isin(*k), 1).otherwise(0)), F.lit(0))
    g = translation_state(log).agg(F.count("*").alias("total"), *[n(k).alias(k) for k in ("not_started", "in_progress", *DONE)])
    return g.withColumn("percent", F.when(F.col("total") > 0, 100.0 * (F.col("ported") + F.col("verified") + F.col("skipped")) / F.greatest(F.lit(1), F.col("total"))).otherwise(0.0))


def translation_remaining(log: DataFrame) -> DataFrame:
    return translation_state(log).where(~F.col("status").isin(*DONE))


def translation_completed(log: DataFrame) -> DataFrame:
    return translation_state(log).where(F.col("status").isin(*DONE))
