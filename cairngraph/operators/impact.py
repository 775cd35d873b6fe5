"""Change impact by kind of change, blast radius, test selection and the composite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.functions import schema as S
from cairngraph.graph import CodeGraph
from cairngraph.operators import catalogue, traverse

REACH = ("calls", "imports", "inherits", "implements", "uses_type", "ffi_binds", "returns", "param_type", "overrides")
TEST_REACH = ("calls", "imports", "tests", "references", "uses_type")
BASE = {"deletion": 0.95, "signature": 0.85, "rename": 0.80, "behavior": 0.50, "move": 0.40}


def _tested(graph: CodeGraph) -> DataFrame:
    return graph.edges_of("tests").select(F.col("target_id").alias("id"), F.lit(True).alias("tested")).distinct()


def analyze(graph: CodeGraph, unit_id=None, change: str = "behavior", max_depth: int = 3) -> DataFrame:
    """(root, id, distance, impact_type, break_probability, path) of everything a change of a unit reaches; path leads from the unit hit to the root."""
    if change not in BASE:
        raise S.QueryError(f"unknown change {change}")
    reach = traverse.bfs(graph, catalogue._roots(graph, unit_id), REACH, "in", max_depth).where("depth > 0").join(_tested(graph), "id", "left")
    d, tested = F.col("depth"), F.coalesce("tested", F.lit(False))
    kind = {
        "deletion": F.when(d == 1, "will_break").otherwise("might_break"), "signature": F.when(d == 1, "will_break").otherwise("needs_review"),
        "rename": F.when(d == 1, "will_break").otherwise("needs_review"), "behavior": F.when(tested, "needs_review").otherwise("might_break"),
        "move": F.when(d == 1, "might_break").otherwise("safe"),
    }[change]
    return reach.select("root", "id", d.alias("distance"), kind.alias("impact_type"), (F.lit(BASE[change]) / (1 + 0.5 * d)).alias("break_probability"), F.reverse("path").alias("path"))


def blast_radius(graph: CodeGraph, impact: DataFrame) -> DataFrame:
    """(root, nodes, files, modules, functions, tests, lines, will_break, risk) of analyze(): one row for each root."""
    u = graph.units.select("id", "file_path", "qualified_name", "unit_type", "start_line", "end_line")
    module = F.regexp_replace("qualified_name", r"(\.|::)[^.:]*$", "")
    j = impact.join(u, "id")
    g = j.groupBy("root").agg(
        F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"), F.countDistinct(module).alias("modules"),
        F.sum(F.when(F.col("unit_type").isin(*S.CALLABLE), 1).otherwise(0)).alias("functions"), F.sum(F.when(F.col("unit_type") == "test", 1).otherwise(0)).alias("tests"),
        F.sum(F.greatest(F.lit(1), F.col("end_line") - F.col("start_line"))).alias("lines"), F.sum(F.when(F.col("impact_type") == "will_break", 1).otherwise(0)).alias("will_break"),
    )
    b, f, n = F.col("will_break"), F.col("files"), F.col("nodes")
    risk = F.when((b > 10) | (f > 20), "critical").when((b > 3) | (f > 10) | (n > 30), "high").when((b > 0) | (n > 10), "medium").otherwise("low")
    return g.withColumn("risk", risk)


def mitigations(radius: DataFrame, change: str) -> DataFrame:
    """(root, advice) of blast_radius(), a row for each piece of advice."""
    first = {"deletion": "deprecate before deleting", "signature": "keep the old signature for a while", "rename": "leave an alias", "behavior": "test the new behaviour", "move": "re-export from the old place"}[change]
    say = F.array_compact(F.array(F.lit(first), F.when(F.col("risk").isin("high", "critical"), "roll out in steps"), F.when(F.col("tests") == 0, "write tests first")))
    return radius.select("root", F.explode(say).alias("advice"))


def as_json(graph: CodeGraph, impact: DataFrame) -> DataFrame:
    """(root, json): the nodes and edges of an impact, to draw."""
    n = impact.join(graph.units.select("id", "name"), "id")
    edge = F.when(F.size("path") > 1, F.struct(F.col("path")[0].alias("source"), F.col("path")[1].alias("target")))
    row = n.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("id", "name", "impact_type"))).alias("nodes"), F.array_sort(F.collect_set(edge)).alias("edges"))
    return row.select("root", F.to_json(F.struct("nodes", "edges")).alias("json"))


def regression_predict(graph: CodeGraph, unit_id=None, max_depth: int = 5) -> DataFrame:
    """(root, test_id, probability, bucket): likely for a direct test (0.85), else 0.6 / (1 + 0.3 depth): recommended above 0.3, skip below."""
    roots = catalogue._roots(graph, unit_id)
    tests = graph.units.where("unit_type = 'test'").select("id")
    reach = traverse.bfs(graph, roots, TEST_REACH, "in", max_depth, paths=False).where("depth > 0").join(tests, "id", "left_semi").select("root", F.col("id").alias("test_id"), "depth")
    direct = graph.edges_of("tests").select(F.col("target_id").alias("root"), F.col("source_id").alias("test_id"), F.lit(True).alias("direct")).distinct()
    j = reach.join(direct, ["root", "test_id"], "left")
    p = F.when(F.col("direct"), 0.85).otherwise(0.6 / (1 + 0.3 * F.col("depth")))
    return j.select("root", "test_id", p.alias("probability"), F.when(F.col("direct"), "likely").when(p > 0.3, "recommended").otherwise("skip").alias("bucket"))


def minimal_test_set(graph: CodeGraph, unit_id=None, max_depth: int = 5) -> DataFrame:
    """(root, test_id): the likely tests and the recommended ones of a probability above 0.4."""
    return regression_predict(graph, unit_id, max_depth).where((F.col("bucket") == "likely") | ((F.col("bucket") == "recommended") & (F.col("probability") > 0.4))).select("root", "test_id")


def health(graph: CodeGraph, limit: int = 20) -> DataFrame:
    """(section, id, value): risks of 0.45 or more, test gaps, hotspots of 0.55 or more and dead code, at most ``limit`` of each (0: all)."""
    cut = lambda df: df.limit(limit) if limit > 0 else df
    parts = [
        catalogue.prophecy(graph, limit, 0.45).select(F.lit("risk").alias("section"), "id", F.col("risk").alias("value")),
        cut(catalogue.test_gap(graph)).select(F.lit("test_gap").alias("section"), "id", F.col("priority").alias("value")),
        catalogue.hotspots(graph, limit, 0.55).select(F.lit("hotspot").alias("section"), "id", F.col("score").alias("value")),
        cut(catalogue.dead_code(graph)).select(F.lit("dead_code").alias("section"), "id", F.lit(0.0).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health_status(report: DataFrame) -> DataFrame:
    """(risks, gaps, hotspots, dead, status): fail with 3 risks of 0.7 or 8 gaps, warn with anything, else pass."""
    n = lambda name, more=F.lit(True): F.coalesce(F.sum(F.when((F.col("section") == name) & more, 1).otherwise(0)), F.lit(0))
    g = report.agg(n("risk").alias("risks"), n("risk", F.col("value") >= 0.7).alias("high"), n("test_gap").alias("gaps"), n("hotspot").alias("hotspots"), n("dead_code").alias("dead"))
    status = F.when((F.col("high") >= 3) | (F.col("gaps") >= 8), "fail").when(F.col("risks") + F.col("gaps") + F.col("hotspots") + F.col("dead") > 0, "warn").otherwise("pass")
    return g.select("risks", "gaps", "hotspots", "dead", status.alias("status"))


def lite_impact(graph: CodeGraph, unit_id=None, max_depth: int = 3) -> DataFrame:
    """(root, id, depth, risk) over all edges but tests and documents: 1 / depth, halved where tested."""
    kinds = tuple(k for k in S.EDGE_TYPES if k not in ("tests", "documents"))
    reach = traverse.bfs(graph, catalogue._roots(graph, unit_id), kinds, "in", max_depth, paths=False).where("depth > 0").join(_tested(graph), "id", "left")
    return reach.select("root", "id", "depth", ((F.lit(1.0) / F.col("depth")) * F.when(F.col("tested"), 0.5).otherwise(1.0)).alias("risk"))


def impact_path(graph: CodeGraph, source: int, target: int) -> DataFrame:
    """How a change of one unit reaches another: the smallest shortest path over all edges."""
    return traverse.shortest_path(graph, source, target)


def budget_projection(samples: DataFrame, days: int = 365) -> DataFrame:
    """(bytes_now, bytes_per_day, projected) of (mtime, size): the line through the first and the last sample."""
    g = samples.agg(F.min_by("size", "mtime").alias("s0"), F.max_by("size", "mtime").alias("s1"), F.min("mtime").alias("t0"), F.max("mtime").alias("t1"))
    rate = F.when(F.col("t1") > F.col("t0"), (F.col("s1") - F.col("s0")) * 86400.0 / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    return g.select(F.col("s1").alias("bytes_now"), rate.alias("bytes_per_day"), F.greatest(F.lit(0.0), F.col("s1") + rate * days).alias("projected"))
