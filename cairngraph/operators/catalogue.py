"""The 24 catalogue queries. Where a query is about one unit, ``unit_id=None`` asks for all units at once."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions import schema as S
from cairngraph.graph import CodeGraph
from cairngraph.operators import traverse

D = F.lit


def _in(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def _n(name: str) -> Column:
    """A degree that is 0 where the join found none."""
    return F.coalesce(F.col(name), F.lit(0))


def _roots(graph: CodeGraph, unit_id: int | Iterable[int] | DataFrame | None) -> DataFrame | Iterable[int]:
    if unit_id is None:
        return graph.units.select("id")
    return [unit_id] if isinstance(unit_id, int) else unit_id


def _limit(df: DataFrame, k: int) -> DataFrame:
    return df.limit(k) if k > 0 else df


# -- 1: lookup


def symbol_lookup(graph: CodeGraph, name: str, mode: str = "exact", unit_types: Sequence[str] = (), languages: Sequence[str] = (), limit: int = 0, threshold: int = 2, by_distance: bool = False) -> DataFrame:
    """Units by name: exact (case counts), prefix, contains, or fuzzy (edit distance of at most ``threshold``); limit 0 is all."""
    low, want = F.lower("name"), name.lower()
    u = graph.units.where(_in("unit_type", unit_types) & _in("language", languages))
    if mode == "exact":
        u = u.where(F.col("name") == name)
    elif mode == "prefix":
        u = u.where(low.startswith(want))
    elif mode == "contains":
        u = u.where(low.contains(want))
    elif mode == "fuzzy":
        distance = F.levenshtein(low, F.lit(want), threshold)
        u = u.where(F.abs(F.length("name") - len(want)) <= threshold).where(distance >= 0)
        if by_distance:
            return _limit(u.withColumn("distance", distance).orderBy("distance", "id"), limit)
    else:
        raise S.QueryError(f"unknown mode {mode}")
    return _limit(u.orderBy("id"), limit)


# -- 2, 3, 5, 6: dependencies, hierarchy, containment


def dependency_graph(graph: CodeGraph, unit_id=None, max_depth: int = 3, kinds: Sequence[str] = S.DEPENDENCY, transitive: bool = True) -> DataFrame:
    """(root, id, depth, path): what a unit depends on."""
    return traverse.bfs(graph, _roots(graph, unit_id), kinds, "out", max_depth if transitive else 1).where("depth > 0").drop("via")


def reverse_dependency(graph: CodeGraph, unit_id=None, max_depth: int = 3, kinds: Sequence[str] = S.DEPENDENCY, transitive: bool = True) -> DataFrame:
    """(root, id, depth, path): what depends on a unit."""
    return traverse.bfs(graph, _roots(graph, unit_id), kinds, "in", max_depth if transitive else 1).where("depth > 0").drop("via")


def type_hierarchy(graph: CodeGraph, unit_id=None, ancestors: bool = True, descendants: bool = True) -> DataFrame:
    """(root, id, relation, depth): ancestors above 0, descendants below."""
    parts = []
    for wanted, direction, sign in ((ancestors, "out", 1), (descendants, "in", -1)):
        if wanted:
            reach = traverse.bfs(graph, _roots(graph, unit_id), ("inherits", "implements"), direction).where("depth > 0")
            parts.append(reach.select("root", "id", F.col("via").alias("relation"), (F.col("depth") * sign).alias("depth")))
    if not parts:
        raise S.QueryError("neither ancestors nor descendants")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def containment(graph: CodeGraph, unit_id=None) -> DataFrame:
    """(root, id, depth) of what a unit contains, at any depth."""
    return traverse.bfs(graph, _roots(graph, unit_id), ("contains",), "out", paths=False).where("depth > 0")


# -- 4: call graph


def call_graph(graph: CodeGraph, unit_id=None, direction: str = "both", max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes (root, id, depth), call sites (root, caller_id, callee_id, line)).

    A node that both directions reach has the callees' depth; a site that both see is listed twice.
    """
    nodes, sites = [], []
    calls = graph.edges_of("calls")
    for way, far in (("callees", "out"), ("callers", "in")):
        if direction in (way, "both"):
            reach = traverse.bfs(graph, _roots(graph, unit_id), ("calls",), far, max_depth, paths=False)
            nodes.append(reach.select("root", "id", "depth", F.lit(0 if far == "out" else 1).alias("rank")))
            at = "source_id" if far == "out" else "target_id"
            inner = reach.where(F.col("depth") < max_depth) if max_depth >= 0 else reach
            sites.append(calls.join(inner.select("root", F.col("id").alias(at)), at).select("root", F.col("source_id").alias("caller_id"), F.col("target_id").alias("callee_id"), F.col("context").alias("line")))
    if not nodes:
        raise S.QueryError(f"unknown direction {direction}")
    if len(nodes) == 2:
        nodes[0] = nodes[0].unionByName(nodes[1]).groupBy("root", "id").agg(F.min_by("depth", "rank").alias("depth"))
        sites[0] = sites[0].unionByName(sites[1])
    return nodes[0].select("root", "id", "depth"), sites[0]


# -- 7: patterns

_RULES = (
    re.compile(r"^async\s+function\s*(?:\{(?P<body>.*)\})?$"),
    re.compile(r"^function\s*\{.*calls\s*:\s*\[(?P<calls>[^\]]*)\].*\}$"),
    re.compile(r"^class\s*\{.*inherits\s*:\s*(?P<base>\w+).*\}$"),
    re.compile(r"^function\s*\{.*complexity\s*:\s*>\s*(?P<over>\d+).*\}$"),
)


def pattern_match(graph: CodeGraph, pattern: str) -> DataFrame:
    """(id, confidence, rule): ``async function``, ``function { calls: [A, B] }``, ``class { inherits: X }``, ``function { complexity: >N }``."""
    text = " ".join(pattern.split())
    found = next(((i, m) for i, r in enumerate(_RULES) if (m := r.match(text))), None)
    if found is None:
        raise S.QueryError(f"no such pattern: {pattern}")
    i, m = found
    over = re.search(r"complexity\s*:\s*>\s*(\d+)", text)
    more = F.col("complexity") > int(over[1]) if over else F.lit(True)
    functions = graph.units.where("unit_type = 'function'")
    if i == 0:
        hit = functions.where(F.col("is_async") & more)
    elif i == 1:
        names = [x.strip() for x in m["calls"].split(",") if x.strip()]
        callee = graph.units.select(F.col("id").alias("target_id"), F.col("name").alias("callee"))
        called = graph.edges_of("calls").join(callee.where(F.col("callee").isin(*names)), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("callee").alias("k"))
        hit = functions.where(more).join(called.where(F.col("k") == len(set(names))), "id", "left_semi")
    elif i == 2:
        base = graph.units.where(F.col("name") == m["base"]).select(F.col("id").alias("target_id"))
        heirs = graph.edges_of("inherits").join(base, "target_id", "left_semi").select(F.col("source_id").alias("id"))
        hit = graph.units.where("unit_type = 'type'").join(heirs, "id", "left_semi")
    else:
        hit = functions.where(more)
    return hit.select("id", F.lit(1.0).alias("confidence"), F.lit(text).alias("rule"))


# -- 8, 22: vectors: operators/vectors.py

# -- 9: impact


def impact_analysis(graph: CodeGraph, unit_id=None, max_depth: int = 3, kinds: Sequence[str] = S.DEPENDENCY) -> DataFrame:
    """(root, id, depth, risk, has_tests) of everything that depends on a unit."""
    reach = traverse.bfs(graph, _roots(graph, unit_id), kinds, "in", max_depth, paths=False).where("depth > 0")
    out = reach.join(graph.in_degree("tests", name="tests"), "id", "left").join(graph.degree("couples_with", name="couples"), "id", "left")
    risk = F.lit(0.4) / (1 + F.col("depth")) + F.when(_n("tests") > 0, 0.2).otherwise(0.6) + F.least(F.lit(0.3), _n("couples") * 0.05)
    return out.select("root", "id", "depth", F.least(F.lit(1.0), risk).alias("risk"), (_n("tests") > 0).alias("has_tests"))


def impact_summary(impact: DataFrame) -> DataFrame:
    """(root, impacted, untested, overall_risk, recommendations) of impact_analysis; roots that nothing depends on aren't listed."""
    g = impact.groupBy("root").agg(F.count("*").alias("impacted"), F.sum(F.when(F.col("has_tests"), 0).otherwise(1)).alias("untested"), F.least(F.lit(1.0), F.avg("risk")).alias("overall_risk"))
    say = F.array_compact(
        F.array(
            F.when(F.col("untested") > 0, F.concat(F.lit("add tests for "), F.col("untested").cast("string"), F.lit(" untested units"))),
            F.when(F.col("impacted") > 10, F.lit("large impact: change in steps")),
            F.when(F.col("overall_risk") > 0.7, F.lit("high risk: review with care")),
        )
    )
    return g.withColumn("recommendations", say)


def ci_gate(graph: CodeGraph, unit_id=None, max_risk: float = 0.6, max_depth: int = 3, require_tests: bool = False) -> DataFrame:
    """(root, overall_risk, untested, passed): units that nothing depends on pass; risks are compared to nine digits."""
    s = impact_summary(impact_analysis(graph, unit_id, max_depth))
    roots = traverse.roots_of(graph, _roots(graph, unit_id))
    j = roots.join(s, "root", "left").select("root", F.coalesce("overall_risk", F.lit(0.0)).alias("overall_risk"), _n("untested").alias("untested"))
    return j.withColumn("passed", (F.round("overall_risk", 9) <= max_risk) & (F.lit(not require_tests) | (F.col("untested") == 0)))


# -- 10, 20: tests


def test_coverage(graph: CodeGraph, unit_id: int | None = None) -> DataFrame:
    """(id, direct, indirect, ratio): tests of a unit, tests of its callers that aren't its own, and e / (e + 1) of d + i / 2."""
    if unit_id is not None:
        graph.require(unit_id)
    one = lambda df, c: df if unit_id is None else df.where(F.col(c) == unit_id)
    tests = graph.edges_of("tests").select(F.col("target_id").alias("id"), F.col("source_id").alias("test"))
    direct = one(tests, "id").groupBy("id").agg(F.array_sort(F.collect_list("test")).alias("direct"))
    callers = one(graph.edges_of("calls"), "target_id").select(F.col("target_id").alias("callee"), F.col("source_id").alias("id")).distinct()
    indirect = callers.join(tests, "id").groupBy(F.col("callee").alias("id")).agg(F.collect_set("test").alias("around"))
    none = F.array().cast("array<bigint>")
    j = one(graph.units.select("id"), "id").join(direct, "id", "left").join(indirect, "id", "left")
    j = j.select("id", F.coalesce("direct", none).alias("direct"), F.array_sort(F.array_except(F.coalesce("around", none), F.coalesce("direct", none))).alias("indirect"))
    e = F.size("direct") + 0.5 * F.size("indirect")
    return j.withColumn("ratio", e / (e + 1))


def test_gap(graph: CodeGraph, min_changes: int = 5, min_complexity: int = 10, unit_types: Sequence[str] = ("function",)) -> DataFrame:
    """(id, change_count, complexity, reason, priority) of untested units that change much or are complex, the highest priority first."""
    u = graph.units.where(_in("unit_type", unit_types)).where((F.col("change_count") >= min_changes) | (F.col("complexity") >= min_complexity))
    u = u.join(graph.edges_of("tests").select(F.col("target_id").alias("id")), "id", "left_anti")
    part = lambda c, least: 0.5 * F.least(F.lit(2.0), F.col(c) / max(1, least))
    many, hard = F.col("change_count") >= min_changes, F.col("complexity") >= min_complexity
    reason = F.when(many & hard, "changes and complexity").when(many, "changes").otherwise("complexity")
    return u.select("id", "change_count", "complexity", reason.alias("reason"), F.least(F.lit(1.0), part("change_count", min_changes) + part("complexity", min_complexity)).alias("priority")).orderBy(F.col("priority").desc(), "id")


# -- 11: across languages


def cross_language_trace(graph: CodeGraph, unit_id=None, max_hops: int = 5) -> DataFrame:
    """(root, id, depth, language, path) of what foreign-function bindings reach in either direction."""
    reach = traverse.bfs(graph, _roots(graph, unit_id), ("ffi_binds",), "both", max_hops)
    return reach.join(graph.units.select("id", "language"), "id").where("depth > 0").select("root", "id", "depth", "language", "path")


def traced_languages(graph: CodeGraph, trace: DataFrame) -> DataFrame:
    """(root, languages): the root's and those met, in the order they are met first."""
    own = trace.select("root").distinct().join(graph.units.select(F.col("id").alias("root"), "language"), "root")
    rows = trace.select("root", F.struct("depth", "path", "language").alias("s")).unionByName(own.select("root", F.struct(F.lit(0).alias("depth"), F.array("root").alias("path"), "language").alias("s")))
    return rows.groupBy("root").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["language"])).alias("languages"))


# -- 12, 13, 14: usage, evolution, stability


def collective_patterns(graph: CodeGraph, unit_type: str | None = None, min_usage: int = 1, limit: int = 20) -> DataFrame:
    """(id, usage, confidence) of the units used most."""
    u = graph.units.where(F.col("collective_usage") >= min_usage)
    u = u.where(F.col("unit_type") == unit_type) if unit_type else u
    confidence = F.when(F.col("collective_usage") > 0, F.least(F.lit(1.0), F.ln(F.greatest(F.lit(1), F.col("collective_usage"))))).otherwise(0.0)
    return _limit(u.select("id", F.col("collective_usage").alias("usage"), confidence.alias("confidence")).orderBy(F.col("usage").desc(), "id"), limit)


def temporal_evolution(graph: CodeGraph, unit_id: int | None = None) -> DataFrame:
    """(id, change_count, stability_score, trend)."""
    s = F.col("stability_score")
    trend = F.when(s > 0.8, "stable").when(s > 0.5, "moderate").when(s > 0.2, "volatile").otherwise("highly volatile")
    u = graph.units if unit_id is None else graph.get(unit_id)
    return u.select("id", "change_count", "stability_score", trend.alias("trend"))


def stability_analysis(graph: CodeGraph, unit_id: int | None = None) -> DataFrame:
    """(id, change, tests, complexity, coupling, overall, advice): the four factors and their weighted sum."""
    u = graph.units if unit_id is None else graph.get(unit_id)
    j = u.join(graph.in_degree("tests", name="t"), "id", "left").join(graph.degree("couples_with", name="m"), "id", "left")
    j = j.select(
        "id",
        (F.lit(1.0) / (1 + 0.1 * F.col("change_count"))).alias("change"),
        F.least(F.lit(1.0), 0.3 * _n("t")).alias("tests"),
        (F.lit(1.0) / (1 + 0.05 * F.col("complexity"))).alias("complexity"),
        (F.lit(1.0) / (1 + 0.2 * _n("m"))).alias("coupling"),
    )
    j = j.withColumn("overall", 0.3 * F.col("change") + 0.25 * F.col("tests") + 0.25 * F.col("complexity") + 0.2 * F.col("coupling"))
    return j.withColumn("advice", F.when(F.col("overall") > 0.7, "stable").when(F.col("overall") > 0.4, "watch").otherwise("stabilise"))


# -- 15: coupling


def coupling_detection(graph: CodeGraph, unit_id: int | None = None, min_strength: float = 0.5) -> DataFrame:
    """(unit_a, unit_b, strength, kind), a row for each unordered pair: explicit, else temporal, else (one unit only) hidden."""
    low, high = F.least("source_id", "target_id").alias("unit_a"), F.greatest("source_id", "target_id").alias("unit_b")
    own = lambda df, *ends: df if unit_id is None else df.where(F.greatest(*[(F.col(c) == unit_id) for c in ends], F.lit(False)))
    explicit = own(graph.edges_of(*S.DEPENDENCY), "source_id").where(F.col("weight") >= min_strength)
    temporal = own(graph.edges_of("couples_with"), "source_id", "target_id").where(F.col("weight") >= min_strength)
    rows = explicit.select(low, high, F.col("weight").alias("strength"), F.lit(0).alias("rank"), F.lit("explicit").alias("kind"))
    rows = rows.unionByName(temporal.select(low, high, F.col("weight").alias("strength"), F.lit(1).alias("rank"), F.lit("temporal").alias("kind")))
    if unit_id is not None:
        graph.require(unit_id)
        rows = rows.unionByName(hidden_coupling(graph, unit_id, min_strength).select("unit_a", "unit_b", "strength", F.lit(2).alias("rank"), F.lit("hidden").alias("kind")))
    best = rows.groupBy("unit_a", "unit_b").agg(F.min(F.struct("rank", (-F.col("strength")).alias("minus"), "kind")).alias("b"))
    return best.select("unit_a", "unit_b", (-F.col("b.minus")).alias("strength"), F.col("b.kind").alias("kind")).orderBy(F.col("strength").desc(), "unit_a", "unit_b")


def hidden_coupling(graph: CodeGraph, unit_id: int | None = None, min_strength: float = 0.5) -> DataFrame:
    """(unit_a, unit_b, strength): Jaccard similarity of the sets of units that two units depend on.

    At min_strength 0 and for one unit, units that share nothing count as well (strength 0).
    """
    uses = graph.edges_of(*S.DEPENDENCY).select("source_id", "target_id").distinct()
    size = uses.groupBy("source_id").agg(F.count("*").alias("n"))
    mine = uses if unit_id is None else uses.where(F.col("source_id") == unit_id)
    a = mine.select(F.col("source_id").alias("x"), "target_id")
    pairs = a.join(uses.select(F.col("source_id").alias("y"), "target_id"), "target_id").where("x <> y" if unit_id is not None else "x < y").groupBy("x", "y").agg(F.count("*").alias("common"))
    if unit_id is not None and min_strength <= 0 and not mine.isEmpty():
        rest = size.select(F.col("source_id").alias("y")).where(F.col("y") != unit_id).join(pairs.select("y"), "y", "left_anti")
        pairs = pairs.unionByName(rest.select(F.lit(unit_id).cast("long").alias("x"), "y", F.lit(0).cast("long").alias("common")))
    j = pairs.join(size.select(F.col("source_id").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("source_id").alias("y"), F.col("n").alias("ny")), "y")
    j = j.withColumn("strength", F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))).where(F.col("strength") >= min_strength)
    return j.select(F.least("x", "y").alias("unit_a"), F.greatest("x", "y").alias("unit_b"), "strength")


# -- 16: dead code


def dead_code(graph: CodeGraph, unit_types: Sequence[str] = (), include_tests: bool = True, kinds: Sequence[str] = (), backward: bool = True) -> DataFrame:
    """Units that no root reaches and that reach no root, by name.

    Roots: functions named main or test_*, public units, and tests unless ``include_tests`` is false, which also keeps
    tests out of the result. ``kinds`` (none: all edges) and ``backward`` narrow the rule.
    """
    is_root = ((F.col("unit_type") == "function") & ((F.col("name") == "main") | F.col("name").startswith("test_"))) | (F.col("unit_type") == "test") | (F.col("visibility") == "public")
    roots = graph.units.where(is_root).select("id")
    live = traverse.closure(graph, roots, kinds, "either" if backward else "out")
    dead = graph.units.where(_in("unit_type", unit_types)).join(live, "id", "left_anti")
    return (dead if include_tests else dead.where("unit_type <> 'test'")).orderBy("name", "id")


# -- 17, 24: prophecy, hotspots


def prophecy(graph: CodeGraph, top_k: int = 10, min_risk: float = 0.3) -> DataFrame:
    """(id, risk, reason) of the units most likely to break."""
    u = graph.units.join(graph.degree("breaks_with", name="breaks"), "id", "left").join(graph.in_degree("tests", name="t"), "id", "left")
    s, k, c, b = F.col("stability_score"), F.col("complexity"), F.col("change_count"), _n("breaks")
    untested = (F.col("unit_type") == "function") & (_n("t") == 0)
    parts = [
        (F.when(s < 0.3, 0.4).when(s < 0.6, 0.2).otherwise(0.0), F.when(s < 0.3, "very unstable").when(s < 0.6, "unstable")),
        (F.when(k > 20, 0.3).when(k > 10, 0.15).otherwise(0.0), F.when(k > 20, "very complex").when(k > 10, "complex")),
        (F.when(c > 50, 0.2).when(c > 20, 0.1).otherwise(0.0), F.when(c > 50, "changes very often").when(c > 20, "changes often")),
        (0.2 * F.least(b, F.lit(3)) / 3.0, F.when(b > 0, "has broken with others")),
        (F.when(untested, 0.1).otherwise(0.0), F.when(untested, "untested")),
    ]
    risk = parts[0][0]
    for p, _ in parts[1:]:
        risk = risk + p
    out = u.select("id", F.least(F.lit(1.0), risk).alias("risk"), F.concat_ws("; ", *[r for _, r in parts]).alias("reason"))
    return _limit(out.where(F.col("risk") >= min_risk).orderBy(F.round("risk", 9).desc(), "id"), top_k)


def hotspots(graph: CodeGraph, top_k: int = 10, min_score: float = 0.0, unit_types: Sequence[str] = ()) -> DataFrame:
    """(id, score, change, instability, complexity, coupling) of the hottest units."""
    u = graph.units.where(_in("unit_type", unit_types)).join(graph.degree(name="deg"), "id", "left")
    u = u.select(
        "id",
        F.least(F.lit(1.0), F.col("change_count") / 50.0).alias("change"),
        (F.lit(1.0) - F.col("stability_score")).alias("instability"),
        F.least(F.lit(1.0), F.col("complexity") / 30.0).alias("complexity"),
        F.least(F.lit(1.0), _n("deg") / 20.0).alias("coupling"),
    )
    score = 0.35 * F.col("change") + 0.25 * F.col("instability") + 0.25 * F.col("complexity") + 0.15 * F.col("coupling")
    out = u.select("id", score.alias("score"), "change", "instability", "complexity", "coupling")
    return _limit(out.where(F.col("score") >= min_score).orderBy(F.round("score", 9).desc(), "id"), top_k)


# -- 18, 19: concepts, migration


def concept_mapping(graph: CodeGraph, concept: str) -> DataFrame:
    """(id, role, relevance) of the units that a word names, in names or documentation."""
    w = concept.lower()
    name, qname, doc = F.lower("name"), F.lower("qualified_name"), F.lower(F.coalesce("doc_summary", F.lit("")))
    named, told = name.contains(w) | qname.contains(w), doc.contains(w)
    hit = graph.units.where(named | told)
    heirs = graph.edges_of("inherits").join(hit.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"), F.lit(True).alias("heir")).distinct()
    role = (
        F.when(F.col("unit_type").isin("type", "trait", "module"), "definition").when(F.col("unit_type") == "test", "test")
        .when((F.col("unit_type") == "impl") | F.col("heir"), "extension").otherwise("usage")
    )
    relevance = F.when(name == w, 1.0).otherwise(F.least(F.lit(1.0), F.when(named, 0.7).otherwise(0.0) + F.when(told, 0.3).otherwise(0.0)))
    return hit.join(heirs, "id", "left").select("id", role.alias("role"), relevance.alias("relevance")).orderBy(F.col("relevance").desc(), "id")


def migration_path(graph: CodeGraph, source: int, target: int) -> DataFrame:
    """(step, id, action, safety): the target first, then the dependents from safe to risky, the source last."""
    graph.require(source, target)
    users = reverse_dependency(graph, source, 1, ("calls", "imports", "uses_type", "inherits", "implements")).select("id", "path")
    tested = graph.edges_of("tests").select(F.col("target_id").alias("id")).distinct()
    called = graph.edges_of("calls").join(tested.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"), F.lit(True).alias("around")).distinct()
    j = users.join(tested.withColumn("tested", F.lit(True)), "id", "left").join(called, "id", "left")
    rank = F.when(F.col("tested"), 0).when(F.col("around"), 1).otherwise(2)
    steps = j.select(F.lit(1).alias("part"), rank.alias("rank"), F.col("path"), "id", F.lit("update").alias("action"))
    ends = graph.spark.createDataFrame([(0, 0, [target], target, "introduce"), (2, 1, [source], source, "remove")], "part int, rank int, path array<long>, id long, action string")
    order = Window.orderBy("part", "rank", "path")
    labels = F.element_at(F.array(F.lit("safe"), F.lit("caution"), F.lit("risky")), F.col("rank") + 1)
    return steps.unionByName(ends).select(F.row_number().over(order).alias("step"), "id", "action", labels.alias("safety")).orderBy("step")


# -- 21: drift


def _glob(pattern: str) -> Column:
    body = pattern.strip("*").lower()
    name = F.lower("name")
    left, right = pattern.startswith("*"), pattern.endswith("*")
    return name.contains(body) if left and right else name.endswith(body) if left else name.startswith(body) if right else name == body


def drift(graph: CodeGraph, rules: Sequence[dict]) -> DataFrame:
    """(rule_index, rule, source_id, target_id): violations of layer, boundary, naming and cycle rules.

    Rules: {"kind": "layer", "upper", "lower"} - the lower must not depend on the upper; {"kind": "boundary", "prefix"} -
    no dependency leaves it; {"kind": "naming", "prefix", "pattern"}; {"kind": "cyclic", "prefix"}. Prefixes are plain.
    """
    dep = graph.edges_of(*S.DEPENDENCY).select("source_id", "target_id").distinct()
    q = graph.units.select("id", "qualified_name")
    named = dep.join(q.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("sq")), "source_id").join(q.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("tq")), "target_id")
    none = F.lit(None).cast("long")
    broken: dict[str, list[Column]] = {"edge": [], "unit": []}  # rules are checked together, in one pass over either table
    out = []
    for i, r in enumerate(rules):
        at = F.struct(F.lit(i).alias("rule_index"), F.lit(r["kind"]).alias("rule"))
        if r["kind"] == "layer":
            broken["edge"].append(F.when(F.col("sq").startswith(r["lower"]) & F.col("tq").startswith(r["upper"]), at))
        elif r["kind"] == "boundary":
            broken["edge"].append(F.when(F.col("sq").startswith(r["prefix"]) & ~F.col("tq").startswith(r["prefix"]), at))
        elif r["kind"] == "naming":
            broken["unit"].append(F.when(F.col("qualified_name").startswith(r["prefix"]) & ~_glob(r["pattern"]), at))
        elif r["kind"] == "cyclic":
            inside = named.where(F.col("sq").startswith(r["prefix"]) & F.col("tq").startswith(r["prefix"]))
            path = traverse.cycle_witness(graph, inside)
            v = graph.spark.createDataFrame(list(zip(path[:-1], path[1:], strict=True)), "source_id long, target_id long")
            out.append(v.select(F.lit(i).alias("rule_index"), F.lit(r["kind"]).alias("rule"), "source_id", "target_id"))
        else:
            raise S.QueryError(f"unknown rule {r['kind']}")
    if broken["edge"]:
        out.append(named.select("source_id", "target_id", F.inline(F.array_compact(F.array(*broken["edge"])))).select("rule_index", "rule", "source_id", "target_id"))
    if broken["unit"]:
        out.append(graph.units.select(F.col("id").alias("source_id"), F.inline(F.array_compact(F.array(*broken["unit"])))).select("rule_index", "rule", "source_id", none.alias("target_id")))
    if not out:
        return graph.spark.createDataFrame([], "rule_index int, rule string, source_id long, target_id long")
    union = out[0]
    for v in out[1:]:
        union = union.unionByName(v)
    return union


def conformance(violations: DataFrame, n_rules: int) -> DataFrame:
    """(violated_rules, conformance): 1 - violated / all, 1 without rules."""
    v = F.countDistinct("rule_index")
    return violations.agg(v.alias("violated_rules"), (F.lit(1.0) - v / max(1, n_rules)).alias("conformance"))
