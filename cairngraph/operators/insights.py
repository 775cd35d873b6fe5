"""All-units forms of the tool queries: reconstruction evidence, genetics, soul, consensus across graphs, practice scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.functions import schema as S
from cairngraph.graph import CodeGraph
from cairngraph.operators import traverse

DEPRECATED = ("deprecated", "legacy", "obsolete", "old_")
RISKY = ("unsafe", "eval", "exec", "sql", "inject", "deserialize", "shell")
LINEAGE = ("contains", "inherits", "version_of", "implements")


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def profile(graph: CodeGraph) -> DataFrame:
    """Units with out_n, in_n, out_types, in_types, tests, docs, calls_out, calls_in, breaks, contained: one aggregation for each end of the edges."""
    kind = F.col("edge_type")
    count = lambda *k: F.sum(F.when(kind.isin(*k), 1).otherwise(0))
    out = graph.edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("out_n"), F.array_sort(F.collect_set("edge_type")).alias("out_types"), count("calls").alias("calls_out"), count("breaks_with").alias("breaks"))
    inc = graph.edges.groupBy(F.col("target_id").alias("id")).agg(
        F.count("*").alias("in_n"), F.array_sort(F.collect_set("edge_type")).alias("in_types"), count("tests").alias("tests"), count("documents").alias("docs"), count("calls").alias("calls_in"), count("contains").alias("contained"),
    )
    j = graph.units.join(out, "id", "left").join(inc, "id", "left")
    j = j.withColumns({c: _n(c) for c in ("out_n", "in_n", "calls_out", "calls_in", "tests", "docs", "breaks", "contained")})
    return j.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("out_types", "in_types")})


# -- reconstruction


def resurrect_search(graph: CodeGraph, query: str, limit: int = 20) -> DataFrame:
    """(id, name, deprecated) of units whose name or documentation holds the query."""
    q = query.lower()
    old = F.greatest(*[_low("name").contains(w) | _low("doc_summary").contains(w) for w in DEPRECATED])
    out = graph.units.where(_low("name").contains(q) | _low("doc_summary").contains(q)).select("id", "name", old.alias("deprecated")).orderBy("id")
    return out.limit(limit) if limit > 0 else out


def resurrect_evidence(graph: CodeGraph, query: str) -> DataFrame:
    """(id, source, name): tests, docs and signatures that tell of what the query names."""
    q = query.lower()
    test = (F.col("unit_type") == "test") & (_low("name").contains(q) | _low("doc_summary").contains(q))
    doc = (F.col("unit_type") == "doc") & _low("doc_summary").contains(q)
    return graph.units.where(test | doc | _low("signature").contains(q)).select("id", F.col("unit_type").alias("source"), "name")


def resurrect_attempt(graph: CodeGraph, query: str) -> DataFrame:
    """(evidence, status, confidence): one row."""
    g = resurrect_evidence(graph, query).agg(F.count("*").alias("evidence"))
    n = F.col("evidence")
    return g.select("evidence", F.when(n > 0, "partial_reconstruction").otherwise("insufficient_evidence").alias("status"), F.when(n > 5, "high").when(n > 2, "medium").otherwise("low").alias("confidence"))


def resurrect_verify(graph: CodeGraph, name: str) -> DataFrame:
    """(refs, has_tests, status, confidence): one row."""
    hit = graph.units.where(_low("name").contains(name.lower()))
    g = hit.agg(F.count("*").alias("refs"), F.coalesce(F.max(F.col("unit_type") == "test"), F.lit(False)).alias("has_tests"))
    r = F.col("refs")
    return g.select("refs", "has_tests", F.when(r > 0, "plausible").otherwise("unverifiable").alias("status"), F.when(F.col("has_tests") & (r > 2), "high").when(r > 0, "medium").otherwise("low").alias("confidence"))


def resurrect_history(graph: CodeGraph) -> DataFrame:
    """(new_id, new_name, old_id, old_name) of all versions."""
    u = graph.units
    e = graph.edges_of("version_of").select(F.col("source_id").alias("new_id"), F.col("target_id").alias("old_id"))
    return e.join(u.select(F.col("id").alias("new_id"), F.col("name").alias("new_name")), "new_id").join(u.select(F.col("id").alias("old_id"), F.col("name").alias("old_name")), "old_id").select("new_id", "new_name", "old_id", "old_name")


# -- genetics


def naming_style(name: Column) -> Column:
    first = F.substring(name, 1, 1)
    return F.when(name.contains("_"), "snake_case").when((F.upper(first) == first) & (F.lower(first) != first), "PascalCase").otherwise("camelCase")


def genetics_dna(graph: CodeGraph) -> DataFrame:
    """(id, naming, complexity, is_async, out_types, in_types, out_n, in_n, has_tests, has_docs, stability_score)."""
    p = profile(graph)
    return p.select("id", naming_style(F.col("name")).alias("naming"), "complexity", "is_async", "out_types", "in_types", "out_n", "in_n", (F.col("tests") > 0).alias("has_tests"), (F.col("docs") > 0).alias("has_docs"), "stability_score")


def genetics_lineage(graph: CodeGraph, unit_id=None, max_depth: int = 5) -> DataFrame:
    """(root, id, depth): ancestors by containment, inheritance, version and implementation, at their shortest depth."""
    roots = graph.units.select("id") if unit_id is None else [unit_id]
    return traverse.bfs(graph, roots, LINEAGE, "in", max_depth, paths=False).where("depth > 0")


def genetics_mutations(graph: CodeGraph) -> DataFrame:
    """(id, mutation, severity): complexity, stability, breaking, and once for each parent that holds a unit of the same type named in another style."""
    p = profile(graph).select("id", "complexity", "stability_score", "change_count", "breaks")
    flag = lambda c, name, severity: F.when(c, F.struct(F.lit(name).alias("mutation"), F.lit(severity).alias("severity")))
    own = F.array_compact(
        F.array(
            flag(F.col("complexity") > 20, "complexity_mutation", "medium"),
            flag((F.col("stability_score") < 0.3) & (F.col("change_count") > 5), "stability_mutation", "high"),
            flag(F.col("breaks") > 0, "breaking_mutation", "high"),
        )
    )
    first = p.select("id", F.inline(own))
    # siblings are counted by style, not paired, so a parent of many children costs as much as they are
    snake = F.col("name").contains("_")
    kids = graph.edges_of("contains").select(F.col("source_id").alias("parent"), F.col("target_id").alias("id")).distinct().join(graph.units.select("id", "unit_type", snake.alias("snake")), "id")
    mix = kids.groupBy("parent", "unit_type").agg(F.sum(F.when(F.col("snake"), 1).otherwise(0)).alias("with_"), F.sum(F.when(F.col("snake"), 0).otherwise(1)).alias("without"))
    odd = kids.join(mix.where("with_ > 0 and without > 0"), ["parent", "unit_type"], "left_semi").select("id", F.lit("naming_mutation").alias("mutation"), F.lit("low").alias("severity"))
    return first.unionByName(odd)


def genetics_diseases(graph: CodeGraph) -> DataFrame:
    """(id, disease, severity): god_object, circular_dependency, feature_envy, untested, orphan_code."""
    pair = graph.edges.select("source_id", "target_id").distinct()
    back = pair.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"))
    circular = pair.join(back, ["source_id", "target_id"], "left_semi").select(F.col("source_id").alias("id"), F.lit(True).alias("circular")).distinct()
    p = profile(graph).join(circular, "id", "left")
    flag = lambda c, name, severity: F.when(c, F.struct(F.lit(name).alias("disease"), F.lit(severity).alias("severity")))
    found = F.array_compact(
        F.array(
            flag(F.col("out_n") > 20, "god_object", "high"), flag(F.col("circular"), "circular_dependency", "high"),
            flag((F.col("calls_out") > 10) & (F.col("calls_out") > 3 * F.col("calls_in")), "feature_envy", "medium"),
            flag((F.col("tests") == 0) & (F.col("unit_type") == "function"), "untested", "medium"), flag((F.col("in_n") > 0) & (F.col("in_n") == F.col("contained")), "orphan_code", "medium"),
        )
    )
    return p.select("id", F.inline(found))


# -- soul


def soul_extract(graph: CodeGraph) -> DataFrame:
    """(id, purpose, values) of every unit."""
    p = profile(graph)
    does = F.when(F.col("calls_out") > 0, "orchestrates calls").when(F.col("unit_type") == "test", "verifies behavior").when(F.col("unit_type") == "doc", "documents knowledge").otherwise("provides functionality")
    kept = F.array_compact(
        F.array(
            F.when(F.col("tests") > 0, "correctness"), F.when(F.col("docs") > 0, "documentation"), F.when(F.col("stability_score") > 0.8, "stability"),
            F.when(F.col("complexity") < 5, "simplicity"), F.when(F.col("is_async"), "concurrency"),
        )
    )
    return p.select("id", F.concat_ws(" ", "visibility", "unit_type", F.lit("that"), does).alias("purpose"), kept.alias("values"))


def soul_compare(graph: CodeGraph, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity, verdict) of pairs (a, b) of ids."""
    p = profile(graph).select("id", "unit_type", "is_async", "complexity", "out_types")
    side = lambda c: p.select(*[F.col(x).alias(f"{x}_{c}") for x in p.columns])
    j = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    shared = F.size(F.array_intersect("out_types_a", "out_types_b")) / F.greatest(F.size("out_types_a"), F.size("out_types_b"), F.lit(1))
    s = (
        F.when(F.col("unit_type_a") == F.col("unit_type_b"), 0.3).otherwise(0.0) + F.when(F.col("is_async_a") == F.col("is_async_b"), 0.1).otherwise(0.0)
        + F.when(F.abs(F.col("complexity_a") - F.col("complexity_b")) < 5, 0.2).otherwise(0.0) + 0.4 * shared
    )
    return j.select("a", "b", s.alias("similarity"), F.when(F.round(s, 9) > 0.8, "same_soul").when(F.round(s, 9) > 0.5, "related_souls").otherwise("different_souls").alias("verdict"))


def soul_preserve(graph: CodeGraph, new_language: str) -> DataFrame:
    """(id, from_language, to_language, out_n, in_n, risk): what moving a unit to another language puts at risk."""
    o = F.col("out_n")
    return profile(graph).select("id", F.col("language").alias("from_language"), F.lit(new_language).alias("to_language"), "out_n", "in_n", F.when(o > 10, "high").when(o > 5, "medium").otherwise("low").alias("risk"))


def soul_reincarnate(graph: CodeGraph, limit: int = 10) -> DataFrame:
    """(id, soul_id, dependencies): the first ``limit`` names that a unit leads to, in the order of targets."""
    e = graph.edges.join(graph.units.select(F.col("id").alias("target_id"), "name"), "target_id")
    deps = e.groupBy(F.col("source_id").alias("id")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("target_id", "edge_ord", "name"))), 1, limit), lambda x: x["name"]).alias("dependencies"))
    return graph.units.select("id").join(deps, "id", "left").select("id", F.concat(F.lit("soul-"), F.col("id").cast("string")).alias("soul_id"), F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"))


def soul_karma(graph: CodeGraph) -> DataFrame:
    """(id, positive, negative, karma, level)."""
    k, s, t = F.col("complexity"), F.col("stability_score"), F.col("tests")
    pos = t * 10 + F.col("docs") * 5 + F.when(s > 0.8, 15).otherwise(0) + F.when(k < 10, 10).otherwise(0)
    neg = F.col("breaks") * 20 + F.when(k > 20, 15).otherwise(0) + F.when((t == 0) & (F.col("unit_type") == "function"), 10).otherwise(0) + F.when(s < 0.3, 10).otherwise(0)
    g = profile(graph).select("id", pos.alias("positive"), neg.alias("negative")).withColumn("karma", F.col("positive") - F.col("negative"))
    return g.withColumn("level", F.when(F.col("karma") > 30, "enlightened").when(F.col("karma") > 10, "good").when(F.col("karma") > -10, "neutral").otherwise("troubled"))


# -- across graphs: units with a column ``graph``


def omniscience_search(units: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(graph, id, name) of units whose name or qualified name holds the query."""
    q = query.lower()
    out = units.where(_low("name").contains(q) | _low("qualified_name").contains(q)).select("graph", "id", "name").orderBy("graph", "id")
    return out.limit(limit) if limit > 0 else out


def omniscience_best(units: DataFrame, tested: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(graph, id, score): the best of what a query names; ``tested`` has (graph, id)."""
    q = query.lower()
    hit = units.where(_low("name").contains(q) | _low("qualified_name").contains(q)).join(tested.select("graph", "id", F.lit(True).alias("t")).distinct(), ["graph", "id"], "left")
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    score = F.lit(0.15) + add(F.col("t"), 0.3) + add(F.col("doc_summary").isNotNull(), 0.2) + add(F.col("stability_score") > 0.7, 0.2) + add(F.col("complexity") < 10, 0.15)
    out = hit.select("graph", "id", score.alias("score")).orderBy(F.round("score", 9).desc(), "graph", "id")
    return out.limit(limit) if limit > 0 else out


def omniscience_census(units: DataFrame) -> DataFrame:
    """(graph, language, unit_type, n)."""
    return units.groupBy("graph", "language", "unit_type").agg(F.count("*").alias("n"))


def omniscience_trend(units: DataFrame, domain: str) -> DataFrame:
    """(graph, n, avg_stability, avg_changes, avg_complexity, trend) of what the domain names in each graph."""
    q = domain.lower()
    g = units.where(_low("name").contains(q) | _low("qualified_name").contains(q)).groupBy("graph").agg(
        F.count("*").alias("n"), F.avg("stability_score").alias("avg_stability"), F.avg("change_count").alias("avg_changes"), F.avg("complexity").alias("avg_complexity")
    )
    s, c, x = F.col("avg_stability"), F.col("avg_changes"), F.col("avg_complexity")
    return g.withColumn("trend", F.when((c > 5) & (s < 0.5), "declining").when((s > 0.7) & (x < 15), "stable").otherwise("emerging"))


def omniscience_vuln(graph: CodeGraph, words: Sequence[str] = RISKY) -> DataFrame:
    """(id, name, keyword, severity): units whose name or signature holds one of the words; the first in the list counts."""
    name, sig = _low("name"), _low("signature")
    first = F.coalesce(*[F.when(name.contains(w) | sig.contains(w), w) for w in words])
    out = graph.units.select("id", "name", first.alias("keyword")).where("keyword is not null")
    return out.withColumn("severity", F.when(F.col("keyword").isin("unsafe", "eval", "exec"), "high").otherwise("medium"))


def omniscience_practices(graph: CodeGraph) -> DataFrame:
    """(id, score, grade) of 100 points for tests, docs, complexity, stability, coupling and a summary."""
    add = lambda c, w: F.when(c, w).otherwise(0)
    k = F.col("complexity")
    score = add(F.col("tests") > 0, 20) + add(F.col("docs") > 0, 15) + F.when(k < 10, 20).when(k < 20, 10).otherwise(0) + add(F.col("stability_score") > 0.7, 15) + add(F.col("out_n") < 10, 15) + add(F.col("doc_summary").isNotNull(), 15)
    return profile(graph).select("id", score.alias("score")).withColumn("grade", F.when(F.col("score") >= 80, "A").when(F.col("score") >= 60, "B").when(F.col("score") >= 40, "C").otherwise("D"))


def api_usage(graph: CodeGraph, api: str) -> DataFrame:
    """(caller_id, caller, callee_id, callee): calls of what the API names."""
    u = graph.units
    callee = u.where(_low("name").contains(api.lower())).select(F.col("id").alias("callee_id"), F.col("name").alias("callee"))
    e = graph.edges_of("calls").select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("callee_id")).join(callee, "callee_id")
    return e.join(u.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id").select("caller_id", "caller", "callee_id", "callee")


def solve(units: DataFrame, problem: str, limit: int = 20) -> DataFrame:
    """(graph, id, score): share of the problem's words of 3 letters or more that a unit's name or documentation holds."""
    words = sorted({w for w in "".join(c if c.isalnum() or c == "_" else " " for c in problem.lower()).split() if len(w) >= 3})
    if not words:
        raise S.QueryError("no words")
    hits = sum((F.when(_low("name").contains(w) | _low("doc_summary").contains(w), 1).otherwise(0) for w in words), F.lit(0))
    out = units.select("graph", "id", (hits / len(words)).alias("score")).where("score > 0").orderBy(F.round("score", 9).desc(), "graph", "id")
    return out.limit(limit) if limit > 0 else out


def telepathy_insights(units: DataFrame, tested: DataFrame, limit: int = 5) -> DataFrame:
    """(graph, units, functions, test_ratio, complex_ids): per graph its size, the share of tested functions, and the first complex units."""
    j = units.join(tested.select("graph", "id", F.lit(True).alias("t")).distinct(), ["graph", "id"], "left")
    fn = F.col("unit_type") == "function"
    g = j.groupBy("graph").agg(
        F.count("*").alias("units"), F.sum(F.when(fn, 1).otherwise(0)).alias("functions"), F.sum(F.when(fn & F.col("t"), 1).otherwise(0)).alias("tested"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("complexity") > 15, F.col("id")))), 1, limit).alias("complex_ids"),
    )
    return g.select("graph", "units", "functions", (F.col("tested") / F.greatest(F.lit(1), F.col("functions"))).alias("test_ratio"), "complex_ids")


def telepathy_consensus(units: DataFrame, query: str) -> DataFrame:
    """(matching, total, level): how many graphs have what a query names: universal, majority, minority or none."""
    has = F.max(F.when(_low("name").contains(query.lower()), 1).otherwise(0))
    g = units.groupBy("graph").agg(has.alias("has")).agg(F.coalesce(F.sum("has"), F.lit(0)).alias("matching"), F.count("*").alias("total"))
    m, t = F.col("matching"), F.col("total")
    return g.withColumn("level", F.when(m == 0, "none").when(m == t, "universal").when(m * 2 > t, "majority").otherwise("minority"))
