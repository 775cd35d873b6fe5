"""The catalogue queries on the small graph: golden rows, empty graphs, unknown ids, cycles."""

from __future__ import annotations

import pytest
from fixtures import cycle, ids, rich, rows

from cairngraph.functions import schema as S
from cairngraph.graph import CodeGraph
from cairngraph.operators import catalogue as Q
from cairngraph.operators import impact, traverse, vectors


@pytest.fixture(scope="module")
def g(spark):
    return rich(spark)


def test_lookup(g):
    assert ids(Q.symbol_lookup(g, "process_payment")) == [1]
    assert ids(Q.symbol_lookup(g, "valid", "contains")) == [2, 6, 7, 8]
    assert ids(Q.symbol_lookup(g, "LOG", "prefix")) == [10, 11]
    assert ids(Q.symbol_lookup(g, "logn", "fuzzy")) == [10]
    assert ids(Q.symbol_lookup(g, "login", "fuzzy", threshold=3, by_distance=True))[0] == 10
    assert ids(Q.symbol_lookup(g, "valid", "contains", unit_types=["type"], limit=1)) == [7]
    with pytest.raises(S.QueryError):
        Q.symbol_lookup(g, "x", "odd")


def test_dependencies(g):
    d = {r["id"]: (r["depth"], r["path"]) for r in Q.dependency_graph(g, 10, 3).collect()}
    assert d == {1: (1, [10, 1]), 2: (2, [10, 1, 2]), 3: (2, [10, 1, 3]), 4: (2, [10, 1, 4])}
    back = {r["id"]: (r["depth"], r["path"]) for r in Q.reverse_dependency(g, 2, 3).collect()}
    assert back == {1: (1, [2, 1]), 10: (2, [2, 1, 10])}
    assert ids(Q.dependency_graph(g, 10, 3, transitive=False)) == [1]


def test_hierarchy_and_containment(g):
    assert rows(Q.type_hierarchy(g, 6, ancestors=False), "id", "relation", "depth") == [(7, "implements", -1), (8, "inherits", -1)]
    assert rows(Q.type_hierarchy(g, 8), "id", "relation", "depth") == [(6, "inherits", 1)]
    assert sorted(ids(Q.containment(g, 0))) == [1, 2, 3, 4, 5, 6, 7, 8, 12]


def test_call_graph(g):
    nodes, sites = Q.call_graph(g, 1, "both", 2)
    assert rows(nodes, "id", "depth") == [(1, 0), (2, 1), (3, 1), (10, 1)]
    assert rows(sites, "caller_id", "callee_id", "line") == [(1, 2, 20), (1, 3, 30), (10, 1, 15)]


def test_patterns(g):
    assert ids(Q.pattern_match(g, "function { calls: [validate_input, send_notification] }")) == [1]
    assert ids(Q.pattern_match(g, "class { inherits: Validator }")) == [8]
    assert ids(Q.pattern_match(g, "function { complexity: >8 }")) == [12]
    assert ids(Q.pattern_match(g, "async function")) == []
    with pytest.raises(S.QueryError):
        Q.pattern_match(g, "nonsense")


def test_impact(g):
    assert rows(Q.impact_analysis(g, 1)) == [(1, 10, 1, pytest.approx(0.4), True)]
    got = {r["id"]: r["risk"] for r in Q.impact_analysis(g, 3).collect()}
    assert got == {1: pytest.approx(0.45), 10: pytest.approx(1 / 3)}
    s = Q.impact_summary(Q.impact_analysis(g, 6)).first()
    assert (s["impacted"], s["untested"], round(s["overall_risk"], 6), len(s["recommendations"])) == (2, 2, 0.8, 2)
    assert [r["passed"] for r in Q.ci_gate(g, 6).collect()] == [False]
    assert [r["passed"] for r in Q.ci_gate(g, 4, require_tests=True).collect()] == [True]


def test_tests(g):
    c = {r["id"]: (r["direct"], r["indirect"], round(r["ratio"], 6)) for r in Q.test_coverage(g).collect()}
    assert c[1] == ([5], [13], 0.6)
    assert c[2] == ([], [5], 0.333333)
    assert c[0] == ([], [], 0.0)
    assert rows(Q.test_gap(g), "id", "priority") == [(12, 1.0)]


def test_scores(g):
    s = {r["id"]: round(r["overall"], 6) for r in Q.stability_analysis(g).collect()}
    assert (s[1], s[2], s[12]) == (0.556602, 0.667391, 0.442857)
    assert [(r["id"], round(r["risk"], 6)) for r in Q.prophecy(g, 6, 0.1).collect()] == [(12, 0.65), (1, 0.2), (10, 0.2), (2, 0.1), (3, 0.1), (11, 0.1)]
    assert [(r["id"], round(r["score"], 6)) for r in Q.hotspots(g, 3).collect()] == [(12, 0.4975), (1, 0.378167), (10, 0.2535)]
    assert {r["id"]: r["trend"] for r in Q.temporal_evolution(g).collect()}[12] == "highly volatile"
    assert Q.collective_patterns(g).count() == 0


def test_coupling(g):
    got = rows(Q.coupling_detection(g, 1, 0.5), "unit_a", "unit_b", "strength", "kind")
    assert got == [(1, 2, 1.0, "explicit"), (1, 3, 1.0, "explicit"), (1, 4, 1.0, "explicit")]
    hidden = rows(Q.hidden_coupling(g, 7, 0.5))
    assert hidden == [(7, 8, 1.0)]
    assert len(rows(Q.hidden_coupling(g, 7, 0.0))) == 3


def test_dead_code(g):
    assert [r["name"] for r in Q.dead_code(g).collect()] == ["InputValidator", "UserValidator", "Validator", "helper_internal", "logout"] or [r["id"] for r in Q.dead_code(g).collect()] == [8, 7, 6, 12, 11]


def test_concepts_and_migration(g):
    assert [(r["id"], r["role"], round(r["relevance"], 6)) for r in Q.concept_mapping(g, "payment").collect()] == [(1, "usage", 1.0), (4, "definition", 0.7), (5, "test", 0.7)]
    assert [(r["id"], r["safety"]) for r in Q.migration_path(g, 1, 3).collect()] == [(3, "safe"), (10, "safe"), (1, "caution")]


def test_paths(g):
    r = traverse.shortest_path(g, 10, 4).first()
    assert (r["found"], r["path"], r["edge_types"], r["length"]) == (True, [10, 1, 4], ["calls", "uses_type"], 2)
    assert traverse.shortest_path(g, 2, 10).first()["found"] is False
    assert traverse.shortest_path(g, 2, 2).first()["path"] == [2]
    assert rows(traverse.all_paths(g, 10, 3, 3)) == [([10, 1, 3], 2)]
    assert traverse.dfs(g, 10, ("calls",)) == [(10, 0), (1, 1), (2, 2), (3, 2)]


def chain(spark, n):
    """A unit that calls the next one, and imports the first every tenth time."""
    u = spark.range(n).selectExpr("id", "'function' as unit_type", "concat('function_', id) as name")
    calls = spark.range(1, n).selectExpr("id - 1 as source_id", "id as target_id", "'calls' as edge_type", "1 as edge_ord")
    imports = spark.range(10, n, 10).selectExpr("id as source_id", "cast(0 as bigint) as target_id", "'imports' as edge_type", "1 as edge_ord")
    return CodeGraph(u, calls.unionByName(imports))


def test_long_chains(spark):
    """Ten thousand hops take rounds by tiles, not by hops."""
    n = 10_000
    c = chain(spark, n)
    r = traverse.shortest_path(c, 0, n - 1).first()
    assert (r["found"], r["length"], r["path"], set(r["edge_types"])) == (True, n - 1, list(range(n)), {"calls"})
    assert traverse.closure(c, spark.range(1), ("calls",)).count() == n
    assert traverse.closure(c, spark.createDataFrame([(5000,)], "id long"), ("calls",), "either").count() == n
    assert traverse.shortest_path(c, n - 1, 3, ("calls",)).first()["found"] is False


@pytest.mark.parametrize("seed", range(3))
def test_floods_and_paths(spark, seed):
    """Distances and smallest paths on random graphs, in small tiles, against breadth-first search on lists."""
    import random
    from collections import deque

    rng = random.Random(seed)
    n = 60
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(110)} - {(i, i) for i in range(n)})
    out = {i: sorted(b for a, b in edges if a == i) for i in range(n)}

    def search(roots):
        depth, queue = dict.fromkeys(roots, 0), deque(roots)
        while queue:
            for y in out[x := queue.popleft()]:
                if y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        return depth

    steps = spark.createDataFrame(edges, "at long, next long")
    roots = [rng.randrange(n), rng.randrange(n)]
    got = traverse.flood_steps(steps, spark.createDataFrame([(r,) for r in roots], "id long"), block=7, tile=5)
    assert {r["id"]: r["depth"] for r in got.collect()} == search(roots)
    g = CodeGraph(spark.range(n).selectExpr("id"), steps.selectExpr("at as source_id", "next as target_id", "'calls' as edge_type", "1 as edge_ord"))
    smallest = {r["id"]: r["path"] for r in traverse.bfs(g, [roots[0]], ("calls",)).collect()}
    far = max(smallest, key=lambda i: (len(smallest[i]), i))
    assert traverse.shortest_path(g, roots[0], far).first()["path"] == smallest[far]
    assert {r["id"]: r["depth"] for r in traverse.bfs(g, [roots[0]], ("calls",), paths=False).collect()} == {i: len(p) - 1 for i, p in smallest.items()}


def test_unknown_ids(g):
    for call in (lambda: Q.dependency_graph(g, 999), lambda: traverse.shortest_path(g, 1, 999), lambda: Q.test_coverage(g, 999), lambda: Q.migration_path(g, 999, 1)):
        with pytest.raises(S.UnitNotFound):
            call()


def test_cycles(spark):
    c = cycle(spark)
    assert rows(Q.dependency_graph(c, 0, 100), "id", "depth") == [(1, 1), (2, 2)]
    assert traverse.cycle_witness(c, c.edges) == [0, 1, 2, 0]
    v = Q.drift(c, [{"kind": "cyclic", "prefix": "cycle"}, {"kind": "naming", "prefix": "cycle", "pattern": "f*"}])
    assert v.count() == 3
    assert Q.conformance(v, 2).first()["conformance"] == 0.5


def test_empty(spark):
    e = CodeGraph.empty(spark)
    for df in (
        e.stats().where("kind = 'unit_type'"), Q.symbol_lookup(e, "x"), Q.dependency_graph(e), Q.impact_analysis(e), Q.test_coverage(e), Q.prophecy(e), Q.hotspots(e), Q.dead_code(e), Q.coupling_detection(e), Q.type_hierarchy(e), Q.concept_mapping(e, "x"),
        Q.drift(e, []), impact.analyze(e), impact.regression_predict(e), impact.health(e),
    ):
        assert df.count() == 0


def test_build(spark):
    g = rich(spark)
    bad = CodeGraph(g.units, g.edges.unionByName(spark.createDataFrame([(1, 1, "calls", 1.0, 0, 0, 9), (1, 999, "calls", 1.0, 0, 0, 9)], S.EDGES)))
    with pytest.raises(S.InvalidEdge):
        bad.build()
    assert rows(bad.rejected_edges(), "target_id", "reason") == [(1, "self_edge"), (999, "missing_endpoint")]
    assert bad.build(strict=False).edges.count() == g.edges.count()


def test_store(spark, tmp_path):
    g = rich(spark)
    g.save(str(tmp_path / "g"))
    back = CodeGraph.load(spark, str(tmp_path / "g"))
    assert rows(back.units.select("id", "name", "doc_summary").na.fill("")) == rows(g.units.select("id", "name", "doc_summary").na.fill(""))
    assert back.edges.count() == 20
    again = CodeGraph.of_json(g.to_json())
    assert rows(again.units, "id", "name") == rows(g.units, "id", "name")
    assert rows(again.edges, "source_id", "target_id", "edge_type") == rows(g.edges, "source_id", "target_id", "edge_type")


def test_versions(spark, tmp_path):
    g = rich(spark)
    g.save(str(tmp_path / "g"))
    info = CodeGraph.info(spark, str(tmp_path / "g"))
    assert (info["schema_version"], info["n_units"], info["n_edges"]) == (S.SCHEMA_VERSION, 14, 20) and info["bytes"] > 0
    back = CodeGraph.load(spark, str(tmp_path / "g"))
    assert rows(back.edges_to(1), "source_id", "edge_type") == rows(g.edges_to(1), "source_id", "edge_type") and back.has_edge(1, 2, "calls")
    old = str(tmp_path / "old")
    g.units.drop("content_hash", "complexity").write.parquet(old + "/units")
    g.edges.drop("context").write.partitionBy("edge_type").parquet(old + "/edges")
    spark.createDataFrame([(1, 14, 20)], "schema_version int, n_units long, n_edges long").write.json(old + "/meta")
    early = CodeGraph.load(spark, old)
    assert early.units.select("complexity").distinct().collect()[0][0] == 0 and early.edges.columns == S.EDGES.fieldNames()
    with pytest.raises(S.StorageError):
        CodeGraph.load(spark, old, "strict")
    spark.createDataFrame([(99, 14, 20)], "schema_version int, n_units long, n_edges long").write.mode("overwrite").json(old + "/meta")
    with pytest.raises(S.StorageError):
        CodeGraph.load(spark, old)
    assert CodeGraph.load(spark, old, "off").edges.count() == 20


def test_tools(g):
    from cairngraph.operators import facade

    assert ids(facade.call(g, "core", "symbol_lookup", name="login")) == [10]
    assert facade.call(g, "impact", "path", source=10, target=4).first()["path"] == [10, 1, 4]
    with pytest.raises(S.QueryError, match="did you mean hotspots"):
        facade.call(g, "query", "hotspot")
    with pytest.raises(S.QueryError):
        facade.call(g, "nothing", "x")


def test_cache(spark):
    from cairngraph.functions.cache import FrameCache

    now = [0.0]
    c = FrameCache(2, 10.0, lambda: now[0])
    a = c.get("a", lambda: spark.range(3))
    assert c.get("a") is a and a.is_cached and c.metrics.hit_rate == 0.5
    c.put("b", spark.range(1))
    c.get("a")
    c.put("c", spark.range(2))
    assert c.get("b") is None and c.metrics.evictions == 1 and len(c) == 2
    now[0] = 11.0
    assert c.get("a") is None and not a.is_cached
    c.clear()
    assert len(c) == 0


def test_enhanced_impact(g):
    got = rows(impact.analyze(g, 2, "deletion"), "id", "distance", "impact_type")
    assert got == [(1, 1, "will_break"), (10, 2, "might_break")]
    r = impact.blast_radius(g, impact.analyze(g, 2, "deletion")).first()
    assert (r["nodes"], r["files"], r["functions"], r["lines"], r["risk"]) == (2, 2, 2, 50, "medium")
    assert {x["advice"] for x in impact.mitigations(impact.blast_radius(g, impact.analyze(g, 2, "deletion")), "deletion").collect()} == {"deprecate before deleting", "write tests first"}
    p = {r["test_id"]: (round(r["probability"], 6), r["bucket"]) for r in impact.regression_predict(g, 1).collect()}
    assert p == {5: (0.85, "likely"), 13: (0.375, "recommended")}
    assert rows(impact.minimal_test_set(g, 1)) == [(1, 5)]
    assert impact.health_status(impact.health(g)).first()["status"] == "warn"
    assert '"nodes"' in impact.as_json(g, impact.analyze(g, 2)).first()["json"]
    with pytest.raises(S.QueryError):
        impact.analyze(g, 1, "odd")


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "id long, vector array<float>")
    got = [(r["id"], round(r["score"], 6)) for r in vectors.semantic_search(v, [1.0, 0.0], 0, 0.0).collect()]
    assert got[:2] == [(1, 1.0), (3, 0.707107)]
    assert {i for i, s in got[2:]} == {2, 4, 5, 6} and all(s == 0 for _, s in got[2:])
    assert ids(vectors.similarity(v, 1, 1)) == [3]
    assert ids(vectors.index_search(v, [1.0, 0.0], 10)) == [1, 3, 2]
    with pytest.raises(S.DimensionMismatch):
        vectors.semantic_search(v, [])
    with pytest.raises(S.UnitNotFound):
        vectors.similarity(v, 77)
