"""Operators by group and name, for callers that dispatch requests: ``call(graph, "query", "hotspots", top_k=5)``."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from cairngraph.functions import schema as S
from cairngraph.graph import CodeGraph
from cairngraph.operators import catalogue, history, impact, infer, insights, text, traverse

Tool = Callable[..., Any]
#: Group -> operation -> function of a graph and parameters.
TOOLS: dict[str, dict[str, Tool]] = {
    "core": {"stats": CodeGraph.stats, "list": CodeGraph.list_units, "detail": CodeGraph.detail, "get": CodeGraph.get, "symbol_lookup": catalogue.symbol_lookup},
    "query": {
        f.__name__: f
        for f in (
            catalogue.dependency_graph, catalogue.reverse_dependency, catalogue.call_graph, catalogue.type_hierarchy, catalogue.containment, catalogue.pattern_match, catalogue.impact_analysis, catalogue.test_coverage,
            catalogue.cross_language_trace, catalogue.collective_patterns, catalogue.temporal_evolution, catalogue.stability_analysis, catalogue.coupling_detection, catalogue.dead_code, catalogue.prophecy,
            catalogue.concept_mapping, catalogue.migration_path, catalogue.test_gap, catalogue.drift, catalogue.hotspots, traverse.shortest_path, traverse.all_paths,
        )
    },
    "impact": {"analyze": impact.analyze, "path": impact.impact_path, "predict": impact.regression_predict, "minimal_tests": impact.minimal_test_set, "health": impact.health, "gate": catalogue.ci_gate},
    "history": {"node": history.node_prophecy, "module": lambda graph, **p: history.module_prophecy(graph, **p)},
    "grounding": {"search": text.keyword_search, "claims": lambda graph, claims, **p: text.ground_claims(claims, graph.units, **p), "citations": lambda graph, claims: text.citations(claims, graph.units), "hallucinations": lambda graph, claims: text.hallucinations(claims, graph.units)},
    "architecture": {"infer": infer.architecture, "flows": infer.role_flows, "anomalies": infer.architecture_anomalies},
    "concepts": {"extract": lambda graph: infer.extract_concepts(graph.units), "navigate": lambda graph, **p: infer.navigate_concepts(graph.units, **p)},
    "patterns": {"extract": lambda graph: infer.naming_patterns(graph.units), "check": lambda graph, **p: infer.check_names(graph.units, **p), "suggest": lambda graph, **p: infer.suggest_patterns(graph.units, **p)},
    "genetics": {"dna": insights.genetics_dna, "lineage": insights.genetics_lineage, "mutations": insights.genetics_mutations, "diseases": insights.genetics_diseases},
    "security": {"vulnerabilities": insights.omniscience_vuln, "practices": insights.omniscience_practices},
}


def call(graph: CodeGraph, group: str, operation: str, **params: Any) -> Any:
    """The result of an operation; an unknown group or operation is an error that names the closest one."""
    for name, known in ((group, TOOLS), (operation, TOOLS.get(group, {}))):
        if name not in known:
            near = text.unknown_query(name, sorted(known))
            raise S.QueryError(f"unknown: {name}" + (f"; did you mean {near}?" if near else ""))
    return TOOLS[group][operation](graph, **params)
