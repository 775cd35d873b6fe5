"""Registered queries: reports, sessions, serialised deltas, explanations and rules that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.graph import CodeGraph
from cairngraph.operators import facade, history, impact, infer, insights, shaping, vectors
from cairngraph.plans.analytics import _PAIRS, _PATHS, _STAB, DAYS, C, E, U, _delta_log, _log, _now, _on
from cairngraph.plans.core import _BUSIEST, _COUPLED, _TESTED, busiest
from cairngraph.plans.projection import changes, graph
from cairngraph.plans.registry import Registry, oracle
from cairngraph.streaming import changes as stream

#: The log's rules with the default of 30 recent days.
_PATHS_30, _STAB_30 = _PATHS.replace(str(DAYS * history.DAY), str(30 * history.DAY)), _STAB
_PART = "CASE WHEN unit_type IN ('function', 'trait') THEN concat('part/', CAST(id - 100000000 AS VARCHAR)) ELSE file_path END"


def by_part(g: CodeGraph) -> CodeGraph:
    """The graph with each part in a file of its own, that of the change log."""
    path = F.when(F.col("unit_type").isin("function", "trait"), F.concat(F.lit("part/"), (F.col("id") - 100_000_000).cast("string"))).otherwise(F.col("file_path"))
    return g.with_units(g.units.withColumn("file_path", path))


def _archaeology(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    return history.investigate(by_part(graph(spark, sf_dir)), c, _now(c))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.coupling(changes(spark, sf_dir), 2, 0.05, by_part(graph(spark, sf_dir)))


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the operations of each user's session, which an error ends."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tool = F.when(F.col("event_type") == "error", shaping.SESSION_END).otherwise(F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("timestamp"), tool.alias("tool"), F.col("props").alias("summary"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("author"), F.col("value"))
    return e


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _delta_log(spark, sf_dir)
    back = shaping.deserialise(shaping.serialise(log), log.schema)
    return shaping.state_at(back)


def _imports(g: CodeGraph) -> DataFrame:
    """Customers as imports, and references to something of each, by their names."""
    units = g.units.withColumn("unit_type", F.when(F.col("unit_type") == "impl", "import").otherwise(F.col("unit_type")))
    refs = g.units.where("unit_type = 'impl'").select(F.col("id").alias("unit_id"), F.concat("name", F.lit(".open")).alias("name"), F.lit("call").alias("kind"))
    return infer.resolve(units, refs)


def _patterns(g: CodeGraph) -> DataFrame:
    """Design patterns of parts whose names follow the patterns' rules: each supplier is a type that parts of its number belong to."""
    k = F.col("id") - 100_000_000
    name = F.when(k % 4 == 0, "get_instance").when(k % 4 == 1, "new").when(k % 4 == 2, F.concat(F.lit("find_"), F.col("name"))).otherwise(F.concat(F.lit("log_decorator_"), F.col("name")))
    owner = F.lpad((k % 100).cast("string"), 9, "0")
    is_part = F.col("unit_type").isin("function", "trait")
    u = g.units.withColumn("qualified_name", F.when(is_part, F.concat(F.lit("store#"), owner, F.lit("."), name)).otherwise(F.col("qualified_name")))
    u = u.withColumn("name", F.when(is_part, name).when(F.col("unit_type") == "type", F.regexp_replace("name", "^Supplier#", "Store#")).otherwise(F.col("name")))
    return infer.design_patterns(u)


_PATTERNS = """
fn AS MATERIALIZED (SELECT id, unit_type, visibility, CASE k % 4 WHEN 0 THEN 'get_instance' WHEN 1 THEN 'new' WHEN 2 THEN concat('find_', name) ELSE concat('log_decorator_', name) END AS name, concat('store#', lpad(CAST(k % 100 AS VARCHAR), 9, '0')) AS owner
  FROM (SELECT *, id - 100000000 AS k FROM units WHERE unit_type IN ('function', 'trait')) x),
st AS (SELECT id, replace(lower(name), 'supplier#', 'store#') AS owner FROM units WHERE unit_type = 'type'),
flags AS (SELECT st.id, max((fn.name = 'get_instance')::INT) AS a, max((fn.name = 'new' AND fn.visibility = 'private')::INT) AS b, max((fn.name = 'get_instance' OR (fn.name = 'new' AND fn.visibility = 'private'))::INT) AS c, sum(regexp_matches(fn.name, '^(find|get)_')::INT) AS k
  FROM st JOIN fn ON contains(concat(fn.owner, '.', fn.name), st.owner) AND fn.unit_type = 'function' GROUP BY st.id)"""


def register(r: Registry) -> None:
    g, log = _on, _log
    # -- reports
    scores = f"{_TESTED}, {_COUPLED.replace('couples_with', 'breaks_with').replace('c AS', 'b AS', 1)}, g AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) x GROUP BY id),"
    report = f"""{scores}
      risks AS (SELECT u.id, least(1e0, CASE WHEN stability_score < 3e-1 THEN 4e-1 WHEN stability_score < 6e-1 THEN 2e-1 ELSE 0 END + CASE WHEN complexity > 20 THEN 3e-1 WHEN complexity > 10 THEN 15e-2 ELSE 0 END
        + CASE WHEN change_count > 50 THEN 2e-1 WHEN change_count > 20 THEN 1e-1 ELSE 0 END + 2e-1 * least(coalesce(b.n, 0), 3) / 3e0 + CASE WHEN unit_type = 'function' AND coalesce(t.n, 0) = 0 THEN 1e-1 ELSE 0 END) AS value FROM units u LEFT JOIN b ON b.id = u.id LEFT JOIN t ON t.id = u.id),
      gaps AS (SELECT id, least(1e0, 5e-1 * least(2e0, change_count / 5e0) + 5e-1 * least(2e0, complexity / 10e0)) AS value FROM units WHERE unit_type = 'function' AND (change_count >= 5 OR complexity >= 10) AND id NOT IN (SELECT id FROM t)),
      hot AS (SELECT u.id, 35e-2 * least(1e0, change_count / 50e0) + 25e-2 * (1 - stability_score) + 25e-2 * least(1e0, complexity / 30e0) + 15e-2 * least(1e0, coalesce(g.n, 0) / 20e0) AS value FROM units u LEFT JOIN g ON g.id = u.id),
      roots AS MATERIALIZED (SELECT id FROM units WHERE unit_type = 'function' AND (name = 'main' OR starts_with(name, 'test_')) OR unit_type = 'test' OR visibility = 'public'),
      fwd(id) AS (SELECT id FROM roots UNION SELECT e.target_id FROM fwd l JOIN edges e ON e.source_id = l.id), bwd(id) AS (SELECT id FROM roots UNION SELECT e.source_id FROM bwd l JOIN edges e ON e.target_id = l.id),
      dead AS (SELECT id, name FROM units WHERE id NOT IN (SELECT id FROM fwd) AND id NOT IN (SELECT id FROM bwd))"""
    rows = """SELECT 'risk' AS section, id, value FROM (SELECT * FROM risks WHERE value >= 45e-2 ORDER BY round(value, 9) DESC, id {0}) a UNION ALL SELECT 'test_gap', id, value FROM (SELECT * FROM gaps ORDER BY value DESC, id {0}) b
        UNION ALL SELECT 'hotspot', id, value FROM (SELECT * FROM hot WHERE value >= 55e-2 ORDER BY round(value, 9) DESC, id {0}) c UNION ALL SELECT 'dead_code', id, 0e0 FROM (SELECT * FROM dead ORDER BY name, id {0}) d"""
    r.add("health_report", g(lambda x: impact.health(x)), oracle("section:s id:l value:d", rows.format("LIMIT 20"), U, E, ctes=report))
    r.add("health_status", g(lambda x: impact.health_status(impact.health(x, 0))), oracle("risks:l gaps:l hotspots:l dead:l status:s", f"""
        SELECT risks, gaps, hotspots, dead, CASE WHEN high >= 3 OR gaps >= 8 THEN 'fail' WHEN risks + gaps + hotspots + dead > 0 THEN 'warn' ELSE 'pass' END AS status FROM (
          SELECT count(*) FILTER (section = 'risk') AS risks, count(*) FILTER (section = 'risk' AND value >= 7e-1) AS high, count(*) FILTER (section = 'test_gap') AS gaps, count(*) FILTER (section = 'hotspot') AS hotspots, count(*) FILTER (section = 'dead_code') AS dead FROM ({rows.format("")}) x) y""", U, E, ctes=report))
    r.add("impact_path", g(lambda x: impact.impact_path(x, busiest(x), x.in_degree("calls").orderBy(F.col("n").desc(), "id").first()["id"]).select("found", "length")), oracle("found:b length:l", """
        SELECT true AS found, depth AS length FROM far WHERE id = (SELECT target_id FROM edges WHERE edge_type = 'calls' GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 1)""", U, E, ctes=_BUSIEST + ",\n" + _far()))

    # -- the log
    phase = """
      phased AS (SELECT *, CASE WHEN score > 8e-1 AND age > 180 THEN 'stable' WHEN ratio > 6e-1 AND age > 90 THEN 'decaying' WHEN age < 30 OR n > 10 THEN 'active' ELSE 'maturing' END AS phase FROM (
        SELECT p.path, n, floor(((SELECT max(timestamp) FROM changes) - first_ts) / 864e2) AS age, bugfixes / CAST(n AS DOUBLE) AS ratio, score, n_authors, p.churn FROM p JOIN stab ON stab.path = p.path) x)"""
    life = _PATHS_30 + "," + _STAB_30 + "," + phase
    r.add("archaeology", _archaeology, oracle("id:l path:s n:l phase:s why:s", f"""
        SELECT id, u.path, coalesce(n, 0) AS n, coalesce(phase, 'unknown') AS phase, concat_ws('; ', doc_summary, CASE WHEN ratio > 5e-1 THEN 'shaped by fixes' END, CASE WHEN n > 10 THEN 'often changed' END, CASE WHEN complexity > 15 THEN 'complex' END) AS why
        FROM (SELECT *, {_PART} AS path FROM units) u LEFT JOIN phased h ON h.path = u.path""", U, C, ctes=life))
    r.add("explain_history", log(lambda c, now: history.explain_why(c, now)), oracle("path:s explanation:s", """
        SELECT path, coalesce(nullif(concat_ws(' ', CASE WHEN age > 365 THEN 'Mature: first changed ' || CAST(age AS BIGINT) || ' days ago.' WHEN age < 30 THEN 'New: less than 30 days old.' END, CASE WHEN ratio > 5e-1 THEN 'More than half of its changes are fixes.' END,
          CASE WHEN n_authors > 3 THEN 'Shared by ' || n_authors || ' authors.' WHEN n_authors = 1 THEN 'Owned by one author.' END, CASE WHEN churn > 500 THEN 'Reworked: ' || churn || ' lines changed.' END, CASE WHEN score < 3e-1 THEN 'Volatile.' WHEN score > 8e-1 THEN 'Settled.' END), ''), 'An ordinary history of ' || n || ' changes.') AS explanation FROM phased""", C, ctes=life))
    r.add("cochange_coupling_graph", _linked, oracle("path_a:s path_b:s n:l strength:d kind:s", f"""
        SELECT s.*, CASE WHEN l.a IS NULL THEN 'co_change' ELSE 'explicit_edge' END AS kind FROM strong s LEFT JOIN (
          SELECT DISTINCT x.path AS a, y.path AS b FROM edges JOIN (SELECT id, {_PART} AS path FROM units) x ON x.id = source_id JOIN (SELECT id, {_PART} AS path FROM units) y ON y.id = target_id) l ON l.a = path_a AND l.b = path_b WHERE n >= 2 AND strength >= 5e-2""", U, E, C, ctes=_PATHS + "," + _PAIRS))
    r.add("prophecy_compare", g(lambda x: history.compare(history.node_prophecy(x), history.scenario(history.node_prophecy(x), -1, "rewrite", 0.6)).where("confidence_a is distinct from confidence_b")), oracle("id:l predictions_a:a predictions_b:a confidence_a:d confidence_b:d", "SELECT -1 AS id, [] AS predictions_a, ['rewrite'] AS predictions_b, CAST(NULL AS DOUBLE) AS confidence_a, 6e-1 AS confidence_b"))
    r.add("invalid_changes", log(lambda c, now: history.validate(c.withColumn("change_type", F.when(F.col("is_bugfix"), "repair").otherwise(F.col("change_type")))).select("path", "commit_id", "change_type")), oracle("path:s commit_id:s change_type:s", "SELECT path, commit_id, 'repair' AS change_type FROM changes WHERE is_bugfix", C))

    # -- inference
    r.add("resolve_imports", g(_imports), oracle("unit_id:l name:s kind:s target_id:l resolution:s library:s", """
        SELECT id AS unit_id, concat(name, '.open') AS name, 'call' AS kind, first AS target_id, 'imported' AS resolution, CAST(NULL AS VARCHAR) AS library FROM (SELECT id, name, min(id) OVER (PARTITION BY file_path, name) AS first FROM units WHERE unit_type = 'impl') x""", U))
    r.add("design_patterns_named", g(_patterns), oracle("pattern:s id:l confidence:d", """
        SELECT 'Singleton' AS pattern, id, (a + b) / 2e0 AS confidence FROM flags WHERE c = 1 UNION ALL SELECT 'Factory', id, 5e-1 FROM fn WHERE unit_type = 'function' AND name = 'new'
        UNION ALL SELECT 'Repository', st.id, CASE WHEN k >= 3 THEN 9e-1 WHEN k >= 1 THEN 6e-1 ELSE 4e-1 END FROM st LEFT JOIN flags ON flags.id = st.id UNION ALL SELECT 'Decorator', id, 8e-1 FROM fn WHERE contains(name, 'decorator')""", U, ctes=_PATTERNS))
    r.add("suggest_patterns", g(lambda x: infer.suggest_patterns(x.units, "Brand#1", 5)), oracle("pattern:s n:l", """
        SELECT pattern, sum(n) AS n FROM (SELECT unit_type, pattern, count(*) AS n FROM (
          SELECT unit_type, split_part(name, '_', 1) || '_*' AS pattern FROM units WHERE starts_with(file_path, 'Brand#1') AND unit_type IN ('function', 'type') AND contains(name, '_') AND strlen(split_part(name, '_', 1)) >= 3
          UNION ALL SELECT unit_type, '*_' || split_part(name, '_', -1) FROM units WHERE starts_with(file_path, 'Brand#1') AND unit_type IN ('function', 'type') AND contains(name, '_') AND strlen(split_part(name, '_', -1)) >= 4) x GROUP BY ALL HAVING count(*) >= 3) y GROUP BY pattern ORDER BY n DESC, pattern LIMIT 5""", U))
    r.add("foreign_calls", g(lambda x: infer.foreign_calls(x.units.select(F.col("id").alias("unit_id"), F.regexp_replace(F.regexp_replace("name", "bolt$", "ctypes_load"), "ring$", "http_get").alias("name")))), oracle("unit_id:l name:s via:s", """
        SELECT * FROM (SELECT unit_id, name, CASE WHEN contains(name, 'ctypes') THEN 'ctypes' WHEN contains(name, 'http') THEN 'http' END AS via FROM (SELECT id AS unit_id, regexp_replace(regexp_replace(name, 'bolt$', 'ctypes_load'), 'ring$', 'http_get') AS name FROM units) x) y WHERE via IS NOT NULL""", U))
    r.add("risky_names", g(lambda x: insights.omniscience_vuln(x.with_units(x.units.withColumn("name", F.regexp_replace(F.regexp_replace("name", "bolt$", "shell_exec"), "ring$", "inject_sql"))))), oracle("id:l name:s keyword:s severity:s", """
        SELECT id, name, CASE WHEN contains(name, 'exec') THEN 'exec' ELSE 'sql' END AS keyword, CASE WHEN contains(name, 'exec') THEN 'high' ELSE 'medium' END AS severity FROM (SELECT id, regexp_replace(regexp_replace(name, 'bolt$', 'shell_exec'), 'ring$', 'inject_sql') AS name FROM units) x WHERE contains(name, 'exec') OR contains(name, 'sql')""", U))

    # -- vectors
    cosine = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
    r.add("index_search", _index_search, oracle("id:l score:d why:s", f"""
        SELECT *, CASE WHEN score > 9e-1 THEN 'nearly the same' WHEN score > 7e-1 THEN 'very similar' WHEN score > 4e-1 THEN 'related' ELSE 'loosely related' END AS why FROM (
          SELECT e.vec_id AS id, {cosine} AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, id LIMIT 20) x"""))

    # -- shaping
    r.add("page_after", g(lambda x: shaping.page_after(x.units.select("id", "name"), "id", 100_000_050, 50)), oracle("id:l name:s", "SELECT id, name FROM units WHERE id > 100000050 ORDER BY id LIMIT 50", U))
    r.add("delta_round_trip", _round_trip, oracle("key:l value:d", "SELECT key, value FROM (SELECT user_id AS key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS c FROM events GROUP BY user_id) x WHERE c <> 'error'"))
    r.add("sessions", lambda spark, sf: shaping.sessions(_operations(spark, sf)), oracle("session_id:s started:l last:l operations:l ended:b", """
        SELECT CAST(user_id AS VARCHAR) AS session_id, min(event_id) AS started, max(event_id) AS last, count(*) FILTER (event_type <> 'error') AS operations, arg_max(event_type = 'error', event_id) AS ended FROM events GROUP BY user_id"""))
    r.add("session_resume", lambda spark, sf: shaping.resume(_operations(spark, sf), n=20), oracle("session_id:s timestamp:l tool:s summary:s", """
        SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS timestamp, event_type AS tool, props AS summary FROM events WHERE event_type <> 'error' AND user_id = (SELECT user_id FROM events ORDER BY event_id DESC, user_id LIMIT 1) ORDER BY event_id DESC LIMIT 20"""))
    r.add("operation_log", lambda spark, sf: shaping.operation_log(_operations(spark, sf), 20).select("timestamp", "tool"), oracle("timestamp:l tool:s", "SELECT event_id AS timestamp, CASE WHEN event_type = 'error' THEN 'session_end' ELSE event_type END AS tool FROM events ORDER BY event_id DESC LIMIT 20"))
    r.add("content_ids", g(lambda x: x.units.select("id", shaping.content_id("id", "name").alias("content_id"))), oracle("id:l content_id:s", """SELECT id, sha256('{"id":' || id || ',"name":"' || name || '"}') AS content_id FROM units""", U))
    r.add("tool_call", g(lambda x: facade.call(x, "query", "hotspots", top_k=5).select("id")), oracle("id:l", """
        SELECT u.id FROM units u LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) x GROUP BY id) g ON g.id = u.id
        ORDER BY round(35e-2 * least(1e0, change_count / 50e0) + 25e-2 * (1 - stability_score) + 25e-2 * least(1e0, complexity / 30e0) + 15e-2 * least(1e0, coalesce(g.n, 0) / 20e0), 9) DESC, u.id LIMIT 5""", U, E))

    # -- streams
    r.add("events_deduplicated", lambda spark, sf: _events(spark, sf).dropDuplicates(["key", "ts", "author"]).groupBy("key").agg(F.count("*").alias("n")), oracle("key:s n:l", "SELECT event_type AS key, count(DISTINCT (ts, user_id)) AS n FROM events GROUP BY 1"))
    r.add("events_running", lambda spark, sf: stream.totals(_events(spark, sf).withColumn("is_fix", F.col("key") == "error").withColumn("size", F.floor("value").cast("long"))), oracle("key:s n:l fixes:l churn:l", "SELECT event_type AS key, count(*) AS n, sum((event_type = 'error')::INT) AS fixes, sum(CAST(floor(value) AS BIGINT)) AS churn FROM events GROUP BY 1"))


def _far() -> str:
    from cairngraph.plans.registry import walk

    return walk((), roots="SELECT id FROM busiest", name="far")


def _index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.index_search(v, v.orderBy("id").first()["vector"], 20).withColumn("why", vectors.explain_match(F.col("score")))
