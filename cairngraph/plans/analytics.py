"""Registered queries: impact, change log, claims, inference, workspaces, tool queries, shaping, over the projected graph and log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.graph import CodeGraph
from cairngraph.operators import history, impact, infer, insights, shaping, text, workspace
from cairngraph.plans.core import roots
from cairngraph.plans.projection import changes, graph
from cairngraph.plans.registry import Registry, names, oracle, walk

U, E, C = "units", "edges", "changes"
#: Days that count as recent in the log, which spans years.
DAYS = 365
_REC = f"CAST(timestamp >= (SELECT max(timestamp) FROM changes) - {DAYS * history.DAY} AS INT)"
_PATHS = f"""
p AS MATERIALIZED (SELECT path, count(*) AS n, sum(is_bugfix::INT) AS bugfixes, count(DISTINCT author) AS n_authors, list_sort(list(DISTINCT author)) AS authors, sum(lines_added + lines_deleted) AS churn,
  sum(lines_added) AS added, sum(lines_deleted) AS deleted, min(timestamp) AS first_ts, max(timestamp) AS last_ts, sum({_REC}) AS recent, sum({_REC} * is_bugfix::INT) AS recent_bugfixes FROM changes GROUP BY path)"""
_PAIRS = """
pairs2 AS MATERIALIZED (SELECT a.path AS path_a, b.path AS path_b, count(*) AS n FROM (SELECT DISTINCT commit_id, path FROM changes) a JOIN (SELECT DISTINCT commit_id, path FROM changes) b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL),
strong AS (SELECT path_a, path_b, pairs2.n, least(1e0, pairs2.n / CAST(greatest(x.n, y.n) AS DOUBLE)) AS strength FROM pairs2 JOIN p x ON x.path = path_a JOIN p y ON y.path = path_b)"""
_STAB = """
f AS (SELECT path, 1 / (1 + greatest(0e0, log2(greatest(1, n)))) AS frequency, 1 - bugfixes / CAST(n AS DOUBLE) AS bugfix, 1 - recent / CAST(n AS DOUBLE) AS activity, 1 / CAST(greatest(1, n_authors) AS DOUBLE) AS ownership,
  1 / (1 + greatest(0e0, log2(greatest(1, churn)))) AS churn_factor FROM p),
stab AS (SELECT *, least(1e0, greatest(0e0, 25e-2 * frequency + 25e-2 * bugfix + 2e-1 * activity + 15e-2 * ownership + 15e-2 * churn_factor)) AS score FROM f)"""
_RISK = """
ends AS (SELECT path, avg(strength) AS s, count(*) AS k FROM (SELECT path_a AS path, strength FROM strong WHERE n >= 2 AND strength >= 3e-1 UNION ALL SELECT path_b, strength FROM strong WHERE n >= 2 AND strength >= 3e-1) x GROUP BY path),
fac AS (SELECT p.path, 5e-1 * recent / n + 5e-1 * least(1e0, recent / 5e0) AS velocity, 4e-1 * bugfixes / n + 6e-1 * CASE WHEN recent > 0 THEN recent_bugfixes / CAST(recent AS DOUBLE) ELSE 0 END AS bugfix_trend,
  CASE WHEN added > deleted THEN (added - deleted) / (added - deleted + 1e2) ELSE 0 END AS growth, CASE WHEN k > 0 THEN 6e-1 * s + 4e-1 * least(1e0, sqrt(k) / 3e0) ELSE 0 END AS coupling FROM p LEFT JOIN ends e ON e.path = p.path),
risks AS (SELECT *, least(1e0, 3e-1 * velocity + 3e-1 * bugfix_trend + 15e-2 * growth + 25e-2 * coupling) AS risk, CASE greatest(velocity, bugfix_trend, growth, coupling) WHEN bugfix_trend THEN 'bug_risk' WHEN velocity THEN 'change_velocity' WHEN coupling THEN 'coupling_risk' ELSE 'complexity_growth' END AS kind FROM fac)"""
_OUT = "o AS (SELECT source_id AS id, count(*) AS out_n, list_sort(list(DISTINCT edge_type)) AS out_types, sum((edge_type = 'calls')::INT) AS calls_out, sum((edge_type = 'breaks_with')::INT) AS breaks FROM edges GROUP BY source_id)"
_IN = "i AS (SELECT target_id AS id, count(*) AS in_n, list_sort(list(DISTINCT edge_type)) AS in_types, sum((edge_type = 'tests')::INT) AS tests, sum((edge_type = 'documents')::INT) AS docs, sum((edge_type = 'calls')::INT) AS calls_in, sum((edge_type = 'contains')::INT) AS contained FROM edges GROUP BY target_id)"
_PROFILE = f"""{_OUT}, {_IN},
prof AS MATERIALIZED (SELECT u.*, coalesce(out_n, 0) AS out_n, coalesce(out_types, []) AS out_types, coalesce(calls_out, 0) AS calls_out, coalesce(breaks, 0) AS breaks, coalesce(in_n, 0) AS in_n, coalesce(in_types, []) AS in_types,
  coalesce(tests, 0) AS tests, coalesce(docs, 0) AS docs, coalesce(calls_in, 0) AS calls_in, coalesce(contained, 0) AS contained FROM units u LEFT JOIN o ON o.id = u.id LEFT JOIN i ON i.id = u.id)"""
_CLAIMS = "claims AS (SELECT id AS claim_id, name AS n1, upper(name) AS n2, concat('test_', CAST(id - 100000000 AS VARCHAR)) AS n3, concat('ghost_', name) AS n4, id % 3 = 0 AS odd FROM units WHERE unit_type = 'function')"


def _now(c: DataFrame) -> int:
    return c.agg(F.max("timestamp")).first()[0] or 0


def _log(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = changes(spark, sf_dir)
        return f(c, _now(c))

    return run


def _on(f):
    return lambda spark, sf_dir: f(graph(spark, sf_dir))


def claims_of(g: CodeGraph) -> DataFrame:
    """A claim about every function: its name, its name in capitals, a test by number in backticks and, for two thirds, a symbol that may not exist."""
    key = F.col("id") - 100_000_000
    ghost = F.when(F.col("id") % 3 != 0, F.concat(F.lit(" It needs ghost_"), F.col("name"), F.lit("."))).otherwise("")
    said = F.concat(F.lit("Function "), F.col("name"), F.lit(" is also "), F.upper("name"), F.lit(" and `test_"), key.cast("string"), F.lit("` checks it."), ghost)
    return g.units.where("unit_type = 'function'").select(F.col("id").alias("claim_id"), said.alias("text"))


def contexts_of(g: CodeGraph) -> DataFrame:
    """Each language's units as one context."""
    return g.units.withColumn("context", F.col("language")).withColumn("graph", F.col("language"))


def _tested(g: CodeGraph) -> DataFrame:
    t = g.edges_of("tests").select(F.col("target_id").alias("id")).distinct()
    return t.join(g.units.select("id", F.col("language").alias("graph")), "id").select("graph", "id")


def _of(g: CodeGraph, language: str) -> DataFrame:
    return g.units.where(F.col("language") == language)


def translation_log(g: CodeGraph) -> DataFrame:
    """Every function as a step of translating its name; the version is its id."""
    s = F.col("stability_score")
    status = F.when(s < 0.5, "not_started").when(s < 0.6, "in_progress").when(s < 0.7, "ported").when(s < 0.8, "verified").otherwise("skipped")
    return g.units.where("unit_type = 'function'").select(F.col("name").alias("source_symbol"), F.col("qualified_name").alias("target_symbol"), status.alias("status"), F.lit(None).cast("string").alias("notes"), F.col("id").alias("version"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("layer"), F.floor("value").cast("long").alias("tokens"), (F.floor("value") * 3).cast("long").alias("full_tokens"))


def _delta_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("ts"), F.when(F.col("event_type") == "error", "delete").otherwise("modify").alias("change_type"), F.col("value"))


def _concept_sql(table: dict[str, str], both: bool, bonus: str, typical: str, cond: str) -> str:
    parts = []
    for concept, words in table.items():
        s = " + ".join(
            (f"CASE WHEN contains(lower(name), '{w}') THEN 4e-1 ELSE 0 END + CASE WHEN contains(lower(qualified_name), '{w}') THEN 2e-1 ELSE 0 END" if both else f"CASE WHEN contains(lower(name), '{w}') THEN 4e-1 WHEN contains(lower(qualified_name), '{w}') THEN 2e-1 ELSE 0 END")
            + f" + CASE WHEN contains(lower(coalesce(doc_summary, '')), '{w}') THEN 15e-2 ELSE 0 END"
            for w in words.split()
        )
        kinds = "'test', 'function'" if concept == "Testing" and not both else typical
        parts.append(f"SELECT '{concept}' AS concept, id, round({s} + CASE WHEN unit_type IN ({kinds}) THEN {bonus} ELSE 0 END, 9) AS score FROM units")
    return f"SELECT concept, id, least(1e0, score) AS score FROM ({' UNION ALL '.join(parts)}) x WHERE score {cond}"


def _role_sql() -> str:
    where = "concat_ws(chr(10), lower(name), lower(qualified_name), lower(file_path))"
    cases = " ".join(f"WHEN {' OR '.join(f'''contains({where}, '{w}')''' for w in words.split()) if words else '''unit_type = 'test' '''} THEN '{name}'" for name, words in infer.ROLES)
    return f"roles AS MATERIALIZED (SELECT id, CASE {cases} ELSE 'utility' END AS role FROM units)"


def register(r: Registry) -> None:
    g, log = _on, _log
    _impact(r, g)
    _history(r, g, log)
    _text(r, g)
    _infer(r, g)
    _workspace(r, g)
    _insights(r, g)
    _shaping(r)


def _impact(r: Registry, g) -> None:
    reach = walk(impact.REACH, "in", 3)
    tested = "t AS (SELECT DISTINCT target_id AS id FROM edges WHERE edge_type = 'tests')"
    kind = {
        "deletion": "CASE WHEN depth = 1 THEN 'will_break' ELSE 'might_break' END", "signature": "CASE WHEN depth = 1 THEN 'will_break' ELSE 'needs_review' END", "rename": "CASE WHEN depth = 1 THEN 'will_break' ELSE 'needs_review' END",
        "behavior": "CASE WHEN id IN (SELECT id FROM t) THEN 'needs_review' ELSE 'might_break' END", "move": "CASE WHEN depth = 1 THEN 'might_break' ELSE 'safe' END",
    }
    for change, base in impact.BASE.items():
        r.add(f"impact_{change}", g(lambda x, change=change: impact.analyze(x, roots(x), change)), oracle("root:l id:l distance:l impact_type:s break_probability:d path:a", f"""
            SELECT root, id, depth AS distance, {kind[change]} AS impact_type, {base}e0 / (1 + 5e-1 * depth) AS break_probability, list_reverse(path) AS path FROM reach WHERE depth > 0""", U, E, ctes=reach + "," + tested))
    radius = """rad AS MATERIALIZED (SELECT root, count(*) AS nodes, count(DISTINCT file_path) AS files, count(DISTINCT regexp_replace(qualified_name, '(\\.|::)[^.:]*$', '')) AS modules, sum((unit_type IN ('function', 'macro'))::INT) AS functions,
        sum((unit_type = 'test')::INT) AS tests, sum(greatest(1, end_line - start_line)) AS lines, sum((depth = 1)::INT) AS will_break FROM reach JOIN units u ON u.id = reach.id WHERE depth > 0 GROUP BY root)"""
    risk = "CASE WHEN will_break > 10 OR files > 20 THEN 'critical' WHEN will_break > 3 OR files > 10 OR nodes > 30 THEN 'high' WHEN will_break > 0 OR nodes > 10 THEN 'medium' ELSE 'low' END"
    r.add("blast_radius", g(lambda x: impact.blast_radius(x, impact.analyze(x, roots(x), "deletion"))), oracle("root:l nodes:l files:l modules:l functions:l tests:l lines:l will_break:l risk:s", f"SELECT *, {risk} AS risk FROM rad", U, E, ctes=reach + "," + radius))
    r.add("impact_mitigations", g(lambda x: impact.mitigations(impact.blast_radius(x, impact.analyze(x, roots(x), "deletion")), "deletion")), oracle("root:l advice:s", f"""
        SELECT root, 'deprecate before deleting' AS advice FROM rad UNION ALL SELECT root, 'roll out in steps' FROM rad WHERE {risk} IN ('high', 'critical') UNION ALL SELECT root, 'write tests first' FROM rad WHERE tests = 0""", U, E, ctes=reach + "," + radius))
    reg = walk(impact.TEST_REACH, "in", 5, roots="SELECT id FROM units WHERE unit_type IN ('function', 'trait') AND id % 50 = 0") + """,
        direct AS (SELECT DISTINCT target_id, source_id FROM edges WHERE edge_type = 'tests'),
        pred AS (SELECT root, r.id AS test_id, d.source_id IS NOT NULL AS direct, CASE WHEN d.source_id IS NOT NULL THEN 85e-2 ELSE 6e-1 / (1 + 3e-1 * depth) END AS probability FROM reach r JOIN units u ON u.id = r.id AND u.unit_type = 'test' LEFT JOIN direct d ON d.target_id = root AND d.source_id = r.id WHERE depth > 0)"""
    code = lambda x: x.units.where("unit_type in ('function', 'trait') and id % 50 = 0").select("id")
    r.add("regression_predict", g(lambda x: impact.regression_predict(x, code(x))), oracle("root:l test_id:l probability:d bucket:s", "SELECT root, test_id, probability, CASE WHEN direct THEN 'likely' WHEN probability > 3e-1 THEN 'recommended' ELSE 'skip' END AS bucket FROM pred", U, E, ctes=reg))
    r.add("minimal_test_set", g(lambda x: impact.minimal_test_set(x, code(x))), oracle("root:l test_id:l", "SELECT root, test_id FROM pred WHERE direct OR probability > 4e-1", U, E, ctes=reg))
    kinds = tuple(k for k in ("calls", "imports", "inherits", "implements", "contains", "uses_type", "couples_with", "breaks_with", "version_of", "ffi_binds"))
    r.add("impact_lite", g(lambda x: impact.lite_impact(x, roots(x), 2)), oracle("root:l id:l depth:l risk:d", "SELECT root, id, depth, 1e0 / depth * CASE WHEN id IN (SELECT id FROM t) THEN 5e-1 ELSE 1 END AS risk FROM reach WHERE depth > 0", U, E, ctes=walk(kinds, "in", 2) + "," + tested))
    r.add("budget_projection", lambda spark, sf: impact.budget_projection(spark.read.parquet(f"{sf}/orders.parquet").select(F.unix_timestamp("o_orderdate").alias("mtime"), F.col("o_orderkey").alias("size")).groupBy("mtime").agg(F.max("size").cast("double").alias("size"))), oracle("bytes_now:d bytes_per_day:d projected:d", """
        SELECT s1 AS bytes_now, (s1 - s0) * 864e2 / (t1 - t0) AS bytes_per_day, greatest(0e0, s1 + (s1 - s0) * 864e2 / (t1 - t0) * 365) AS projected FROM (
          SELECT arg_min(size, mtime) AS s0, arg_max(size, mtime) AS s1, min(mtime) AS t0, max(mtime) AS t1 FROM (SELECT epoch(o_orderdate) AS mtime, max(o_orderkey) AS size FROM orders GROUP BY 1) x) y"""))


def _history(r: Registry, g, log) -> None:
    paths = "path:s n:l bugfixes:l authors:a churn:l added:l deleted:l first_ts:l last_ts:l recent:l recent_bugfixes:l"
    r.add("history_path_stats", log(lambda c, now: history.path_stats(c, now, DAYS).withColumnsRenamed({"first": "first_ts", "last": "last_ts"})), oracle(paths, "SELECT * FROM p", C, ctes=_PATHS))
    r.add("history_totals", log(lambda c, now: history.totals(c)), oracle("changes:l commits:l paths:l authors:l", "SELECT count(*) AS changes, count(DISTINCT commit_id) AS commits, count(DISTINCT path) AS paths, count(DISTINCT author) AS authors FROM changes", C))
    r.add("co_changes", log(lambda c, now: history.co_changes(c)), oracle("path_a:s path_b:s n:l", "SELECT * FROM pairs2", C, ctes=_PATHS + "," + _PAIRS))
    r.add("cochange_coupling", log(lambda c, now: history.coupling(c, 2, 0.05)), oracle("path_a:s path_b:s n:l strength:d kind:s", "SELECT *, 'co_change' AS kind FROM strong WHERE n >= 2 AND strength >= 5e-2", C, ctes=_PATHS + "," + _PAIRS))
    r.add("history_stability", log(lambda c, now: history.stability(c, now, DAYS).drop("advice")), oracle("path:s frequency:d bugfix:d activity:d ownership:d churn_factor:d score:d", "SELECT * FROM stab", C, ctes=_PATHS + "," + _STAB))
    risk = _PATHS + "," + _PAIRS + "," + _RISK
    r.add("history_prophecy", log(lambda c, now: history.prophecy(c, now, 0.3, 50, DAYS)), oracle("path:s velocity:d bugfix_trend:d growth:d coupling:d risk:d kind:s", "SELECT * FROM risks WHERE risk >= 3e-1 ORDER BY round(risk, 9) DESC, path LIMIT 50", C, ctes=risk))
    r.add("history_risks", log(lambda c, now: history.prophecy_factors(c, now, DAYS).select("path", "risk", "kind")), oracle("path:s risk:d kind:s", "SELECT path, risk, kind FROM risks", C, ctes=risk))
    r.add("ecosystem_alerts", log(lambda c, now: history.alerts(c, now, DAYS)), oracle("alert:s path:s risk:d", """
        SELECT 'hotspot' AS alert, path, risk FROM risks WHERE risk > 7e-1 UNION ALL SELECT 'systemic', path, risk FROM (SELECT * FROM risks WHERE risk >= 3e-1 ORDER BY round(risk, 9) DESC, path LIMIT 5) x WHERE (SELECT avg(risk) FROM risks) > 6e-1""", C, ctes=risk))
    r.add("evolution_phase", log(lambda c, now: history.phases(c, now, DAYS)), oracle("path:s n:l age_days:l idle_days:l bugfix_ratio:d score:d phase:s", """
        SELECT *, CASE WHEN score > 8e-1 AND age_days > 180 THEN 'stable' WHEN bugfix_ratio > 6e-1 AND age_days > 90 THEN 'decaying' WHEN age_days < 30 OR n > 10 THEN 'active' ELSE 'maturing' END AS phase FROM (
          SELECT p.path, n, floor(((SELECT max(timestamp) FROM changes) - first_ts) / 864e2) AS age_days, floor(((SELECT max(timestamp) FROM changes) - last_ts) / 864e2) AS idle_days, bugfixes / CAST(n AS DOUBLE) AS bugfix_ratio, score FROM p JOIN stab ON stab.path = p.path) x""", C, ctes=_PATHS + "," + _STAB))
    r.add("change_timeline", log(lambda c, now: history.timeline(c)), oracle("path:s timestamp:l commit_id:s author:s change_type:s is_bugfix:b", "SELECT path, timestamp, commit_id, author, change_type, is_bugfix FROM changes", C))
    r.add("node_prophecy", g(lambda x: history.node_prophecy(x)), oracle("id:l predictions:a confidence:d", """
        SELECT id, p AS predictions, CASE WHEN len(p) > 0 THEN w / len(p) ELSE 3e-1 END AS confidence FROM (SELECT id, [x for x in [CASE WHEN complexity > 15 THEN 'complexity' END, CASE WHEN change_count > 10 THEN 'changes' END, CASE WHEN stability_score < 3e-1 THEN 'instability' END, CASE WHEN d > 10 THEN 'dependents' END] if x IS NOT NULL] AS p,
          CASE WHEN complexity > 15 THEN 8e-1 ELSE 0 END + CASE WHEN change_count > 10 THEN 7e-1 ELSE 0 END + CASE WHEN stability_score < 3e-1 THEN 8e-1 ELSE 0 END + CASE WHEN d > 10 THEN 9e-1 ELSE 0 END AS w
          FROM (SELECT u.*, coalesce(e.d, 0) AS d FROM units u LEFT JOIN (SELECT target_id, count(*) AS d FROM edges GROUP BY target_id) e ON e.target_id = u.id) y) z""", U, E))
    r.add("module_prophecy", g(lambda x: history.module_prophecy(x)), oracle("module:s units:l avg_complexity:d changes:l prediction:s", """
        SELECT *, CASE WHEN avg_complexity > 10 THEN 'complexity' WHEN changes > 50 THEN 'instability' ELSE 'healthy' END AS prediction FROM (SELECT regexp_extract(qualified_name, '^([^.:]*)', 1) AS module, count(*) AS units, avg(complexity) AS avg_complexity, sum(change_count) AS changes FROM units GROUP BY 1) x""", U))
    r.add("message_classes", lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").select(history.classify_message(F.concat("event_type", F.lit(" "), F.when(F.col("value") < 20, "fix").when(F.col("value") < 40, "new perf").otherwise("text"))).alias("class")).groupBy("class").agg(F.count("*").alias("n")), oracle("class:s n:l", """
        SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(m, 'bug|fix|patch') THEN 'bugfix' WHEN regexp_matches(m, 'clean up|cleanup|refactor|rename') THEN 'refactor' WHEN regexp_matches(m, 'fast|optim|perf|speed') THEN 'performance' WHEN regexp_matches(m, 'add|feat|implement|new') THEN 'feature' ELSE 'unknown' END AS class
          FROM (SELECT lower(event_type || ' ' || CASE WHEN value < 20 THEN 'fix' WHEN value < 40 THEN 'new perf' ELSE 'text' END) AS m FROM events) x) y GROUP BY class"""))


def _text(r: Registry, g) -> None:
    refs = """refs AS MATERIALIZED (SELECT claim_id, n3 AS ref, 0 AS pos FROM claims UNION ALL SELECT claim_id, n1, 1 FROM claims UNION ALL SELECT claim_id, n2, 2 FROM claims UNION ALL SELECT claim_id, n4, 3 FROM claims WHERE NOT odd),
        tiers AS MATERIALIZED (SELECT ref, u.id, 1 AS tier FROM (SELECT DISTINCT ref FROM refs) q JOIN units u ON u.name = ref),
        t2 AS MATERIALIZED (SELECT ref, u.id, 2 AS tier FROM (SELECT DISTINCT ref FROM refs WHERE ref NOT IN (SELECT ref FROM tiers)) q JOIN units u ON contains(u.qualified_name, ref)),
        t3 AS (SELECT ref, u.id, 3 AS tier FROM (SELECT DISTINCT ref FROM refs WHERE ref NOT IN (SELECT ref FROM tiers) AND ref NOT IN (SELECT ref FROM t2)) q JOIN units u ON lower(u.name) = lower(ref)),
        ev AS MATERIALIZED (SELECT * FROM tiers UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
        ground AS (SELECT claim_id, count(*) AS refs, sum((ref IN (SELECT ref FROM ev))::INT) AS supported FROM refs GROUP BY claim_id)"""
    base = _CLAIMS + ", " + refs
    r.add("extract_refs", g(lambda x: text.extract_references(claims_of(x))), oracle("claim_id:l pos:l ref:s", "SELECT * FROM refs", U, ctes=base))
    r.add("find_evidence", g(lambda x: text.evidence(text.extract_references(claims_of(x)), x.units)), oracle("ref:s id:l tier:l", "SELECT * FROM ev", U, ctes=base))
    r.add("find_evidence_by_type", g(lambda x: text.evidence(text.extract_references(claims_of(x)), x.units, ("test",))), oracle("ref:s id:l tier:l", "SELECT * FROM ev", U, ctes=base.replace("JOIN units u", "JOIN (SELECT * FROM units WHERE unit_type = 'test') u")))
    status = "CASE WHEN supported = 0 THEN 'ungrounded' WHEN supported = refs THEN 'verified' ELSE 'partial' END"
    r.add("ground_claims", g(lambda x: text.ground_claims(claims_of(x), x.units)), oracle("claim_id:l refs:l supported:l status:s confidence:d", f"SELECT *, {status} AS status, supported / CAST(refs AS DOUBLE) AS confidence FROM ground", U, ctes=base))
    r.add("ground_claims_strict", g(lambda x: text.ground_claims(claims_of(x), x.units, strict=True)), oracle("claim_id:l refs:l supported:l status:s confidence:d", f"SELECT *, replace({status}, 'partial', 'ungrounded') AS status, supported / CAST(refs AS DOUBLE) AS confidence FROM ground", U, ctes=base))
    r.add("citations", g(lambda x: text.citations(claims_of(x), x.units)), oracle("claim_id:l ref:s id:l strength:s", "SELECT claim_id, ev.ref, id, ['direct', 'strong', 'partial'][tier] AS strength FROM (SELECT DISTINCT claim_id, ref FROM refs) q JOIN ev ON ev.ref = q.ref", U, ctes=base))
    near = "starts_with(lower(u.name), lower(m.ref)) OR starts_with(lower(m.ref), lower(u.name)) OR levenshtein(lower(m.ref), lower(u.name)) <= strlen(m.ref) // 3"
    missing = base + f", m AS MATERIALIZED (SELECT DISTINCT ref FROM refs WHERE ref NOT IN (SELECT name FROM units)), close AS MATERIALIZED (SELECT DISTINCT ref FROM m JOIN (SELECT DISTINCT name FROM units) u ON {near})"
    r.add("contradictions", g(lambda x: text.contradictions(claims_of(x), x.units)), oracle("claim_id:l ref:s kind:s", "SELECT DISTINCT claim_id, ref, CASE WHEN ref IN (SELECT ref FROM close) THEN 'contradicted' ELSE 'not_found' END AS kind FROM refs WHERE ref IN (SELECT ref FROM m)", U, ctes=missing))
    halluc = base + ", h AS (SELECT claim_id, 1 AS sentence_no, n4 AS ref FROM claims WHERE NOT odd AND lower(n4) NOT IN (SELECT lower(name) FROM units) UNION ALL SELECT claim_id, 0, n3 FROM claims WHERE n3 NOT IN (SELECT name FROM units))"
    r.add("hallucination_check", g(lambda x: text.hallucinations(claims_of(x), x.units)), oracle("claim_id:l sentence_no:l ref:s kind:s severity:s", "SELECT *, 'non_existent' AS kind, 'severe' AS severity FROM h", U, ctes=halluc))
    r.add("hallucination_report", g(lambda x: text.hallucination_report(claims_of(x), x.units)), oracle("claim_id:l sentences:l found:l score:d safe:b", """
        SELECT *, least(1e0, found / CAST(sentences AS DOUBLE)) AS score, least(1e0, found / CAST(sentences AS DOUBLE)) < 3e-1 AS safe FROM (SELECT claim_id, CASE WHEN odd THEN 1 ELSE 2 END AS sentences, (SELECT count(*) FROM h WHERE h.claim_id = c.claim_id) AS found FROM claims c) x""", U, ctes=halluc))
    r.add("suggest_similar", g(lambda x: text.suggest_similar(text.hallucinations(claims_of(x), x.units), x.units, 3)), oracle("ref:s name:s distance:l rank:l", """
        SELECT * FROM (SELECT ref, name, d AS distance, row_number() OVER (PARTITION BY ref ORDER BY d, name) AS rank FROM (
          SELECT ref, name, CASE WHEN starts_with(lower(name), lower(ref)) OR starts_with(lower(ref), lower(name)) THEN 0 ELSE levenshtein(lower(ref), lower(name)) END AS d, starts_with(lower(name), lower(ref)) OR starts_with(lower(ref), lower(name)) AS pre
          FROM (SELECT DISTINCT ref FROM h) q, (SELECT DISTINCT name FROM units) u) x WHERE pre OR d BETWEEN 1 AND strlen(ref) // 2) y WHERE rank <= 3""", U, ctes=halluc))
    r.add("suggest_fixes", g(lambda x: text.suggest_fixes(claims_of(_cut_names(x)), x.units, 5)), oracle("ref:s name:s rank:l", f"""
        SELECT * FROM (SELECT ref, name, row_number() OVER (PARTITION BY ref ORDER BY name) AS rank FROM (SELECT DISTINCT ref FROM gone) q JOIN (SELECT DISTINCT name FROM units) u ON starts_with(lower(name), lower(ref)) OR starts_with(lower(ref), lower(name))) x WHERE rank <= 5""", U, ctes=f"""
        cut AS (SELECT id, id % 3 = 0 AS odd, left(name, strlen(name) - 2) AS name FROM units WHERE unit_type = 'function'),
        said AS (SELECT name AS ref FROM cut UNION SELECT upper(name) FROM cut UNION SELECT concat('test_', CAST(id - 100000000 AS VARCHAR)) FROM cut UNION SELECT concat('ghost_', name) FROM cut WHERE NOT odd),
        gone AS (SELECT ref FROM said WHERE lower(ref) NOT IN (SELECT lower(name) FROM units))"""))
    r.add("truth_diff", g(lambda x: text.truth_diff(text.check_truths(claims_of(x), x.units), text.check_truths(claims_of(x), x.units.where("unit_type <> 'test'")))), oracle("claim_id:l was:s now:s", f"""
        SELECT a.claim_id, a.state AS was, b.state AS now FROM ({_STATE}) a JOIN ({_STATE.replace("FROM ev)", "FROM ev WHERE id NOT IN (SELECT id FROM units WHERE unit_type = 'test'))")}) b ON a.claim_id = b.claim_id WHERE a.state <> b.state""", U, ctes=base))
    r.add("truth_states", g(lambda x: text.check_truths(claims_of(x), x.units)), oracle("claim_id:l state:s", "SELECT claim_id, CASE WHEN supported = refs THEN 'valid' WHEN supported = 0 THEN 'deleted' ELSE 'stale' END AS state FROM ground", U, ctes=base))
    r.add("keyword_search", g(lambda x: text.keyword_search(x, "find the function small bolt brand#1", 100)), oracle("id:l name:s relevance:d", _keyword_sql("find the function small bolt brand#1"), U))
    r.add("documents_search", lambda spark, sf: text.documents_search(spark.read.parquet(f"{sf}/documents.parquet"), "license copyright warranty software email", 100), oracle("doc_id:l hits:l", "SELECT doc_id, hits FROM (SELECT doc_id, " + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in ("license", "copyright", "warranty", "software", "email")) + " AS hits FROM documents) x WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 100"))


#: A claim's state by what of its references has evidence.
_STATE = """SELECT claim_id, CASE WHEN k = n THEN 'valid' WHEN k = 0 THEN 'deleted' ELSE 'stale' END AS state FROM (SELECT claim_id, count(*) AS n, sum((ref IN (SELECT ref FROM ev))::INT) AS k FROM refs GROUP BY claim_id) x"""


def _cut_names(g: CodeGraph) -> CodeGraph:
    """The graph with names that lack their last two letters, as claims may misspell them."""
    return g.with_units(g.units.withColumn("name", F.expr("left(name, length(name) - 2)")))


def _keyword_sql(query: str) -> str:
    s = " + ".join(f"CASE WHEN lower(name) = '{w}' THEN 5e-1 WHEN contains(lower(name), '{w}') THEN 3e-1 WHEN contains(lower(qualified_name), '{w}') THEN 15e-2 ELSE 0 END" for w in text.keywords(query))
    return f"SELECT * FROM (SELECT id, name, least(1e0, CASE WHEN unit_type = 'function' THEN 15e-2 ELSE 0 END + {s}) AS relevance FROM units) x WHERE relevance > 1e-1 ORDER BY round(relevance, 9) DESC, id LIMIT 100"


def _refs(g: CodeGraph) -> DataFrame:
    """The calls as textual references, by simple name, beside a module of the standard library and a name that nothing has."""
    named = g.edges_of("calls").join(g.units.select(F.col("id").alias("target_id"), "name"), "target_id").select(F.col("source_id").alias("unit_id"), "name", F.lit("call").alias("kind"))
    fn = g.units.where("unit_type = 'function'").select(F.col("id").alias("unit_id"))
    return named.unionByName(fn.select("unit_id", F.lit("os.path").alias("name"), F.lit("import").alias("kind"))).unionByName(fn.select("unit_id", F.lit("no_such_thing").alias("name"), F.lit("call").alias("kind")))


def _infer(r: Registry, g) -> None:
    r.add("resolve_refs", g(lambda x: infer.resolve(x.units, _refs(x))), oracle("unit_id:l name:s kind:s target_id:l resolution:s library:s", """
        SELECT unit_id, name, kind, target AS target_id, CASE WHEN target IS NOT NULL THEN 'local' WHEN lib IS NOT NULL THEN 'external' ELSE 'unresolved' END AS resolution, CASE WHEN target IS NULL THEN lib END AS library FROM (
          SELECT q.unit_id, q.name, q.kind, CASE WHEN q.kind = 'call' THEN coalesce(CASE WHEN f.id <> q.unit_id THEN f.id END, CASE WHEN a.id <> q.unit_id THEN a.id END) END AS target, CASE WHEN q.name = 'os.path' AND q.language IN ('Python', 'Go') THEN 'os' END AS lib
          FROM q LEFT JOIN f ON f.file_path = q.file_path AND f.name = q.name LEFT JOIN a ON a.name = q.name) x""", U, E, ctes="""
        q0 AS (SELECT DISTINCT source_id AS unit_id, c.name, 'call' AS kind FROM edges JOIN units c ON c.id = target_id WHERE edge_type = 'calls' UNION ALL SELECT id, 'os.path', 'import' FROM units WHERE unit_type = 'function' UNION ALL SELECT id, 'no_such_thing', 'call' FROM units WHERE unit_type = 'function'),
        q AS (SELECT q0.*, u.file_path, u.language FROM q0 JOIN units u ON u.id = unit_id), f AS (SELECT file_path, name, min(id) AS id FROM units GROUP BY ALL), a AS (SELECT name, min(id) AS id FROM units GROUP BY ALL)"""))
    r.add("containment_build", g(lambda x: infer.containment_edges(x.units)), oracle("source_id:l target_id:l edge_type:s", "SELECT m.id AS source_id, u.id AS target_id, 'contains' AS edge_type FROM units u JOIN (SELECT file_path, min(id) AS id FROM units WHERE unit_type = 'module' GROUP BY file_path) m ON m.file_path = u.file_path WHERE u.unit_type NOT IN ('module', 'import')", U))
    made = lambda x: x.units.withColumn("name", F.when(F.col("unit_type") == "function", F.regexp_replace("name", "^(red|small)_", "create_")).otherwise(F.regexp_replace("name", "^Supplier#", "store_")))
    r.add("design_patterns", g(lambda x: infer.design_patterns(made(x))), oracle("pattern:s id:l confidence:d", """
        SELECT 'Factory' AS pattern, id, 5e-1 AS confidence FROM units WHERE unit_type = 'function' AND regexp_matches(name, '^(red|small)_') UNION ALL SELECT 'Repository', id, 4e-1 FROM units WHERE unit_type = 'type' AND starts_with(name, 'Supplier#')""", U))
    cs = _concept_sql(infer.EXTRACTED, False, "1e-1", "'function', 'type'", "> 3e-1")
    r.add("concept_extract", g(lambda x: infer.extract_concepts(x.units)), oracle("concept:s id:l score:d", cs, U))
    r.add("concept_confidence", g(lambda x: infer.concept_confidence(infer.extract_concepts(x.units))), oracle("concept:s units:l confidence:d", f"SELECT concept, count(*) AS units, avg(score) AS confidence FROM ({cs}) z GROUP BY concept", U))
    ns = _concept_sql(infer.KNOWN, True, "5e-2", "'function', 'type'", ">= 3e-1")
    r.add("concept_nav", g(lambda x: infer.navigate_concepts(x.units)), oracle("concept:s id:l score:d", ns, U))
    r.add("concept_nav_confidence", g(lambda x: infer.navigation_confidence(infer.navigate_concepts(x.units))), oracle("concept:s units:l confidence:d", f"SELECT concept, count(*) AS units, least(1e0, 6e-1 * max(score) + least(4e-1, 1e-1 * count(*))) AS confidence FROM ({ns}) z GROUP BY concept", U))
    r.add("architecture_roles", g(lambda x: infer.roles(x.units)), oracle("id:l role:s", "SELECT * FROM roles", U, ctes=_role_sql()))
    r.add("architecture_flows", g(lambda x: infer.role_flows(x)), oracle("from_role:s to_role:s calls:l", "SELECT a.role AS from_role, b.role AS to_role, count(*) AS calls FROM edges JOIN roles a ON a.id = source_id JOIN roles b ON b.id = target_id WHERE edge_type = 'calls' AND a.role <> b.role GROUP BY ALL", U, E, ctes=_role_sql()))
    r.add("architecture", g(lambda x: infer.architecture(x)), oracle("pattern:s layers:l classified:d confidence:d", """
        SELECT CASE WHEN c > 0 AND m > 0 AND p = 0 THEN 'mvc' WHEN c > 0 AND s > 0 AND p > 0 THEN 'layered' WHEN s > 0 AND p > 0 AND c = 0 THEN 'hexagonal' WHEN kinds <= 2 THEN 'monolith' ELSE 'unknown' END AS pattern, layers, known AS classified, 7e-1 * known + least(3e-1, 1e-1 * layers) AS confidence FROM (
          SELECT *, (c > 0)::INT + (s > 0)::INT + (p > 0)::INT AS layers, (c > 0)::INT + (s > 0)::INT + (p > 0)::INT + (m > 0)::INT + (f > 0)::INT + (e > 0)::INT AS kinds, (n - u) / CAST(n AS DOUBLE) AS known FROM (
            SELECT count(*) AS n, """ + ", ".join(f"sum((role = '{x}')::INT) AS {y}" for x, y in (("controller", "c"), ("service", "s"), ("repository", "p"), ("model", "m"), ("configuration", "f"), ("entrypoint", "e"), ("utility", "u"))) + " FROM roles) x) y", U, ctes=_role_sql()))
    r.add("architecture_anomalies", g(lambda x: infer.architecture_anomalies(x)), oracle("source_id:l target_id:l", "SELECT source_id, target_id FROM edges JOIN roles a ON a.id = source_id AND a.role = 'repository' JOIN roles b ON b.id = target_id AND b.role = 'controller' WHERE edge_type = 'calls'", U, E, ctes=_role_sql()))
    r.add("naming_patterns", g(lambda x: infer.naming_patterns(x.units)), oracle("unit_type:s pattern:s n:l confidence:d", """
        SELECT unit_type, pattern, count(*) AS n, least(95e-2, 15e-2 * count(*)) AS confidence FROM (
          SELECT unit_type, split_part(name, '_', 1) || '_*' AS pattern FROM units WHERE unit_type IN ('function', 'type') AND contains(name, '_') AND strlen(split_part(name, '_', 1)) >= 3
          UNION ALL SELECT unit_type, '*_' || split_part(name, '_', -1) FROM units WHERE unit_type IN ('function', 'type') AND contains(name, '_') AND strlen(split_part(name, '_', -1)) >= 4) x GROUP BY ALL HAVING count(*) >= 3""", U))
    r.add("dir_patterns", g(lambda x: infer.directory_patterns(x.units)), oracle("directory:s unit_type:s n:l confidence:d", """
        SELECT directory, unit_type, n, least(9e-1, k / CAST(n AS DOUBLE)) AS confidence FROM (SELECT *, sum(k) OVER (PARTITION BY directory) AS n FROM (SELECT regexp_replace(file_path, '/?[^/]*$', '') AS directory, unit_type, count(*) AS k FROM units GROUP BY ALL) x) y WHERE n >= 3 AND k / CAST(n AS DOUBLE) > 7e-1""", U))
    r.add("name_checks", g(lambda x: infer.check_names(x.units, "small_", "Brand#1")), oracle("id:l name:s", "SELECT id, name FROM units WHERE unit_type = 'function' AND starts_with(file_path, 'Brand#1') AND NOT starts_with(name, 'small_')", U))
    r.add("complexity_buckets", g(lambda x: x.units.groupBy(infer.complexity_bucket(F.col("complexity")).alias("bucket")).agg(F.count("*").alias("n"))), oracle("bucket:s n:l", "SELECT CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 15 THEN 'medium' WHEN complexity <= 30 THEN 'high' ELSE 'very_high' END AS bucket, count(*) AS n FROM units GROUP BY 1", U))


def _workspace(r: Registry, g) -> None:
    langs = "['C#', 'C++', 'Go', 'Java', 'JavaScript', 'Python', 'Rust', 'TypeScript']"
    every = ("C#", "C++", "Go", "Java", "JavaScript", "Python", "Rust", "TypeScript")
    r.add("workspace_query", g(lambda x: workspace.query_all(contexts_of(x), "bolt")), oracle("context:s id:l name:s", "SELECT language AS context, id, name FROM units WHERE contains(lower(name), 'bolt')", U))
    r.add("compare_symbol", g(lambda x: workspace.compare_symbol(contexts_of(x), "SMALL_RING")), oracle("context:s id:l unit_type:s signature:s same_type:b same_signature:b", """
        SELECT context, id, unit_type, signature, unit_type = first_value(unit_type) OVER w AS same_type, signature IS NOT DISTINCT FROM first_value(signature) OVER w AS same_signature FROM (
          SELECT language AS context, id, unit_type, signature, row_number() OVER (PARTITION BY language ORDER BY id) AS no FROM units WHERE lower(name) = 'small_ring') x WHERE no = 1 WINDOW w AS (ORDER BY context ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", U))
    r.add("cross_reference", g(lambda x: workspace.cross_reference(contexts_of(x), every)), oracle("name:s found_in:a missing_from:a", f"SELECT name, found_in, [x for x in {langs} if NOT list_contains(found_in, x)] AS missing_from FROM (SELECT lower(name) AS name, list_sort(list(DISTINCT language)) AS found_in FROM units GROUP BY 1) x", U))
    ab = "a AS (SELECT * FROM units WHERE language = 'Rust'), b AS (SELECT * FROM units WHERE language = 'Go')"
    r.add("compare_graphs", g(lambda x: workspace.compare_graphs(_of(x, "Rust"), _of(x, "Go"))), oracle("common:l only_a:l only_b:l similarity:d", """
        SELECT *, 2e0 * common / (2 * common + only_a + only_b) AS similarity FROM (SELECT sum((x AND y)::INT) AS common, sum((x AND NOT y)::INT) AS only_a, sum((y AND NOT x)::INT) AS only_b FROM (
          SELECT n, bool_or(s = 1) AS x, bool_or(s = 2) AS y FROM (SELECT lower(name) AS n, 1 AS s FROM a UNION SELECT lower(name), 2 FROM b) z GROUP BY n) w) v""", U, ctes=ab))
    r.add("structural_diff", g(lambda x: workspace.structural_diff(_of(x, "Rust"), _of(x, "Go"))), oracle("directory:s only_a:a only_b:a", """
        SELECT directory, coalesce(list_sort(list(name) FILTER (x AND NOT y)), []) AS only_a, coalesce(list_sort(list(name) FILTER (y AND NOT x)), []) AS only_b FROM (
          SELECT directory, name, bool_or(s = 1) AS x, bool_or(s = 2) AS y FROM (SELECT regexp_replace(file_path, '/?[^/]*$', '') AS directory, name, 1 AS s FROM a UNION SELECT regexp_replace(file_path, '/?[^/]*$', ''), name, 2 FROM b) z GROUP BY ALL) w WHERE NOT (x AND y) GROUP BY directory""", U, ctes=ab))
    words = ("bolt", "ring", "small widget", "nothing")
    r.add("conceptual_diff", g(lambda x: workspace.conceptual_diff(_of(x, "Rust"), _of(x, "Go"), words)), oracle("concept:s in_a:l in_b:l", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{w}' AS concept, (SELECT count(*) FROM a WHERE {c}) AS in_a, (SELECT count(*) FROM b WHERE {c}) AS in_b" for w in words for c in [" OR ".join(f"contains(lower(name), '{v}')" for v in w.split())]) + ") x WHERE in_a > 0 OR in_b > 0", U, ctes=ab))
    r.add("pattern_diff", g(lambda x: workspace.pattern_diff(_of(x, "Rust"), _of(x, "Go"), ("bolt", "ring", "gear"))), oracle("pattern:s in_a:l in_b:l", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '*_{w}' AS pattern, (SELECT count(*) FROM a WHERE ends_with(lower(name), '{w}')) AS in_a, (SELECT count(*) FROM b WHERE ends_with(lower(name), '{w}')) AS in_b" for w in ("bolt", "ring", "gear")) + ") x WHERE in_a > 0 OR in_b > 0", U, ctes=ab))
    dep = names(("calls", "imports", "inherits", "implements", "uses_type", "ffi_binds"))
    r.add("migration_plan", g(lambda x: workspace.migration_plan(x.with_units(_of(x, "Rust")), _of(x, "Go"))), oracle("step:l id:l name:s phase:s dependencies:a", f"""
        SELECT row_number() OVER (ORDER BY rank, id) AS step, id, name, ['types', 'functions', 'tests', 'rest'][rank + 1] AS phase, coalesce(dependencies, []) AS dependencies FROM (
          SELECT a.id, name, CASE WHEN unit_type IN ('type', 'trait') THEN 0 WHEN unit_type = 'function' THEN 1 WHEN unit_type = 'test' THEN 2 ELSE 3 END AS rank, dependencies FROM a LEFT JOIN d ON d.id = a.id WHERE name NOT IN (SELECT name FROM b)) x""", U, E, ctes=ab + f", d AS (SELECT source_id AS id, list_sort(list(DISTINCT t.name)) AS dependencies FROM edges JOIN a t ON t.id = target_id WHERE edge_type IN ({dep}) GROUP BY source_id)"))
    tl = """state AS (SELECT name AS source_symbol, arg_max(qualified_name, id) AS target_symbol, arg_max(CASE WHEN stability_score < 5e-1 THEN 'not_started' WHEN stability_score < 6e-1 THEN 'in_progress' WHEN stability_score < 7e-1 THEN 'ported' WHEN stability_score < 8e-1 THEN 'verified' ELSE 'skipped' END, id) AS status FROM units WHERE unit_type = 'function' GROUP BY name)"""
    r.add("translation_state", g(lambda x: workspace.translation_state(translation_log(x)).drop("notes")), oracle("source_symbol:s target_symbol:s status:s", "SELECT * FROM state", U, ctes=tl))
    r.add("translation_progress", g(lambda x: workspace.translation_progress(translation_log(x))), oracle("total:l not_started:l in_progress:l ported:l verified:l skipped:l percent:d", "SELECT *, 1e2 * (ported + verified + skipped) / total AS percent FROM (SELECT count(*) AS total, " + ", ".join(f"sum((status = '{s}')::INT) AS {s}" for s in ("not_started", "in_progress", "ported", "verified", "skipped")) + " FROM state) x", U, ctes=tl))
    r.add("translation_remaining", g(lambda x: workspace.translation_remaining(translation_log(x)).drop("notes")), oracle("source_symbol:s target_symbol:s status:s", "SELECT * FROM state WHERE status IN ('not_started', 'in_progress')", U, ctes=tl))


def _insights(r: Registry, g) -> None:
    p = _PROFILE
    r.add("resurrect_search", g(lambda x: insights.resurrect_search(x, "bolt", 100)), oracle("id:l name:s deprecated:b", "SELECT id, name, regexp_matches(lower(name) || ' ' || lower(coalesce(doc_summary, '')), 'deprecated|legacy|obsolete|old_') AS deprecated FROM units WHERE contains(lower(name), 'bolt') OR contains(lower(coalesce(doc_summary, '')), 'bolt') ORDER BY id LIMIT 100", U))
    evid = "e AS (SELECT id, unit_type AS source, name FROM units WHERE unit_type = 'test' AND (contains(lower(name), 'bolt') OR contains(lower(coalesce(doc_summary, '')), 'bolt')) OR contains(lower(coalesce(signature, '')), 'bolt'))"
    r.add("resurrect_evidence", g(lambda x: insights.resurrect_evidence(x, "bolt")), oracle("id:l source:s name:s", "SELECT * FROM e", U, ctes=evid))
    r.add("resurrect_attempt", g(lambda x: insights.resurrect_attempt(x, "bolt")), oracle("evidence:l status:s confidence:s", "SELECT n AS evidence, CASE WHEN n > 0 THEN 'partial_reconstruction' ELSE 'insufficient_evidence' END AS status, CASE WHEN n > 5 THEN 'high' WHEN n > 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT count(*) AS n FROM e) x", U, ctes=evid))
    r.add("resurrect_verify", g(lambda x: insights.resurrect_verify(x, "test_1")), oracle("refs:l has_tests:b status:s confidence:s", "SELECT refs, has_tests, CASE WHEN refs > 0 THEN 'plausible' ELSE 'unverifiable' END AS status, CASE WHEN has_tests AND refs > 2 THEN 'high' WHEN refs > 0 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT count(*) AS refs, coalesce(bool_or(unit_type = 'test'), false) AS has_tests FROM units WHERE contains(lower(name), 'test_1')) x", U))
    r.add("resurrect_history", g(lambda x: insights.resurrect_history(x)), oracle("new_id:l new_name:s old_id:l old_name:s", "SELECT a.id AS new_id, a.name AS new_name, b.id AS old_id, b.name AS old_name FROM edges JOIN units a ON a.id = source_id JOIN units b ON b.id = target_id WHERE edge_type = 'version_of'", U, E))
    r.add("genetics_dna", g(lambda x: insights.genetics_dna(x)), oracle("id:l naming:s complexity:l is_async:b out_types:a in_types:a out_n:l in_n:l has_tests:b has_docs:b stability_score:d", """
        SELECT *, CASE WHEN contains(name, '_') THEN 'snake_case' WHEN regexp_matches(name, '^[A-Z]') THEN 'PascalCase' ELSE 'camelCase' END AS naming, tests > 0 AS has_tests, docs > 0 AS has_docs FROM prof""", U, E, ctes=p))
    r.add("genetics_lineage", g(lambda x: insights.genetics_lineage(x, None, 5)), oracle("root:l id:l depth:l", "SELECT root, id, depth FROM reach WHERE depth > 0", U, E, ctes=walk(insights.LINEAGE, "in", 5, roots="SELECT id FROM units")))
    r.add("genetics_mutations", g(lambda x: insights.genetics_mutations(x)), oracle("id:l mutation:s severity:s", """
        SELECT id, 'complexity_mutation' AS mutation, 'medium' AS severity FROM prof WHERE complexity > 20 UNION ALL SELECT id, 'stability_mutation', 'high' FROM prof WHERE stability_score < 3e-1 AND change_count > 5 UNION ALL SELECT id, 'breaking_mutation', 'high' FROM prof WHERE breaks > 0
        UNION ALL SELECT id, 'naming_mutation', 'low' FROM k WHERE EXISTS (SELECT 1 FROM k s WHERE s.parent = k.parent AND s.unit_type = k.unit_type AND s.snake <> k.snake)""", U, E, ctes=p + ", k AS (SELECT DISTINCT source_id AS parent, u.id, unit_type, contains(name, '_') AS snake FROM edges JOIN units u ON u.id = target_id WHERE edge_type = 'contains')"))
    r.add("genetics_diseases", g(lambda x: insights.genetics_diseases(x)), oracle("id:l disease:s severity:s", """
        SELECT id, 'god_object' AS disease, 'high' AS severity FROM prof WHERE out_n > 20 UNION ALL SELECT DISTINCT a.source_id, 'circular_dependency', 'high' FROM edges a JOIN edges b ON a.source_id = b.target_id AND a.target_id = b.source_id
        UNION ALL SELECT id, 'feature_envy', 'medium' FROM prof WHERE calls_out > 10 AND calls_out > 3 * calls_in UNION ALL SELECT id, 'untested', 'medium' FROM prof WHERE tests = 0 AND unit_type = 'function' UNION ALL SELECT id, 'orphan_code', 'medium' FROM prof WHERE in_n > 0 AND in_n = contained""", U, E, ctes=p))
    r.add("soul_extract", g(lambda x: insights.soul_extract(x)), oracle("id:l purpose:s values:a".replace("values:a", "vals:a"), """
        SELECT id, concat_ws(' ', visibility, unit_type, 'that', CASE WHEN calls_out > 0 THEN 'orchestrates calls' WHEN unit_type = 'test' THEN 'verifies behavior' ELSE 'provides functionality' END) AS purpose,
          [x for x in [CASE WHEN tests > 0 THEN 'correctness' END, CASE WHEN docs > 0 THEN 'documentation' END, CASE WHEN stability_score > 8e-1 THEN 'stability' END, CASE WHEN complexity < 5 THEN 'simplicity' END, CASE WHEN is_async THEN 'concurrency' END] if x IS NOT NULL] AS vals FROM prof""", U, E, ctes=p).replace("AS vals FROM (", 'AS "values" FROM ('))
    sim = """sim AS (SELECT e.a, e.b, CASE WHEN x.unit_type = y.unit_type THEN 3e-1 ELSE 0 END + CASE WHEN x.is_async = y.is_async THEN 1e-1 ELSE 0 END + CASE WHEN abs(x.complexity - y.complexity) < 5 THEN 2e-1 ELSE 0 END
        + 4e-1 * (len(list_intersect(x.out_types, y.out_types)) / CAST(greatest(len(x.out_types), len(y.out_types), 1) AS DOUBLE)) AS similarity FROM (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE edge_type = 'calls') e JOIN prof x ON x.id = e.a JOIN prof y ON y.id = e.b)"""
    r.add("soul_compare", g(lambda x: insights.soul_compare(x, x.edges_of("calls").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct())), oracle("a:l b:l similarity:d verdict:s", "SELECT *, CASE WHEN round(similarity, 9) > 8e-1 THEN 'same_soul' WHEN round(similarity, 9) > 5e-1 THEN 'related_souls' ELSE 'different_souls' END AS verdict FROM sim", U, E, ctes=p + "," + sim))
    r.add("soul_preserve", g(lambda x: insights.soul_preserve(x, "Rust")), oracle("id:l from_language:s to_language:s out_n:l in_n:l risk:s", "SELECT id, language AS from_language, 'Rust' AS to_language, out_n, in_n, CASE WHEN out_n > 10 THEN 'high' WHEN out_n > 5 THEN 'medium' ELSE 'low' END AS risk FROM prof", U, E, ctes=p))
    r.add("soul_reincarnate", g(lambda x: insights.soul_reincarnate(x)), oracle("id:l soul_id:s dependencies:a", "SELECT u.id, 'soul-' || u.id AS soul_id, coalesce(deps, []) AS dependencies FROM units u LEFT JOIN (SELECT source_id, list(t.name ORDER BY target_id, edge_ord)[1:10] AS deps FROM edges JOIN units t ON t.id = target_id GROUP BY source_id) d ON d.source_id = u.id", U, E))
    r.add("soul_karma", g(lambda x: insights.soul_karma(x)), oracle("id:l positive:l negative:l karma:l level:s", """
        SELECT *, CASE WHEN karma > 30 THEN 'enlightened' WHEN karma > 10 THEN 'good' WHEN karma > -10 THEN 'neutral' ELSE 'troubled' END AS level FROM (SELECT *, positive - negative AS karma FROM (SELECT id, tests * 10 + docs * 5 + CASE WHEN stability_score > 8e-1 THEN 15 ELSE 0 END + CASE WHEN complexity < 10 THEN 10 ELSE 0 END AS positive,
          breaks * 20 + CASE WHEN complexity > 20 THEN 15 ELSE 0 END + CASE WHEN tests = 0 AND unit_type = 'function' THEN 10 ELSE 0 END + CASE WHEN stability_score < 3e-1 THEN 10 ELSE 0 END AS negative FROM prof) x) y""", U, E, ctes=p))
    q = "(contains(lower(name), 'bolt') OR contains(lower(qualified_name), 'bolt'))"
    tested = "t AS (SELECT DISTINCT target_id AS id FROM edges WHERE edge_type = 'tests')"
    r.add("omniscience_search", g(lambda x: insights.omniscience_search(contexts_of(x), "bolt", 100)), oracle("graph:s id:l name:s", f"SELECT language AS graph, id, name FROM units WHERE {q} ORDER BY language, id LIMIT 100", U))
    r.add("omniscience_best", g(lambda x: insights.omniscience_best(contexts_of(x), _tested(x), "bolt", 5)), oracle("graph:s id:l score:d", f"""
        SELECT * FROM (SELECT language AS graph, id, 15e-2 + CASE WHEN id IN (SELECT id FROM t) THEN 3e-1 ELSE 0 END + CASE WHEN doc_summary IS NOT NULL THEN 2e-1 ELSE 0 END + CASE WHEN stability_score > 7e-1 THEN 2e-1 ELSE 0 END + CASE WHEN complexity < 10 THEN 15e-2 ELSE 0 END AS score FROM units WHERE {q}) x ORDER BY round(score, 9) DESC, graph, id LIMIT 5""", U, E, ctes=tested))
    r.add("omniscience_census", g(lambda x: insights.omniscience_census(contexts_of(x))), oracle("graph:s language:s unit_type:s n:l", "SELECT language AS graph, language, unit_type, count(*) AS n FROM units GROUP BY ALL", U))
    r.add("omniscience_trend", g(lambda x: insights.omniscience_trend(contexts_of(x), "bolt")), oracle("graph:s n:l avg_stability:d avg_changes:d avg_complexity:d trend:s", f"""
        SELECT *, CASE WHEN avg_changes > 5 AND avg_stability < 5e-1 THEN 'declining' WHEN avg_stability > 7e-1 AND avg_complexity < 15 THEN 'stable' ELSE 'emerging' END AS trend FROM (SELECT language AS graph, count(*) AS n, avg(stability_score) AS avg_stability, avg(change_count) AS avg_changes, avg(complexity) AS avg_complexity FROM units WHERE {q} GROUP BY language) x""", U))
    r.add("omniscience_vuln", g(lambda x: insights.omniscience_vuln(x, ("ring", "exec", "bolt"))), oracle("id:l name:s keyword:s severity:s", "SELECT *, 'medium' AS severity FROM (SELECT id, name, CASE WHEN contains(lower(name), 'ring') OR contains(lower(coalesce(signature, '')), 'ring') THEN 'ring' WHEN contains(lower(name), 'bolt') OR contains(lower(coalesce(signature, '')), 'bolt') THEN 'bolt' END AS keyword FROM units) x WHERE keyword IS NOT NULL", U))
    r.add("omniscience_practices", g(lambda x: insights.omniscience_practices(x)), oracle("id:l score:l grade:s", """
        SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM (SELECT id, CASE WHEN tests > 0 THEN 20 ELSE 0 END + CASE WHEN docs > 0 THEN 15 ELSE 0 END + CASE WHEN complexity < 10 THEN 20 WHEN complexity < 20 THEN 10 ELSE 0 END + CASE WHEN stability_score > 7e-1 THEN 15 ELSE 0 END
          + CASE WHEN out_n < 10 THEN 15 ELSE 0 END + CASE WHEN doc_summary IS NOT NULL THEN 15 ELSE 0 END AS score FROM prof) x""", U, E, ctes=p))
    r.add("api_usage", g(lambda x: insights.api_usage(x, "bolt")), oracle("caller_id:l caller:s callee_id:l callee:s", "SELECT a.id AS caller_id, a.name AS caller, b.id AS callee_id, b.name AS callee FROM edges JOIN units a ON a.id = source_id JOIN units b ON b.id = target_id WHERE edge_type = 'calls' AND contains(lower(b.name), 'bolt')", U, E))
    r.add("omniscience_solve", g(lambda x: insights.solve(contexts_of(x), "a small bolt for parts", 50)), oracle("graph:s id:l score:d", "SELECT * FROM (SELECT language AS graph, id, (" + " + ".join(f"(contains(lower(name), '{w}') OR contains(lower(coalesce(doc_summary, '')), '{w}'))::INT" for w in ("small", "bolt", "for", "parts")) + ") / 4e0 AS score FROM units) x WHERE score > 0 ORDER BY score DESC, graph, id LIMIT 50", U))
    r.add("telepathy_insights", g(lambda x: insights.telepathy_insights(contexts_of(x), _tested(x))), oracle("graph:s units:l functions:l test_ratio:d complex_ids:a", """
        SELECT graph, units, functions, tested / CAST(greatest(1, functions) AS DOUBLE) AS test_ratio, coalesce(complex_ids, [])[1:5] AS complex_ids FROM (SELECT language AS graph, count(*) AS units, sum((unit_type = 'function')::INT) AS functions, sum((unit_type = 'function' AND id IN (SELECT id FROM t))::INT) AS tested, list_sort(list(id) FILTER (complexity > 15)) AS complex_ids FROM units GROUP BY language) x""", U, E, ctes=tested))
    r.add("telepathy_consensus", g(lambda x: insights.telepathy_consensus(contexts_of(x), "bolt")), oracle("matching:l total:l level:s", "SELECT *, CASE WHEN matching = 0 THEN 'none' WHEN matching = total THEN 'universal' WHEN matching * 2 > total THEN 'majority' ELSE 'minority' END AS level FROM (SELECT sum(h) AS matching, count(*) AS total FROM (SELECT language, max(contains(lower(name), 'bolt')::INT) AS h FROM units GROUP BY language) x) y", U))


def _shaping(r: Registry) -> None:
    log = "log AS (SELECT user_id AS key, event_id AS version, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS change_type, value FROM events)"
    r.add("delta_since", lambda spark, sf: shaping.changes_since(_delta_log(spark, sf), 500).select("key", "version", "change_type", "value"), oracle("key:l version:l change_type:s value:d", "SELECT * FROM log WHERE version > 500", ctes=log))
    r.add("delta_state", lambda spark, sf: shaping.state_at(_delta_log(spark, sf)), oracle("key:l value:d", "SELECT key, value FROM (SELECT key, arg_max(value, version) AS value, arg_max(change_type, version) AS c FROM log GROUP BY key) x WHERE c <> 'delete'", ctes=log))
    audit = "audit AS (SELECT event_type AS layer, CAST(floor(value) AS BIGINT) AS tokens, CAST(floor(value) * 3 AS BIGINT) AS full_tokens FROM events)"
    r.add("layer_report", lambda spark, sf: shaping.layer_report(_events(spark, sf)), oracle("layer:s operations:l tokens:l saved:l share:d", "SELECT layer, count(*) AS operations, sum(tokens) AS tokens, sum(greatest(0, full_tokens - tokens)) AS saved, sum(greatest(0, full_tokens - tokens)) / CAST((SELECT sum(full_tokens) FROM audit) AS DOUBLE) AS share FROM audit GROUP BY layer", ctes=audit))
    r.add("conservation_report", lambda spark, sf: shaping.conservation(_events(spark, sf)), oracle("operations:l tokens:l full_tokens:l score:d verdict:s", "SELECT *, CASE WHEN score >= 9e-1 THEN 'excellent' WHEN score >= 7e-1 THEN 'good' WHEN score >= 5e-1 THEN 'fair' WHEN score >= 3e-1 THEN 'poor' ELSE 'wasteful' END AS verdict FROM (SELECT *, 1 - tokens / CAST(full_tokens AS DOUBLE) AS score FROM (SELECT count(*) AS operations, sum(tokens) AS tokens, sum(full_tokens) AS full_tokens FROM audit) x) y", ctes=audit))
    r.add("unit_page", lambda spark, sf: shaping.page(shaping.extract(graph(spark, sf).units, "summary"), ["id"], 100, 50)[0], oracle("id:l name:s unit_type:s", "SELECT id, name, unit_type FROM units ORDER BY id LIMIT 50 OFFSET 100", U))
    r.add("shareable_texts", lambda spark, sf: shaping.shareable(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit("raw_text").alias("kind"), "text")).select("doc_id"), oracle("doc_id:l", f"SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(coalesce(text, '')), '{'|'.join(shaping.CREDENTIALS)}')"))
