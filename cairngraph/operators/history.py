"""Analytics over the change log: path statistics, co-change, stability, prophecy, alerts, archaeology.

``changes`` has the columns of functions.schema.CHANGES; times are Unix seconds and ``now`` is always a parameter.
Everything is aggregation by path or by commit; pairs of paths come from an equi-join on the commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions import schema as S
from cairngraph.graph import CodeGraph

DAY = 86_400


def _log2(c: Column) -> Column:
    """log2, at least 0."""
    return F.greatest(F.lit(0.0), F.log2(F.greatest(F.lit(1), c)))


def path_stats(changes: DataFrame, now: int | None = None, recent_days: int = 30) -> DataFrame:
    """(path, n, bugfixes, authors, churn, added, deleted, first, last[, recent, recent_bugfixes]) of each path."""
    fix = F.when(F.col("is_bugfix"), 1).otherwise(0)
    what = [
        F.count("*").alias("n"), F.sum(fix).alias("bugfixes"), F.array_sort(F.collect_set("author")).alias("authors"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("churn"),
        F.sum("lines_added").alias("added"), F.sum("lines_deleted").alias("deleted"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    ]
    if now is not None:
        recent = F.col("timestamp") >= now - recent_days * DAY
        what += [F.sum(F.when(recent, 1).otherwise(0)).alias("recent"), F.sum(F.when(recent & F.col("is_bugfix"), 1).otherwise(0)).alias("recent_bugfixes")]
    return changes.groupBy("path").agg(*what)


def totals(changes: DataFrame) -> DataFrame:
    """(changes, commits, paths, authors): one row."""
    return changes.agg(F.count("*").alias("changes"), F.countDistinct("commit_id").alias("commits"), F.countDistinct("path").alias("paths"), F.countDistinct("author").alias("authors"))


def co_changes(changes: DataFrame, max_paths: int = 0) -> DataFrame:
    """(path_a, path_b, n): commits in which both paths change. ``max_paths`` above 0 leaves out larger commits (0: none)."""
    per = changes.select("commit_id", "path").distinct()
    if max_paths > 0:
        per = per.join(per.groupBy("commit_id").agg(F.count("*").alias("k")).where(F.col("k") <= max_paths), "commit_id", "left_semi")
    a, b = per.select("commit_id", F.col("path").alias("path_a")), per.select("commit_id", F.col("path").alias("path_b"))
    return a.join(b, "commit_id").where("path_a < path_b").groupBy("path_a", "path_b").agg(F.count("*").alias("n"))


def coupling(changes: DataFrame, min_count: int = 3, min_strength: float = 0.5, graph: CodeGraph | None = None, limit: int = 0, max_paths: int = 0) -> DataFrame:
    """(path_a, path_b, n, strength, kind), the strongest first: n / the larger number of changes; explicit_edge if a unit of a depends on one of b."""
    rows = changes.groupBy("path").agg(F.count("*").alias("k"))
    pairs = co_changes(changes, max_paths).where(F.col("n") >= min_count)
    j = pairs.join(rows.select(F.col("path").alias("path_a"), F.col("k").alias("ka")), "path_a").join(rows.select(F.col("path").alias("path_b"), F.col("k").alias("kb")), "path_b")
    j = j.withColumn("strength", F.least(F.lit(1.0), F.col("n") / F.greatest("ka", "kb"))).where(F.col("strength") >= min_strength)
    if graph is not None:
        at = graph.units.select("id", "file_path")
        e = graph.edges.select("source_id", "target_id").join(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("path_a")), "source_id")
        e = e.join(at.select(F.col("id").alias("target_id"), F.col("file_path").alias("path_b")), "target_id").select("path_a", "path_b", F.lit(True).alias("linked")).distinct()
        j = j.join(e, ["path_a", "path_b"], "left").withColumn("kind", F.when(F.col("linked"), "explicit_edge").otherwise("co_change"))
    else:
        j = j.withColumn("kind", F.lit("co_change"))
    out = j.select("path_a", "path_b", "n", "strength", "kind").orderBy(F.round("strength", 9).desc(), "path_a", "path_b")
    return out.limit(limit) if limit > 0 else out


def stability(changes: DataFrame, now: int, recent_days: int = 30, weights: tuple[float, ...] = (0.25, 0.25, 0.20, 0.15, 0.15)) -> DataFrame:
    """(path, frequency, bugfix, recent, authors, churn, score, advice): five factors and their weighted mean."""
    n = F.col("n")
    p = path_stats(changes, now, recent_days)
    parts = {
        "frequency": F.lit(1.0) / (1.0 + _log2(n)), "bugfix": F.lit(1.0) - F.col("bugfixes") / n, "activity": F.lit(1.0) - F.col("recent") / n,
        "ownership": F.lit(1.0) / F.greatest(F.lit(1), F.size("authors")), "churn_factor": F.lit(1.0) / (1.0 + _log2(F.col("churn"))),
    }
    total = sum(weights)
    p = p.withColumns(parts)
    score = sum((F.col(c) * (w / total) for c, w in zip(parts, weights, strict=True)), F.lit(0.0))
    advice = F.concat_ws("; ", F.when(F.col("bugfixes") / n > 0.5, "most changes are fixes"), F.when(F.col("recent") > 5, "changes often of late"), F.when(F.size("authors") > 5, "many authors"))
    return p.select("path", *parts, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"), advice.alias("advice"))


def stability_of(changes: DataFrame, path: str, now: int) -> DataFrame:
    """stability() of one path; a path without history has the score 1 and the factor no_history."""
    found = stability(changes.where(F.col("path") == path), now).select("path", "score", F.lit("history").alias("factor"))
    none = changes.sparkSession.createDataFrame([(path, 1.0, "no_history")], found.schema)
    return found.unionByName(none.join(found.select("path"), "path", "left_anti"))


def prophecy(changes: DataFrame, now: int, min_risk: float = 0.3, top_k: int = 20, recent_days: int = 30) -> DataFrame:
    """(path, velocity, bugfix_trend, growth, coupling, risk, kind) of the paths most at risk."""
    scored = prophecy_factors(changes, now, recent_days)
    out = scored.where(F.col("risk") >= min_risk).orderBy(F.round("risk", 9).desc(), "path")
    return out.limit(top_k) if top_k > 0 else out


def prophecy_factors(changes: DataFrame, now: int, recent_days: int = 30) -> DataFrame:
    """As prophecy, for every path."""
    p = path_stats(changes, now, recent_days)
    pairs = coupling(changes, 2, 0.3)
    ends = pairs.select(F.explode(F.array("path_a", "path_b")).alias("path"), "strength").groupBy("path").agg(F.avg("strength").alias("avg_strength"), F.count("*").alias("k"))
    n, recent, net = F.col("n"), F.col("recent"), F.col("added") - F.col("deleted")
    k = F.coalesce("k", F.lit(0))
    j = p.join(ends, "path", "left").select(
        "path",
        (0.5 * recent / n + 0.5 * F.least(F.lit(1.0), recent / 5.0)).alias("velocity"),
        (0.4 * F.col("bugfixes") / n + 0.6 * F.when(recent > 0, F.col("recent_bugfixes") / recent).otherwise(0.0)).alias("bugfix_trend"),
        F.when(net > 0, net / (net + 100.0)).otherwise(0.0).alias("growth"),
        F.when(k > 0, 0.6 * F.coalesce("avg_strength", F.lit(0.0)) + 0.4 * F.least(F.lit(1.0), F.sqrt(k) / 3.0)).otherwise(0.0).alias("coupling"),
    )
    risk = 0.3 * F.col("velocity") + 0.3 * F.col("bugfix_trend") + 0.15 * F.col("growth") + 0.25 * F.col("coupling")
    top = F.greatest("velocity", "bugfix_trend", "growth", "coupling")
    kind = F.when(F.col("bugfix_trend") == top, "bug_risk").when(F.col("velocity") == top, "change_velocity").when(F.col("coupling") == top, "coupling_risk").otherwise("complexity_growth")
    return j.withColumn("risk", F.least(F.lit(1.0), risk)).withColumn("kind", kind)


def alerts(changes: DataFrame, now: int, recent_days: int = 30) -> DataFrame:
    """(alert, path, risk): a hotspot for each path of a risk above 0.7; if the mean risk exceeds 0.6, the five riskiest paths as systemic."""
    f = prophecy_factors(changes, now, recent_days)
    mean = f.agg(F.avg("risk").alias("mean"))
    hot = f.where("risk > 0.7").select(F.lit("hotspot").alias("alert"), "path", "risk")
    first = f.where("risk >= 0.3").orderBy(F.round("risk", 9).desc(), "path").limit(5)
    systemic = first.crossJoin(F.broadcast(mean)).where("mean > 0.6").select(F.lit("systemic").alias("alert"), "path", "risk")
    return hot.unionByName(systemic)


def node_prophecy(graph: CodeGraph) -> DataFrame:
    """(id, predictions, confidence): complexity above 15, changes above 10, stability below 0.3, more than 10 incoming edges."""
    u = graph.units.join(graph.in_degree(name="deg"), "id", "left")
    checks = [(F.col("complexity") > 15, "complexity", 0.8), (F.col("change_count") > 10, "changes", 0.7), (F.col("stability_score") < 0.3, "instability", 0.8), (F.coalesce("deg", F.lit(0)) > 10, "dependents", 0.9)]
    found = F.array_compact(F.array(*[F.when(c, name) for c, name, _ in checks]))
    weight = sum((F.when(c, w).otherwise(0.0) for c, _, w in checks), F.lit(0.0))
    return u.select("id", found.alias("predictions"), F.when(F.size(found) > 0, weight / F.greatest(F.lit(1), F.size(found))).otherwise(0.3).alias("confidence"))


def module_prophecy(graph: CodeGraph, prefix: str | None = None) -> DataFrame:
    """(module, units, avg_complexity, changes, prediction): of one qualified-name prefix, or of each first segment."""
    u = graph.units
    module = F.lit(prefix) if prefix is not None else F.regexp_extract("qualified_name", r"^([^.:]*)", 1)
    if prefix is not None:
        u = u.where(F.col("qualified_name").startswith(prefix))
    g = u.groupBy(module.alias("module")).agg(F.count("*").alias("units"), F.avg("complexity").alias("avg_complexity"), F.sum("change_count").alias("changes"))
    return g.withColumn("prediction", F.when(F.col("avg_complexity") > 10, "complexity").when(F.col("changes") > 50, "instability").otherwise("healthy"))


def pattern_prophecy(spark: SparkSession, *patterns: str) -> DataFrame:
    """(pattern, prediction, probability, evidence_weight): patterns have no history of their own, so the answer is a constant."""
    rows = [(p, "too little data about patterns", 0.5, 0.3) for p in patterns]
    return spark.createDataFrame(rows, "pattern string, prediction string, probability double, evidence_weight double")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, predictions_a, predictions_b, confidence_a, confidence_b) of two tables of predictions, a row for each id of either."""
    side = lambda df, s: df.select("id", F.col("predictions").alias(f"predictions_{s}"), F.col("confidence").alias(f"confidence_{s}"))
    none = F.array().cast("array<string>")
    j = side(a, "a").join(side(b, "b"), "id", "full_outer")
    return j.select("id", F.coalesce("predictions_a", none).alias("predictions_a"), F.coalesce("predictions_b", none).alias("predictions_b"), "confidence_a", "confidence_b")


def scenario(predictions: DataFrame, id_: int, prediction: str, confidence: float) -> DataFrame:
    """node predictions with one more, as if a change were made."""
    extra = predictions.sparkSession.createDataFrame([(id_, [prediction], confidence)], "id long, predictions array<string>, confidence double")
    return predictions.unionByName(extra)


def classify_message(message: Column) -> Column:
    """bugfix, refactor, performance, feature or unknown, by the first group of words that a commit message holds."""
    m = F.lower(message)
    has = lambda *words: F.greatest(*[m.contains(w) for w in words], F.lit(False))
    return (
        F.when(has("bug", "fix", "patch"), "bugfix").when(has("clean up", "cleanup", "refactor", "rename"), "refactor")
        .when(has("fast", "optim", "perf", "speed"), "performance").when(has("add", "feat", "implement", "new"), "feature").otherwise("unknown")
    )


def phases(changes: DataFrame, now: int, recent_days: int = 30) -> DataFrame:
    """(path, n, age_days, idle_days, bugfix_ratio, score, phase): where in its life each path is."""
    p = path_stats(changes, now, recent_days).select("path", "n", "bugfixes", "first", "last").join(stability(changes, now, recent_days).select("path", "score"), "path")
    p = p.select("path", "n", F.floor((F.lit(now) - F.col("first")) / DAY).alias("age_days"), F.floor((F.lit(now) - F.col("last")) / DAY).alias("idle_days"), (F.col("bugfixes") / F.col("n")).alias("bugfix_ratio"), "score")
    phase = (
        F.when(F.col("n") == 0, "unknown").when((F.col("score") > 0.8) & (F.col("age_days") > 180), "stable")
        .when((F.col("bugfix_ratio") > 0.6) & (F.col("age_days") > 90), "decaying").when((F.col("age_days") < 30) | (F.col("n") > 10), "active").otherwise("maturing")
    )
    return p.withColumn("phase", phase)


def investigate(graph: CodeGraph, changes: DataFrame, now: int) -> DataFrame:
    """(id, path, n, phase, why): every unit with the history of its file; units without any are of unknown phase."""
    h = phases(changes, now).withColumnRenamed("path", "file_path")
    j = graph.units.select("id", "file_path", "complexity", "doc_summary").join(h, "file_path", "left")
    why = F.concat_ws("; ", F.col("doc_summary"), F.when(F.col("bugfix_ratio") > 0.5, "shaped by fixes"), F.when(F.col("n") > 10, "often changed"), F.when(F.col("complexity") > 15, "complex"))
    return j.select("id", F.col("file_path").alias("path"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("phase", F.lit("unknown")).alias("phase"), why.alias("why"))


def explain_why(changes: DataFrame, now: int, recent_days: int = 30) -> DataFrame:
    """(path, explanation): why a path is as it is, in sentences about age, fixes, authors, churn and stability."""
    s = stability(changes, now, recent_days).select("path", "score")
    p = path_stats(changes, now, recent_days).select("path", "n", "bugfixes", F.size("authors").alias("people"), "churn", F.floor((F.lit(now) - F.col("first")) / DAY).alias("age")).join(s, "path")
    said = F.concat_ws(
        " ",
        F.when(F.col("age") > 365, F.concat(F.lit("Mature: first changed "), F.col("age").cast("string"), F.lit(" days ago."))).when(F.col("age") < 30, "New: less than 30 days old."),
        F.when(F.col("bugfixes") / F.col("n") > 0.5, "More than half of its changes are fixes."),
        F.when(F.col("people") > 3, F.concat(F.lit("Shared by "), F.col("people").cast("string"), F.lit(" authors."))).when(F.col("people") == 1, "Owned by one author."),
        F.when(F.col("churn") > 500, F.concat(F.lit("Reworked: "), F.col("churn").cast("string"), F.lit(" lines changed."))),
        F.when(F.col("score") < 0.3, "Volatile.").when(F.col("score") > 0.8, "Settled."),
    )
    usual = F.concat(F.lit("An ordinary history of "), F.col("n").cast("string"), F.lit(" changes."))
    return p.select("path", F.when(said == "", usual).otherwise(said).alias("explanation"))


def timeline(changes: DataFrame, path: str | None = None) -> DataFrame:
    """(path, timestamp, commit_id, author, change_type, is_bugfix) in order of time."""
    c = changes if path is None else changes.where(F.col("path") == path)
    return c.select("path", "timestamp", "commit_id", "author", "change_type", "is_bugfix").orderBy("path", "timestamp", "commit_id")


def validate(changes: DataFrame) -> DataFrame:
    """The changes whose type isn't known or whose path is missing."""
    return changes.where(F.col("path").isNull() | ~F.coalesce("change_type", F.lit("")).isin("add", "modify", "delete", "rename")).select(*S.CHANGES.fieldNames())
