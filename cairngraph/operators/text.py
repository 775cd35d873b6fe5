"""Claims about code held against the graph: references in text, evidence, citations, invented symbols, keyword search.

``claims`` is (claim_id, text). References are found by regular expressions in the JVM; evidence is an equi-join on
names, and only what it doesn't find is looked up in an index of three letters; close names meet by prefix and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions import schema as S
from cairngraph.functions.storage import Scratch
from cairngraph.graph import CodeGraph
from cairngraph.operators import match

STOP = frozenset(
    """a about above after again all an and are as at be because been before being below between both but by can could did do does down during each every few for from further had has have he her here him his how
    i if in into is it its just may me might more most must my no nor not of off on once only or other our out over own same shall she should so some such than that the their them then there these they this those
    through to too under up us very was we were what when where which while who whom why will with would you your""".split()
)
#: Words of a search query that aren't keywords.
SEARCH_STOP = (STOP - set("about because but did down few he her him his i it its me must my or our she their them these they those up us was we were you your".split())) | set(
    "call class dare enum find function get implement look method need ought search show struct test type usage used was were".split()
)
_SNAKE, _SCREAM = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"
_CAMEL = r"^[A-Z](?=.*[a-z])[A-Za-z0-9]*[A-Z][A-Za-z0-9]*$"


#: Rows of citations for each task.
CITED = 10_000_000


def references(text: Column) -> Column:
    """The identifiers that a text names: spans in backticks (each time), then snake_case, CamelCase and SCREAMING_CASE words, once each."""
    stop = F.array(*[F.lit(w) for w in sorted(STOP)])
    quoted = F.transform(F.regexp_extract_all(text, F.lit("`([^`]*)`"), F.lit(1)), lambda x: F.trim(x))
    quoted = F.filter(quoted, lambda x: (x != "") & ~F.array_contains(stop, F.lower(x)))
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda x: x.rlike(_SNAKE) | x.rlike(_CAMEL) | x.rlike(_SCREAM))
    return F.concat(quoted, F.filter(F.array_distinct(words), lambda x: ~F.array_contains(quoted, x)))


def extract_references(claims: DataFrame) -> DataFrame:
    """(claim_id, pos, ref), in the order of the text."""
    return claims.select("claim_id", F.posexplode(references(F.coalesce("text", F.lit(""))))).select("claim_id", "pos", F.col("col").alias("ref"))


def _tiers(refs: DataFrame, units: DataFrame, unit_types: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Units (id, name, qualified_name), and the distinct refs (ref), stored: those that are names, (word, text) of the others
    that are part of a qualified name, and the rest."""
    scratch = Scratch(units.sparkSession)
    u = units.where(F.col("unit_type").isin(*unit_types)) if unit_types else units
    u = u.select("id", "name", "qualified_name")
    r = refs.select("ref").distinct().join(u.select(F.col("name").alias("ref"), F.lit(True).alias("named")).distinct(), "ref", "left")
    r = scratch.table(r, "refs")
    held = scratch.table(match.contained(r.where("named is null").select("ref"), u.select("qualified_name")), "held")
    rest = scratch.table(r.where("named is null").select("ref").join(held.select(F.col("word").alias("ref")).distinct(), "ref", "left_anti"), "rest")
    return u, r.where("named").select("ref"), held, rest


def evidence(refs: DataFrame, units: DataFrame, unit_types: tuple[str, ...] = ()) -> DataFrame:
    """(ref, id, tier) of refs (ref): 1 the name, else 2 part of a qualified name, else 3 the name in other case."""
    u, named, held, rest = _tiers(refs, units, unit_types)
    exact = named.join(u, F.col("ref") == F.col("name")).select("ref", "id", F.lit(1).alias("tier"))
    part = held.join(u, F.col("text") == F.col("qualified_name")).select(F.col("word").alias("ref"), "id", F.lit(2).alias("tier"))
    case = rest.join(u, F.lower("ref") == F.lower("name")).select("ref", "id", F.lit(3).alias("tier"))
    return exact.unionByName(part).unionByName(case)


def supported(refs: DataFrame, units: DataFrame) -> DataFrame:
    """(ref), distinct: the refs that have evidence, which isn't listed."""
    u, named, held, rest = _tiers(refs, units)
    case = rest.join(u.select(F.lower("name").alias("low")).distinct(), F.lower("ref") == F.col("low"), "left_semi")
    return named.unionByName(held.select(F.col("word").alias("ref")).distinct()).unionByName(case)


def suggest_similar(refs: DataFrame, units: DataFrame, limit: int = 3) -> DataFrame:
    """(ref, name, distance, rank): names close to each ref: one a prefix of the other (distance 0), else an edit distance of 1 to half the ref's length."""
    j = match.close(refs.select("ref"), units.select("name"), 2).withColumnRenamed("word", "ref")
    rank = F.row_number().over(Window.partitionBy("ref").orderBy("distance", "name"))
    return j.withColumn("rank", rank).where(F.col("rank") <= limit).select("ref", "name", "distance", "rank")


def ground_claims(claims: DataFrame, units: DataFrame, strict: bool = False) -> DataFrame:
    """(claim_id, refs, supported, status, confidence): verified, partial or ungrounded; strict makes partial ungrounded."""
    refs = Scratch(units.sparkSession).table(extract_references(claims).select("claim_id", "ref"), "refs")
    known = supported(refs, units).withColumn("known", F.lit(1))
    g = refs.join(known, "ref", "left").groupBy("claim_id").agg(F.count("*").alias("refs"), F.sum(F.coalesce("known", F.lit(0))).alias("supported"))
    j = claims.select("claim_id").join(g, "claim_id", "left").select("claim_id", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("supported", F.lit(0)).alias("supported"))
    n, k = F.col("refs"), F.col("supported")
    status = F.when((n == 0) | (k == 0), "ungrounded").when(k == n, "verified").otherwise("ungrounded" if strict else "partial")
    return j.select("claim_id", "refs", "supported", status.alias("status"), F.when(n > 0, k / F.greatest(F.lit(1), n)).otherwise(0.0).alias("confidence"))


def citations(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, ref, id, strength): what a claim's references cite: direct, strong or partial."""
    scratch = Scratch(units.sparkSession)
    refs = scratch.table(extract_references(claims).select("claim_id", "ref").distinct(), "refs")
    found = scratch.table(evidence(refs, units), "evidence")
    # a name that many claims have and many units bear gives their product: the shares of its claims meet all of its units
    n = refs.groupBy("ref").agg(F.count("*").alias("a")).join(found.groupBy("ref").agg(F.count("*").alias("b")), "ref").agg(F.sum(F.col("a") * F.col("b")).alias("all"), F.max(F.col("a") * F.col("b")).alias("most")).first()
    tasks, shares = max(match._parallel(units), (n["all"] or 0) // CITED), 1 + (n["most"] or 0) // CITED
    dealt = refs.withColumn("share", F.pmod(F.xxhash64("claim_id"), F.lit(shares)).cast("int")).repartition(tasks, "ref", "share")
    every = found.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, "ref", "share")
    label = F.element_at(F.array(F.lit("direct"), F.lit("strong"), F.lit("partial")), F.col("tier"))
    return dealt.join(every, ["ref", "share"]).select("claim_id", "ref", "id", label.alias("strength"))


def contradictions(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, ref, kind) of references without a unit of just that name: contradicted if a similar name exists, else not_found."""
    refs = extract_references(claims).select("claim_id", "ref").distinct()
    missing = refs.join(units.select(F.col("name").alias("ref")).distinct(), "ref", "left_anti")
    similar = match.close(missing.select("ref"), units.select("name"), 3).select(F.col("word").alias("ref")).distinct().withColumn("similar", F.lit(True))
    return missing.join(similar, "ref", "left").select("claim_id", "ref", F.when(F.col("similar"), "contradicted").otherwise("not_found").alias("kind"))


def sentences(claims: DataFrame) -> DataFrame:
    """(claim_id, sentence_no, sentence) of more than five bytes, cut at full stops and line ends."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[.\n]"), lambda s: F.trim(s)), lambda s: F.octet_length(s) > 5)
    return claims.select("claim_id", F.posexplode(parts)).select("claim_id", F.col("pos").alias("sentence_no"), F.col("col").alias("sentence"))


def hallucinations(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, sentence_no, ref, kind, severity): symbols that don't exist, and files that a sentence gives and the unit isn't in.

    A sentence is cut at full stops and a path has one, so no path of a text reaches the second rule, as in the original
    definition; it is kept for sentences that are cut otherwise.
    """
    s = sentences(claims).withColumn("key", F.concat_ws("-", "claim_id", "sentence_no"))
    refs = extract_references(s.select(F.col("key").alias("claim_id"), F.col("sentence").alias("text"))).select(F.col("claim_id").alias("key"), "ref").distinct()
    first = units.groupBy("name").agg(F.min_by("file_path", "id").alias("file"), F.min("id").alias("id"))
    any_case = units.groupBy(F.lower("name").alias("low")).agg(F.min_by("file_path", "id").alias("file_any"))
    j = refs.join(s, "key").join(first.select(F.col("name").alias("ref"), "file"), "ref", "left").join(any_case, F.lower("ref") == F.col("low"), "left")
    where = F.coalesce("file", "file_any")
    paths = F.filter(F.transform(F.split("sentence", r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}/._]+|[^\p{L}\p{N}/._]+$", "")), lambda w: w.contains("/") & w.contains("."))
    told = F.lower("sentence").contains("in ") | F.lower("sentence").contains("file")
    wrong = told & F.exists(paths, lambda p: ~where.contains(p))
    kind = F.when(where.isNull(), "non_existent").when(wrong, "wrong_location")
    return j.select("claim_id", "sentence_no", "ref", kind.alias("kind")).where("kind is not null").withColumn("severity", F.when(F.col("kind") == "non_existent", "severe").otherwise("moderate"))


def hallucination_report(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, sentences, found, score, safe): findings per sentence, at most 1; safe below 0.3."""
    n = sentences(claims).groupBy("claim_id").agg(F.count("*").alias("sentences"))
    h = hallucinations(claims, units).groupBy("claim_id").agg(F.count("*").alias("found"))
    j = claims.select("claim_id").join(n, "claim_id", "left").join(h, "claim_id", "left").select("claim_id", F.coalesce("sentences", F.lit(0)).alias("sentences"), F.coalesce("found", F.lit(0)).alias("found"))
    score = F.when(F.col("sentences") > 0, F.least(F.lit(1.0), F.col("found") / F.greatest(F.lit(1), F.col("sentences")))).otherwise(0.0)
    return j.withColumn("score", score).withColumn("safe", F.col("score") < 0.3)


def suggest_fixes(claims: DataFrame, units: DataFrame, limit: int = 5) -> DataFrame:
    """(ref, name, rank): for each missing symbol the first names of which one is a prefix of the other."""
    missing = hallucinations(claims, units).where("kind = 'non_existent'").select("ref")
    close = match.close(missing.select("ref"), units.select("name"), None).withColumnRenamed("word", "ref")
    rank = F.row_number().over(Window.partitionBy("ref").orderBy("name"))
    return close.select("ref", "name").withColumn("rank", rank).where(F.col("rank") <= limit)


# -- maintained truths


def check_truths(truths: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, state): valid if every reference has evidence, deleted if none has, else stale."""
    g = ground_claims(truths, units)
    return g.select("claim_id", F.when(F.col("status") == "verified", "valid").when(F.col("supported") == 0, "deleted").otherwise("stale").alias("state"))


def truth_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(claim_id, was, now) of the truths whose state differs between two checks."""
    j = before.select("claim_id", F.col("state").alias("was")).join(after.select("claim_id", F.col("state").alias("now")), "claim_id", "full_outer")
    return j.where(~F.col("was").eqNullSafe(F.col("now")))


# -- keyword search


def intent_of(query: str) -> str:
    """test, function, type, usage, implementation or general, by the first rule that a query meets."""
    q = query.lower()
    rules = (
        ("test", ("test", "spec"), ("how is",)), ("function", ("function", "method", "fn "), ("def ",)), ("type", ("type", "struct", "class", "enum", "interface"), ()),
        ("usage", ("usage", "call", "who uses", "where is"), ()), ("implementation", ("implement", "how does", "logic for"), ()),
    )
    return next((name for name, inside, starts in rules if any(w in q for w in inside) or q.startswith(starts)), "general") if q else "general"


def keywords(query: str) -> list[str]:
    """The lower-cased words of two letters or more that aren't stop words, in order."""
    words = "".join(c if c.isalnum() or c == "_" else " " for c in query.lower()).split()
    return [w for w in words if len(w.encode()) >= 2 and w not in SEARCH_STOP]


def keyword_search(graph: CodeGraph, query: str, top_k: int = 10, module: str | None = None, file: str | None = None, unit_type: str | None = None) -> DataFrame:
    """(id, name, relevance): 0.5 for each keyword that is the name, 0.3 in it, 0.15 in the qualified name; 0.15 for the type that the query asks for."""
    u = graph.units
    u = u.where(F.col("qualified_name").startswith(module)) if module else u
    u = u.where(F.col("file_path") == file) if file else u
    u = u.where(F.col("unit_type") == unit_type) if unit_type else u
    name, qname = F.lower("name"), F.lower("qualified_name")
    intent = intent_of(query)
    score = F.when(F.col("unit_type") == intent, 0.15).otherwise(0.0) if intent in ("function", "type", "test") else F.lit(0.0)
    for w in keywords(query):
        score = score + F.when(name == w, 0.5).when(name.contains(w), 0.3).when(qname.contains(w), 0.15).otherwise(0.0)
    out = u.select("id", "name", F.least(F.lit(1.0), score).alias("relevance")).where("relevance > 0.1").orderBy(F.round("relevance", 9).desc(), "id")
    return out.limit(top_k) if top_k > 0 else out


def unknown_query(kind: str, known: list[str]) -> str | None:
    """The known query type closest to a misspelt one, if any is near."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    best = min(known, key=lambda k: (distance(kind, k), k), default=None)
    return best if best is not None and distance(kind, best) <= max(1, len(best) // 2) else None


def documents_search(docs: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """(doc_id, hits): documents by the number of the query's keywords that their text holds; ties by id."""
    words = keywords(query)
    if not words:
        raise S.QueryError("no keywords")
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    out = docs.select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.col("hits").desc(), "doc_id")
    return out.limit(top_k) if top_k > 0 else out
