"""What a graph implies: resolved references, containment, design patterns, concepts, architecture, naming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions import schema as S
from cairngraph.graph import CodeGraph
from cairngraph.operators import match

#: Concepts and their words, first those that compilation extracts, then those that navigation knows.
EXTRACTED = {
    "API": "api controller endpoint graphql handler middleware request response rest route", "Authentication": "auth authenticate credential jwt login logout oauth password session token",
    "Caching": "cache invalidate lru memcached memoize redis ttl", "Configuration": "config configuration env environment feature_flag option preference setting",
    "Database": "database db entity migration model query record repository schema sql table", "ErrorHandling": "catch error exception fallback fault panic recovery retry throw",
    "Logging": "debug error info log logger logging metric telemetry trace warn", "Payment": "billing charge checkout invoice payment paypal refund stripe transaction",
    "Testing": "assert bench benchmark expect fixture mock spec stub test", "UserManagement": "account preferences profile registration settings signup user",
}
KNOWN = {
    "API": "api controller endpoint graphql grpc handler rest route", "Authentication": "auth credential jwt login logout oauth password session token",
    "Caching": "cache invalidate lru memcached memoize redis ttl", "Configuration": "config env environment feature_flag option setting",
    "Database": "database db migration model orm query repository schema sql", "Error Handling": "error exception fallback panic recover result retry throw",
    "Logging": "debug error log logger metric monitor telemetry trace warn", "Payment": "billing charge checkout invoice payment paypal refund stripe",
    "Rate Limiting": "backoff bucket quota rate_limit throttle", "Security": "cors csrf decrypt encrypt hash sanitize security xss",
    "Testing": "assert bench fixture integration_test mock spec stub test", "User Management": "account onboard profile registration signup user",
}
ROLES = (
    ("controller", "controller endpoint handler view"), ("service", "interactor service usecase"), ("repository", "adapter dao repo repository store"),
    ("model", "dto entity model schema"), ("configuration", "config env setting"), ("test", ""), ("entrypoint", "app cli entry main server"),
)
#: Modules that ship with a language.
STDLIB = {
    "Python": "abc argparse asyncio collections contextlib copy csv dataclasses datetime enum functools glob hashlib io itertools json logging math os pathlib pickle random re shutil socket sqlite3 string struct subprocess sys tempfile threading time typing unittest urllib uuid",
    "Rust": "Arc Box HashMap HashSet Mutex Option Rc Result String Vec alloc core std",
    "JavaScript": "Array Date JSON Map Math Object Promise Set console crypto fs http path process", "TypeScript": "Array Date JSON Map Math Object Promise Set console crypto fs http path process",
    "Go": "bufio bytes context errors fmt io math net os sort strconv strings sync time",
}
#: What the names of a store's methods begin with.
CRUD = "create|delete|find|get|list|save|update"
REF_EDGES = {"call": "calls", "import": "imports", "inherit": "inherits", "implement": "implements", "type_use": "uses_type", "access": "references"}


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


# -- references -> edges


def resolve(units: DataFrame, refs: DataFrame, stdlib: dict[str, str] | None = None) -> DataFrame:
    """(unit_id, name, kind, target_id, resolution, library) of refs (unit_id, name, kind).

    Order: a unit of that qualified name (not itself), a unit of that simple name in the same file, anywhere, an import
    in the same file that holds or is held by the name, a module of the standard library, else unresolved. Of several
    candidates the largest id of a qualified name counts and the smallest otherwise.
    """
    simple = F.regexp_extract("name", r"([^.:]+)$", 1)
    u = units.select("id", "name", "qualified_name", "file_path", "unit_type", "language")
    own = u.select(F.col("id").alias("unit_id"), F.col("file_path").alias("file"), F.col("language").alias("lang"))
    r = refs.select("unit_id", "name", "kind").distinct().join(own, "unit_id").withColumn("simple", simple)
    real = u.where("unit_type <> 'import'")
    by_q = real.groupBy("qualified_name").agg(F.max("id").alias("q_id"))
    in_file = real.groupBy(F.col("file_path").alias("file"), F.col("name").alias("simple")).agg(F.min("id").alias("f_id"))
    anywhere = real.groupBy(F.col("name").alias("simple")).agg(F.min("id").alias("g_id"))
    j = r.join(by_q, r["name"] == by_q["qualified_name"], "left").drop("qualified_name").join(in_file, ["file", "simple"], "left").join(anywhere, "simple", "left")
    imports = u.where("unit_type = 'import'").select(F.col("file_path").alias("file"), F.col("name").alias("imported"), F.col("id").alias("i_id"))
    open_ = j.where("q_id is null and f_id is null and g_id is null").select("unit_id", "name", "kind", "file").distinct()
    found = open_.join(imports, "file").where(F.col("name").contains(F.col("imported")) | F.col("imported").contains(F.col("name"))).groupBy("unit_id", "name", "kind").agg(F.min("i_id").alias("i_id"))
    j = j.join(found, ["unit_id", "name", "kind"], "left")
    table = STDLIB if stdlib is None else stdlib
    rows = [(lang, w) for lang, words in table.items() for w in words.split()]
    lib = refs.sparkSession.createDataFrame(rows, "lang string, library string")
    head = F.regexp_extract("name", r"^([^.:/]+)", 1)
    j = j.withColumn("head", head).join(F.broadcast(lib), (F.col("head") == F.col("library")) & (j["lang"] == lib["lang"]), "left")
    q = F.when(F.col("q_id") != F.col("unit_id"), F.col("q_id"))
    f = F.when(F.col("f_id") != F.col("unit_id"), F.col("f_id"))
    g = F.when(F.col("g_id") != F.col("unit_id"), F.col("g_id"))
    target = F.coalesce(q, f, g, "i_id")
    how = F.when(q.isNotNull() | f.isNotNull() | g.isNotNull(), "local").when(F.col("i_id").isNotNull(), "imported").when(F.col("library").isNotNull(), "external").otherwise("unresolved")
    return j.select("unit_id", "name", "kind", target.alias("target_id"), how.alias("resolution"), F.when(how == "external", F.col("library")).alias("library"))


def edges_of_refs(resolved: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): resolved references as edges, imports where an import resolved them; no self-edges."""
    kinds = F.create_map(*[F.lit(x) for pair in REF_EDGES.items() for x in pair])
    kind = F.when(F.col("resolution") == "imported", "imports").otherwise(kinds[F.col("kind")])
    return resolved.where("target_id is not null and target_id <> unit_id").select(F.col("unit_id").alias("source_id"), "target_id", kind.alias("edge_type")).where("edge_type is not null").distinct()


def containment_edges(units: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): each file's module contains its other units but imports."""
    m = units.where("unit_type = 'module'").groupBy("file_path").agg(F.min("id").alias("source_id"))
    return units.where("unit_type not in ('module', 'import')").join(m, "file_path").select("source_id", F.col("id").alias("target_id"), F.lit("contains").alias("edge_type"))


def ffi_edges(units: DataFrame, refs: DataFrame) -> DataFrame:
    """(source_id, target_id, via): a Python import of a module that Rust code exports (its name stands in pymodule of the signature or documentation)."""
    rust = units.where((F.col("language") == "Rust") & (_low("signature").contains("pymodule") | _low("doc_summary").contains("pymodule"))).select(F.col("id").alias("target_id"), "name")
    calls = refs.where("kind = 'import'").join(units.where("language = 'Python'").select(F.col("id").alias("unit_id")), "unit_id", "left_semi")
    return calls.join(rust, "name").select(F.col("unit_id").alias("source_id"), "target_id", F.lit("pyo3").alias("via"))


def foreign_calls(refs: DataFrame) -> DataFrame:
    """(unit_id, name, via): calls of ctypes, cffi or HTTP clients."""
    n = F.lower("name")
    via = F.when(n.contains("ctypes"), "ctypes").when(n.contains("cffi"), "cffi").when(F.greatest(*[n.contains(w) for w in ("fetch", "request", "http", "axios")]), "http")
    return refs.select("unit_id", "name", via.alias("via")).where("via is not null")


# -- design patterns


def design_patterns(units: DataFrame) -> DataFrame:
    """(pattern, id, confidence): Singleton, Factory, Repository and Decorator.

    A function belongs to a type if its lower-cased qualified name holds the type's lower-cased name.
    """
    name = _low("name")
    types = units.where("unit_type = 'type'").select("id", name.alias("type_name"))
    fn = units.where("unit_type = 'function'").select(name.alias("fn"), _low("qualified_name").alias("fq"), (F.col("visibility") == "private").alias("hidden"))
    shared = F.col("fn").contains("instance") | F.col("fn").contains("shared") | (F.col("fn") == "default")
    made = F.col("fn").isin("__init__", "new", "constructor") & F.col("hidden")
    inside = lambda t, f: match.contained(t.select("type_name"), f.select("fq")).join(t, F.col("word") == F.col("type_name")).join(f, F.col("text") == F.col("fq"))
    s = inside(types, fn.where(shared | made)).groupBy("id").agg(F.max(F.when(shared, 1).otherwise(0)).alias("a"), F.max(F.when(made, 1).otherwise(0)).alias("b"))
    singleton = s.select(F.lit("Singleton").alias("pattern"), "id", ((F.col("a") + F.col("b")) / 2.0).alias("confidence"))
    factory = units.where("unit_type in ('function', 'type')").where(name.contains("factory") | name.rlike("^(build_|create_|make_|new$)")).select(F.lit("Factory").alias("pattern"), "id", F.when(name.contains("factory"), 0.9).otherwise(0.5).alias("confidence"))
    stores = types.where(F.greatest(*[F.col("type_name").contains(w) for w in ("repository", "repo", "dao", "store")]))
    crud = fn.where(F.col("fn").rlike(f"^({CRUD})"))
    k = inside(stores, crud).groupBy("id").agg(F.count("*").alias("k"))
    repository = stores.join(k, "id", "left").select(F.lit("Repository").alias("pattern"), "id", F.when(F.col("k") >= 3, 0.9).when(F.col("k") >= 1, 0.6).otherwise(0.4).alias("confidence"))
    decorator = units.where(F.greatest(*[name.contains(w) for w in ("decorator", "wrapper", "middleware")])).select(F.lit("Decorator").alias("pattern"), "id", F.when(name.contains("decorator"), 0.8).otherwise(0.5).alias("confidence"))
    return singleton.unionByName(factory).unionByName(repository).unionByName(decorator)


# -- concepts


def _concept_rows(units: DataFrame, table: dict[str, str], both: bool, bonus: float, least: float, strict: bool) -> DataFrame:
    """(concept, id, score), of the concepts of which a unit has a word: those words are found first, in all of its texts at
    once, and only they are scored. One expression for all words, as code for each would be too long to be compiled."""
    if bonus >= least:
        raise S.QueryError("units without a word would count")
    words = F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(w).alias("word")) for c, ws in table.items() for w in ws.split()])
    u = units.select("id", "unit_type", _low("name").alias("n"), _low("qualified_name").alias("q"), _low("doc_summary").alias("d"))
    name, qname, doc = F.col("n"), F.col("q"), F.col("d")
    # the text is bound by a lambda of its own, or it would be put together again for each word
    found = F.transform(F.array(F.concat_ws("\n", name, qname, doc)), lambda text: F.filter(words, lambda x: text.contains(x["word"])))
    hit = u.select("id", "unit_type", "n", "q", "d", F.element_at(found, 1).alias("hits"))

    def points(w: Column) -> Column:
        named = F.when(name.contains(w), 0.4)
        if both:
            s = named.otherwise(0.0) + F.when(qname.contains(w), 0.2).otherwise(0.0)
        else:
            s = named.when(qname.contains(w), 0.2).otherwise(0.0)
        return s + F.when(doc.contains(w), 0.15).otherwise(0.0)

    def score(c: Column) -> Column:
        typical = F.col("unit_type").isin("function", "type")
        typical = typical if both else F.when(c == "Testing", F.col("unit_type").isin("test", "function")).otherwise(typical)
        s = F.aggregate("hits", F.lit(0.0), lambda a, x: a + F.when(x["concept"] == c, points(x["word"])).otherwise(0.0))
        return F.round(s + F.when(typical, bonus).otherwise(0.0), 9)

    concepts = F.array_distinct(F.transform("hits", lambda x: x["concept"]))
    rows = hit.select("id", F.inline(F.transform(concepts, lambda c: F.struct(c.alias("concept"), score(c).alias("score")))))
    return rows.where(F.col("score") > least if strict else F.col("score") >= least).select("concept", "id", F.least(F.lit(1.0), "score").alias("score"))


def extract_concepts(units: DataFrame) -> DataFrame:
    """(concept, id, score) above 0.3: 0.4 for each word in the name, else 0.2 in the qualified name, 0.15 in the documentation, 0.1 for a fitting type."""
    return _concept_rows(units, EXTRACTED, False, 0.1, 0.3, True)


def concept_confidence(rows: DataFrame) -> DataFrame:
    """(concept, units, confidence): the mean score."""
    return rows.groupBy("concept").agg(F.count("*").alias("units"), F.avg("score").alias("confidence"))


def navigate_concepts(units: DataFrame, query: str | None = None, module: str | None = None, unit_type: str | None = None) -> DataFrame:
    """(concept, id, score) of 0.3 or more, of the concepts that a query names (none: all): words count in name and qualified name."""
    table = KNOWN
    if query is not None:
        q = query.lower()
        table = {c: w for c, w in KNOWN.items() if q in c.lower() or c.lower() in q or any(x in q for x in w.split())}
    u = units.where(F.col("qualified_name").startswith(module)) if module else units
    u = u.where(F.col("unit_type") == unit_type) if unit_type else u
    if not table:
        return u.limit(0).select(F.lit("").alias("concept"), "id", F.lit(0.0).alias("score"))
    return _concept_rows(u, table, True, 0.05, 0.3, False)


def navigation_confidence(rows: DataFrame) -> DataFrame:
    """(concept, units, confidence): 0.6 of the best score and 0.1 for each unit, at most 0.4, together at most 1."""
    g = rows.groupBy("concept").agg(F.count("*").alias("units"), F.max("score").alias("top"))
    return g.select("concept", "units", F.least(F.lit(1.0), 0.6 * F.col("top") + F.least(F.lit(0.4), 0.1 * F.col("units"))).alias("confidence"))


# -- architecture


def roles(units: DataFrame) -> DataFrame:
    """(id, role): the first group of words that a unit's name, qualified name or path holds; tests; else utility."""
    where = F.concat_ws("\n", _low("name"), _low("qualified_name"), _low("file_path"))
    role = None
    for name, words in ROLES:
        hit = F.greatest(*[where.contains(w) for w in words.split()]) if words else F.col("unit_type") == "test"
        role = F.when(hit, name) if role is None else role.when(hit, name)
    return units.select("id", role.otherwise("utility").alias("role"))


def role_flows(graph: CodeGraph) -> DataFrame:
    """(from_role, to_role, calls) of calls between units of different roles."""
    r = roles(graph.units)
    e = graph.edges_of("calls").join(r.select(F.col("id").alias("source_id"), F.col("role").alias("from_role")), "source_id").join(r.select(F.col("id").alias("target_id"), F.col("role").alias("to_role")), "target_id")
    return e.where("from_role <> to_role").groupBy("from_role", "to_role").agg(F.count("*").alias("calls"))


def architecture(graph: CodeGraph) -> DataFrame:
    """(pattern, layers, classified, confidence): one row; layers are presentation, business and data, where they have units."""
    r = roles(graph.units)
    n = lambda *k: F.coalesce(F.sum(F.when(F.col("role").isin(*k), 1).otherwise(0)), F.lit(0))
    g = r.agg(
        F.count("*").alias("all"), n("controller").alias("c"), n("service").alias("s"), n("repository").alias("p"), n("model").alias("m"), n("configuration").alias("f"), n("entrypoint").alias("e"), n("utility").alias("u"),
    )
    has = lambda c: F.when(F.col(c) > 0, 1).otherwise(0)
    layers = has("c") + has("s") + has("p")
    kinds = has("c") + has("s") + has("p") + has("m") + has("f") + has("e")
    c, s, p, m = (F.col(x) > 0 for x in "cspm")
    pattern = F.when(c & m & ~p, "mvc").when(c & s & p, "layered").when(s & p & ~c, "hexagonal").when(kinds <= 2, "monolith").otherwise("unknown")
    known = F.when(F.col("all") > 0, (F.col("all") - F.col("u")) / F.greatest(F.lit(1), F.col("all"))).otherwise(0.0)
    return g.select(pattern.alias("pattern"), layers.alias("layers"), known.alias("classified"), F.when(F.col("all") > 0, 0.7 * known + F.least(F.lit(0.3), 0.1 * layers)).otherwise(0.0).alias("confidence"))


def architecture_anomalies(graph: CodeGraph) -> DataFrame:
    """(source_id, target_id): calls from a repository up to a controller."""
    r = roles(graph.units)
    low = r.where("role = 'repository'").select(F.col("id").alias("source_id"))
    high = r.where("role = 'controller'").select(F.col("id").alias("target_id"))
    return graph.edges_of("calls").join(low, "source_id", "left_semi").join(high, "target_id", "left_semi").select("source_id", "target_id")


# -- naming


def naming_patterns(units: DataFrame, least: int = 3) -> DataFrame:
    """(unit_type, pattern, n, confidence): first parts of names (p_*) of 3 letters or more and last parts (*_s) of 4 or more, of functions and types."""
    parts = F.split("name", "_")
    u = units.where("unit_type in ('function', 'type')").where(F.size(parts) > 1)
    first, last = parts[0], F.element_at(parts, -1)
    both = F.array_compact(F.array(F.when(F.octet_length(first) >= 3, F.concat(first, F.lit("_*"))), F.when(F.octet_length(last) >= 4, F.concat(F.lit("*_"), last))))
    g = u.select("unit_type", F.explode(both).alias("pattern")).groupBy("unit_type", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return g.withColumn("confidence", F.least(F.lit(0.95), 0.15 * F.col("n")))


def directory_patterns(units: DataFrame, least: int = 3) -> DataFrame:
    """(directory, unit_type, n, confidence): directories of ``least`` units or more, more than 0.7 of which are of one type."""
    d = units.select(F.regexp_replace("file_path", "/?[^/]*$", "").alias("directory"), "unit_type").groupBy("directory", "unit_type").agg(F.count("*").alias("k"))
    d = d.withColumn("n", F.sum("k").over(Window.partitionBy("directory"))).withColumn("share", F.col("k") / F.col("n"))
    return d.where((F.col("n") >= least) & (F.col("share") > 0.7)).select("directory", "unit_type", "n", F.least(F.lit(0.9), "share").alias("confidence"))


def check_names(units: DataFrame, prefix: str, directory: str) -> DataFrame:
    """(id, name) of functions in a directory whose name doesn't begin with the prefix that the others have."""
    return units.where((F.col("unit_type") == "function") & F.col("file_path").startswith(directory) & ~F.col("name").startswith(prefix)).select("id", "name")


def suggest_patterns(units: DataFrame, directory: str, limit: int = 5) -> DataFrame:
    """(pattern, n) of the naming patterns of a directory, the most frequent first."""
    p = naming_patterns(units.where(F.col("file_path").startswith(directory))).groupBy("pattern").agg(F.sum("n").alias("n"))
    return p.orderBy(F.col("n").desc(), "pattern").limit(limit)


def complexity_bucket(c: Column) -> Column:
    return F.when(c <= 5, "low").when(c <= 15, "medium").when(c <= 30, "high").otherwise("very_high")


def validate_kinds(units: DataFrame, kinds: Sequence[str] = S.UNIT_TYPES) -> DataFrame:
    """Units of a type that isn't known."""
    return units.where(~F.col("unit_type").isin(*kinds))
