"""History, claims, inference, workspaces, tools, shaping, sources and streams on small inputs."""

from __future__ import annotations

import pytest
from fixtures import cycle, ids, rich, rows
from pyspark.sql import functions as F

from cairngraph.functions import schema as S
from cairngraph.operators import history, infer, insights, shaping, text, workspace
from cairngraph.sources import parsers, scan
from cairngraph.streaming import changes as stream


def change(path, kind, commit, ts, author="ann", fix=False, added=0, deleted=0):
    return (path, kind, commit, ts, author, fix, added, deleted, None)


@pytest.fixture(scope="module")
def g(spark):
    return rich(spark)


# -- history


def test_co_change(spark):
    log = [change(p, "modify", f"c{i}", 1000 + 100 * i, added=a, deleted=d) for i in range(5) for p, a, d in (("src/a.rs", 5, 2), ("src/b.rs", 3, 1))]
    c = spark.createDataFrame([*log, change("src/c.rs", "modify", "c_solo", 5000)], S.CHANGES)
    assert rows(history.coupling(c)) == [("src/a.rs", "src/b.rs", 5, 1.0, "co_change")]
    assert rows(history.co_changes(c, max_paths=1)) == []
    assert history.totals(c).first()["commits"] == 6


def test_buggy_file(spark):
    now = 100_000
    log = [change("src/problematic.rs", "modify", f"c{i}", now - 500 + 30 * i, fix=True, added=10, deleted=8) for i in range(15)]
    c = spark.createDataFrame([*log, change("src/stable.rs", "add", "c99", 1000)], S.CHANGES)
    assert history.prophecy(c, now).first()["path"] == "src/problematic.rs"
    assert history.prophecy_factors(c, now).count() == 2
    assert history.stability_of(c, "src/none.rs", now).first()["factor"] == "no_history"
    s = {r["path"]: r["score"] for r in history.stability(c, now).collect()}
    assert s["src/problematic.rs"] < s["src/stable.rs"] <= 1
    assert {r["path"]: r["phase"] for r in history.phases(c, now).collect()} == {"src/problematic.rs": "active", "src/stable.rs": "active"}


def test_messages(spark):
    df = spark.createDataFrame([("Fix crash",), ("refactor names",), ("optimise loop",), ("add feature",), ("misc",)], "m string")
    assert [r[0] for r in df.select(history.classify_message(F.col("m"))).collect()] == ["bugfix", "refactor", "performance", "feature", "unknown"]


def test_empty_history(spark):
    c = spark.createDataFrame([], S.CHANGES)
    for df in (history.coupling(c), history.stability(c, 0), history.prophecy(c, 0), history.alerts(c, 0), history.phases(c, 0)):
        assert df.count() == 0


# -- claims


def claims(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")


def test_references(spark):
    c = claims(spark, "`process_payment` calls validate_input in PaymentConfig with MAX_SIZE", "`the` plain words only", "", None, "A Word and `a b` twice `a b`")
    got = {}
    for r in text.extract_references(c).orderBy("claim_id", "pos").collect():
        got.setdefault(r["claim_id"], []).append(r["ref"])
    assert got == {0: ["process_payment", "validate_input", "PaymentConfig", "MAX_SIZE"], 4: ["a b", "a b"]}


def test_grounding(spark, g):
    c = claims(spark, "process_payment calls validate_input", "ghost_function does it", "process_payment and ghost_function", "nothing here", "`PROCESS_PAYMENT`", None)
    got = {r["claim_id"]: (r["status"], round(r["confidence"], 3)) for r in text.ground_claims(c, g.units).collect()}
    assert got == {0: ("verified", 1.0), 1: ("ungrounded", 0.0), 2: ("partial", 0.5), 3: ("ungrounded", 0.0), 4: ("verified", 1.0), 5: ("ungrounded", 0.0)}
    assert text.ground_claims(c, g.units, strict=True).where("claim_id = 2").first()["status"] == "ungrounded"
    strength = {(r["ref"], r["strength"]) for r in text.citations(c, g.units).collect()}
    assert ("process_payment", "direct") in strength and ("PROCESS_PAYMENT", "partial") in strength
    states = text.check_truths(c, g.units)
    assert {r["claim_id"]: r["state"] for r in states.collect()}[2] == "stale"
    assert text.truth_diff(states, states).count() == 0


def test_suggestions(spark, g):
    refs = spark.createDataFrame([("process_paymnt",), ("valid",)], "ref string")
    got = rows(text.suggest_similar(refs, g.units), "ref", "name", "distance", "rank")
    assert ("process_paymnt", "process_payment", 1, 1) in got and ("valid", "validate_input", 0, 2) in got


def test_contradictions(spark, g):
    c = claims(spark, "process_paymnt and zzz_qqq_ppp")
    assert rows(text.contradictions(c, g.units)) == [(0, "process_paymnt", "contradicted"), (0, "zzz_qqq_ppp", "not_found")]


def test_hallucinations(spark, g):
    c = claims(spark, "process_payment is fine\nghost_thing runs. all good here", "process_payment is in file src/other/place")
    got = rows(text.hallucinations(c, g.units), "claim_id", "sentence_no", "ref", "kind")
    assert got == [(0, 1, "ghost_thing", "non_existent")]
    rep = {r["claim_id"]: (r["sentences"], r["found"], r["safe"]) for r in text.hallucination_report(c, g.units).collect()}
    assert rep == {0: (3, 1, False), 1: (1, 0, True)}
    assert text.suggest_fixes(claims(spark, "process_payment_now is it, truly"), g.units).first()["name"] == "process_payment"


def test_search(g):
    assert ids(text.keyword_search(g, "payment function"))[0] == 1
    assert text.intent_of("where is login") == "usage" and text.intent_of("") == "general"
    assert text.keywords("find the payment_config of x") == ["payment_config"]
    assert text.unknown_query("hotspot", ["hotspots", "impact"]) == "hotspots"


# -- inference


def test_resolution(spark, g):
    refs = spark.createDataFrame([(10, "app::process_payment", "call"), (10, "logout", "call"), (10, "os.path", "import"), (10, "validate_input", "call"), (10, "nope", "call")], "unit_id long, name string, kind string")
    got = {r["name"]: (r["target_id"], r["resolution"]) for r in infer.resolve(g.units, refs).collect()}
    assert got == {"app::process_payment": (1, "local"), "logout": (11, "local"), "os.path": (None, "external"), "validate_input": (2, "local"), "nope": (None, "unresolved")}
    assert infer.edges_of_refs(infer.resolve(g.units, refs)).count() == 3
    assert rows(infer.containment_edges(g.units.where("file_path = 'src/auth.py'")), "source_id", "target_id") == [(9, 10), (9, 11)]


def test_concepts(g):
    got = {(r["concept"], r["id"]) for r in infer.extract_concepts(g.units).collect()}
    assert ("Payment", 1) in got and ("Authentication", 10) in got
    nav = infer.navigate_concepts(g.units, "payment")
    assert {r["concept"] for r in nav.collect()} == {"Payment"}
    assert 0 < infer.navigation_confidence(nav).first()["confidence"] <= 1
    assert infer.navigate_concepts(g.units, "zzzz").count() == 0


def test_architecture(g):
    roles = {r["id"]: r["role"] for r in infer.roles(g.units).collect()}
    assert roles[4] == "configuration" and roles[13] == "test"
    assert infer.architecture(g).first()["pattern"] == "monolith"
    assert infer.architecture_anomalies(g).count() == 0


def test_naming(spark, g):
    units = g.units.limit(1).crossJoin(spark.createDataFrame([("get_user",), ("get_item",), ("get_order",), ("x",)], "n string")).withColumn("name", F.col("n")).withColumn("unit_type", F.lit("function"))
    assert rows(infer.naming_patterns(units), "pattern", "n") == [("get_*", 3)]
    assert infer.directory_patterns(units).first()["unit_type"] == "function"


def test_patterns(spark):
    base = {"file_path": "a.py", "unit_type": "function", "language": "Python"}
    units = [
        {"id": 1, "name": "UserRepository", "qualified_name": "m.UserRepository"} | base | {"unit_type": "type"}, *[{"id": 2 + i, "name": f"{v}_user", "qualified_name": f"m.UserRepository.{v}_user"} | base for i, v in enumerate(("get", "find", "create"))],
        {"id": 9, "name": "Config", "qualified_name": "m.Config"} | base | {"unit_type": "type"}, {"id": 10, "name": "get_instance", "qualified_name": "m.Config.get_instance"} | base, {"id": 11, "name": "log_decorator", "qualified_name": "m.log_decorator"} | base,
    ]
    from cairngraph.graph import CodeGraph

    got = rows(infer.design_patterns(CodeGraph.of_rows(spark, units, []).units))
    assert got == [("Decorator", 11, 0.8), ("Factory", 4, 0.5), ("Repository", 1, 0.9), ("Singleton", 9, 0.5)]


# -- workspaces


def test_workspace(spark, g):
    w = workspace.Workspace().add("a", g).add("b", cycle(spark), "target")
    u = w.units()
    assert rows(workspace.query_all(u, "payment"), "context", "id") == [("a", 1), ("a", 4), ("a", 5)]
    x = {r["name"]: (r["found_in"], r["missing_from"]) for r in workspace.cross_reference(u, w.contexts()).collect()}
    assert x["f0"] == (["b"], ["a"])
    r = workspace.compare_graphs(g.units, g.units).first()
    assert (r["common"], r["only_a"], r["similarity"]) == (14, 0, 1.0)
    assert workspace.compare_graphs(g.units, w.graphs["b"].units).first()["similarity"] == 0.0
    assert workspace.structural_diff(g.units, g.units).count() == 0
    plan = workspace.migration_plan(g, w.graphs["b"].units)
    assert [r["phase"] for r in plan.orderBy("step").collect()][:4] == ["types"] * 4
    assert {r["concept"] for r in workspace.conceptual_diff(g.units, w.graphs["b"].units).collect()} >= {"payment", "config", "auth"} - {"auth"}
    with pytest.raises(S.QueryError):
        workspace.Workspace().units()


def test_translation(spark):
    log = spark.createDataFrame([("a", None, "not_started", None, 1), ("a", "A", "ported", None, 2), ("b", None, "in_progress", None, 3), ("c", "C", "verified", None, 4)], "source_symbol string, target_symbol string, status string, notes string, version long")
    p = workspace.translation_progress(log).first()
    assert (p["total"], p["ported"], round(p["percent"], 3)) == (3, 1, 66.667)
    assert [r["source_symbol"] for r in workspace.translation_remaining(log).collect()] == ["b"]
    assert workspace.translation_completed(log).count() == 2


# -- tools


def test_insights(g, spark):
    k = {r["id"]: (r["karma"], r["level"]) for r in insights.soul_karma(g).collect()}
    assert k[1] == (20, "good") and k[12] == (-20, "troubled")
    d = {(r["id"], r["disease"]) for r in insights.genetics_diseases(g).collect()}
    assert (12, "untested") in d and (11, "orphan_code") in d
    m = {(r["id"], r["mutation"]) for r in insights.genetics_mutations(g).collect()}
    assert (12, "stability_mutation") in m and not any(x == "naming_mutation" for _, x in m if _ == 4)
    assert insights.soul_compare(g, spark.createDataFrame([(2, 3)], "a long, b long")).first()["verdict"] == "related_souls"
    assert rows(insights.genetics_lineage(g, 2), "id", "depth") == [(0, 1)]
    assert insights.resurrect_verify(g, "payment").first()["confidence"] == "high"
    u = g.units.withColumn("graph", F.lit("one"))
    assert insights.telepathy_consensus(u, "payment").first()["level"] == "universal"
    assert insights.omniscience_practices(g).where("id = 1").first()["grade"] in "ABC"


# -- shaping


def test_shaping(spark, g):
    rows_, total, more = shaping.page(g.units, ["id"], 10, 3)
    assert ids(rows_) == [10, 11, 12] and total == 14 and more
    assert ids(shaping.page_after(g.units, "id", 11, 5)) == [12, 13]
    assert shaping.extract(g.units, "exists").first()["found"] and shaping.extract(g.units, "ids").columns == ["id"]
    b = shaping.TokenBudget(10)
    assert b.try_spend(7) and not b.try_spend(4) and b.remaining == 3
    log = spark.createDataFrame([("a", 1, "modify", 1.0), ("a", 2, "delete", None), ("b", 3, "modify", 2.0)], "key string, version long, change_type string, value double")
    assert rows(shaping.state_at(log)) == [("b", 2.0)] and shaping.state_at(log, 1).count() == 1
    assert shaping.changes_since(log, 2).count() == 1
    items = spark.createDataFrame([("raw_text", "my PASSWORD"), ("raw_text", "fine"), ("pattern", "x"), ("source", "y")], "kind string, text string")
    assert shaping.shareable(items).count() == 2


# -- sources

PY = '''"""Animals."""
import os
from a.b import c


class Dog(Animal):
    """A dog."""

    def bark(self, n):
        if n and self.loud:
            return helper(n)
        return os.path.join("a")

    def __secret(self):
        yield 1


async def fetch(url: str) -> str:
    return url


def test_bark():
    Dog().bark(1)
'''
RS = '''/// A point.
pub struct Point { x: i32 }

pub trait Shape { fn area(&self) -> f64; }

impl Shape for Point {
    fn area(&self) -> f64 {
        if self.x > 0 && true { 1.0 } else { 0.0 }
    }
}

mod inner {
    pub(crate) fn assist() {}
}

#[test]
fn test_area() { }
'''
SOURCES = {
    "go": ("package a\n\nimport \"fmt\"\n\ntype Cat struct {\n\tName string\n}\n\nfunc (c *Cat) Speak() string {\n\treturn \"x\"\n}\n\nfunc TestCat() {}\n", {("type", "Cat"), ("function", "Speak"), ("test", "TestCat"), ("import", "fmt")}),
    "ts": ("import { x } from './y';\nexport class Foo extends Bar {\n  async run(a: number): Promise<void> {\n    if (a) { }\n  }\n}\nexport const add = (a: number) => a;\nfunction plain() {}\ninterface Shape {}\n", {("type", "Foo"), ("function", "run"), ("function", "add"), ("function", "plain"), ("type", "Shape"), ("import", "./y")}),
    "java": ("package a.b;\nimport java.util.List;\npublic class Foo extends Bar {\n    private int add(int a) {\n        return a;\n    }\n    @Test\n    public void checks() {\n    }\n}\n", {("module", "a.b"), ("import", "java.util.List"), ("type", "Foo"), ("function", "add"), ("test", "checks")}),
    "cs": ("using System;\nnamespace A.B {\n  public class Foo : Bar {\n    [Fact]\n    public void Checks() {\n    }\n    internal int Add(int a) {\n      return a;\n    }\n  }\n}\n", {("import", "System"), ("module", "A.B"), ("type", "Foo"), ("test", "Checks"), ("function", "Add")}),
    "cpp": ("#include <vector>\n#define MAX 3\nnamespace n {\nclass Foo : public Bar {\n};\nint Foo::add(int a) {\n  return a;\n}\nint test_add() {\n  return 1;\n}\n}\n", {("import", "vector"), ("macro", "MAX"), ("module", "n"), ("type", "Foo"), ("function", "add"), ("test", "test_add")}),
}


def test_python_parser():
    u = {x["qualified_name"]: x for x in parsers.parse_text("src/m.py", PY, "Python")}
    bark = u["m.Dog.bark"]
    assert (bark["unit_type"], bark["complexity"], bark["start_line"], bark["end_line"]) == ("function", 3, 9, 12)
    assert [r["name"] for r in bark["references"]] == ["helper", "os.path.join"]
    assert u["m.Dog"]["references"] == [{"name": "Animal", "kind": "inherit", "line": 6}] and u["m.Dog"]["doc_summary"] == "A dog."
    assert u["m.Dog.__secret"]["visibility"] == "private" and u["m.Dog.__secret"]["is_generator"]
    assert u["m.fetch"]["is_async"] and u["m.fetch"]["signature"] == "async def fetch(url: str) -> str"
    assert u["m.test_bark"]["unit_type"] == "test" and u["m"]["doc_summary"] == "Animals."
    assert parsers.parse_text("x.py", "def (", "Python")[0]["error"]


def test_rust_parser():
    got = {(x["unit_type"], x["name"]): x for x in parsers.parse_text("src/p.rs", RS, "Rust")}
    assert got["type", "Point"]["visibility"] == "public" and got["type", "Point"]["doc_summary"] == "A point."
    assert got["impl", "Point"]["references"] == [{"name": "Shape", "kind": "implement", "line": 6}]
    assert got["function", "assist"]["visibility"] == "internal" and got["function", "assist"]["qualified_name"] == "p::inner::assist"
    assert ("test", "test_area") in got and ("trait", "Shape") in got


@pytest.mark.parametrize("ext", sorted(SOURCES))
def test_scanners(ext):
    source, wanted = SOURCES[ext]
    got = {(x["unit_type"], x["name"]) for x in parsers.parse_text(f"src/f.{ext}", source, S.EXTENSIONS[ext])}
    assert wanted <= got


def test_compile(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text(PY)
    (tmp_path / "src/util.py").write_text("def helper(n):\n    return n\n")
    (tmp_path / "src/p.rs").write_text(RS)
    (tmp_path / "src/data.bin").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("function a() {}")
    files = scan.scan(spark, f"file://{tmp_path}")
    c = scan.coverage(files).first()
    assert (c["files"], c["parsed"], c["excluded"], c["unsupported"]) == (5, 3, 1, 1)
    assert rows(scan.unsupported_extensions(files)) == [("bin", 1)]
    g = parsers.compile_graph(files).build()
    name = {r["id"]: r["qualified_name"] for r in g.units.collect()}
    edges = {(name[r["source_id"]], name[r["target_id"]], r["edge_type"]) for r in g.edges.collect()}
    assert ("m.Dog.bark", "util.helper", "calls") in edges and ("m", "m.Dog", "contains") in edges
    assert sorted(name) == list(range(len(name)))
    old = scan.snapshot(files)
    old.write.parquet(str(tmp_path / "snap.parquet"))
    (tmp_path / "src/util.py").write_text("def helper(n):\n    return n + 1\n")
    (tmp_path / "src/p.rs").unlink()
    (tmp_path / "src/new.py").write_text("x = 1\n")
    new = scan.snapshot(scan.scan(spark, f"file://{tmp_path}/src"))
    got = {p.rsplit("/", 1)[1]: k for p, k in rows(scan.detect_changes(spark.read.parquet(str(tmp_path / "snap.parquet")), new))}
    assert got == {"util.py": "modified", "p.rs": "removed", "new.py": "added"}


# -- streams


def test_streams(spark, tmp_path):
    ev = [(k, 1_700_000_000 + 600 * i, a, i % 3 == 0, i) for i, (k, a) in enumerate([("a", "x"), ("b", "y")] * 10)]
    events = spark.createDataFrame(ev, "key string, t long, author string, is_fix boolean, size long").select("key", F.timestamp_seconds("t").alias("ts"), "author", "is_fix", "size")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.to_table(stream.running(stream.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    q.awaitTermination(120)
    got = {r["key"]: (r["n"], r["fixes"], r["churn"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["key"]: (r["n"], r["f"], r["c"]) for r in events.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("is_fix").cast("int")).alias("f"), F.sum("size").alias("c")).collect()}
    assert got == want
    q = stream.to_table(stream.activity(stream.read(spark, str(tmp_path / "in")), late="0 seconds"), str(tmp_path / "w"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    done, every = rows(spark.read.parquet(str(tmp_path / "w"))), rows(stream.activity(events))
    assert done and set(done) <= set(every)
    assert stream.sessions(events, "15 minutes").count() == 20 and stream.sessions(events, "30 minutes").count() == 2


# -- ignore rules, explanations, sessions, close names


def test_ignore_rules(spark, tmp_path):
    import subprocess

    rules = {"": ["*.log", "/build", "docs/", "!keep.log", "a/**/b", "src/*.py", "x[0-9].c", "deep/**", "# no", "!deep/in.txt", "sp\\ ace.txt", "**/gen"], "sub": ["!*.log", "*.md", "/only.c"]}
    names = ["a.log", "keep.log", "sub/b.log", "sub/keep.log", "build", "sub/build/x.py", "docs/r.py", "sub/docs", "a/b", "a/x/y/b", "src/m.py", "src/in/m.py", "x1.c", "xa.c", "deep/in.txt", "deep/er/f.c", "sub/n.md", "n.md", "sub/only.c", "only.c", "sub/in/only.c", "sp ace.txt", "q/gen/z.c", "build2/a.c"]
    for folder, lines in rules.items():
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / ".gitignore").write_text("\n".join(lines) + "\n")
    for n in names:
        if n != "build" and not (tmp_path / n).exists():
            (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / n).write_text("x")
    files = scan.scan(spark, f"file://{tmp_path}")
    got = {r["path"].removeprefix(f"{tmp_path}/") for r in files.where("skipped = 'ignored'").collect()} - {".gitignore", "sub/.gitignore"}
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    said = subprocess.run(["git", "status", "--porcelain", "--ignored", "-uall"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    want = {line[3:].strip('"') for line in said.splitlines() if line.startswith("!!")}
    assert got == want and "sub/b.log" not in got and "deep/in.txt" not in got


def test_explanations(spark):
    log = [change("a", "modify", f"c{i}", 1000 + i, fix=True, added=200) for i in range(4)] + [change("b", "add", "c9", 0, author=f"p{i}") for i in range(5)]
    c = spark.createDataFrame(log, S.CHANGES)
    got = {r["path"]: r["explanation"] for r in history.explain_why(c, 500 * 86400).collect()}
    assert got["a"].startswith("Mature: first changed 499 days ago. More than half of its changes are fixes. Owned by one author. Reworked: 800 lines changed.")
    assert "Shared by 5 authors." in got["b"]
    assert history.pattern_prophecy(spark, "Factory").first()["probability"] == 0.5


def test_sessions(spark):
    log = spark.createDataFrame([("s", 1, "look", "a"), ("s", 2, "find", "b"), ("t", 3, "look", "c"), ("t", 4, "session_end", None)], "session_id string, timestamp long, tool string, summary string")
    assert rows(shaping.sessions(log)) == [("s", 1, 2, 2, False), ("t", 3, 4, 1, True)]
    assert [r["summary"] for r in shaping.resume(log).collect()] == ["c"] and [r["summary"] for r in shaping.resume(log, "s", 1).collect()] == ["b"]
    assert shaping.resume(log.limit(0)).count() == 0
    delta = spark.createDataFrame([(1, 1, "modify", 2.5), (2, 2, "delete", None)], "key long, version long, change_type string, value double")
    text = shaping.serialise(delta)
    assert rows(shaping.deserialise(text, delta.schema).na.fill(0)) == rows(delta.na.fill(0))
    assert shaping.deserialise(text.withColumn("json", F.lit("{}")), delta.schema).count() == 0


def test_joins_by_index(spark):
    """Containment and closeness against all pairs."""
    import random

    from cairngraph.operators import match

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abAB_") for _ in range(n))
    words, texts = [word(rng.randrange(0, 7)) for _ in range(60)] + [None], [word(rng.randrange(0, 14)) for _ in range(60)] + [None]
    w, t = spark.createDataFrame([(x,) for x in words], "w string"), spark.createDataFrame([(x,) for x in texts], "t string")
    got = {tuple(r) for r in match.contained(w, t).collect()}
    assert got == {(x, y) for x in words if x for y in texts if y and x in y}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for share in (2, 3):
        want = set()
        for x in {x for x in words if x is not None}:
            for y in {y for y in texts if y is not None}:
                a, b = x.lower(), y.lower()
                if a.startswith(b) or b.startswith(a):
                    want.add((x, y, 0))
                elif (d := distance(a, b)) <= len(x) // share:
                    want.add((x, y, d))
        assert {tuple(r) for r in match.close(w, t, share).collect()} == want
