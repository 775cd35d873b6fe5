"""Joins of claims with names, on tables made to crowd them."""

from __future__ import annotations

import random

from cairngraph.operators import match, text
from cairngraph.plans import analytics, projection


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _close(words, names, share):
    out = set()
    for w in words:
        for n in names:
            a, b = w.lower(), n.lower()
            d = 0 if a.startswith(b) or b.startswith(a) else _distance(a, b)
            if d == 0 or share and d <= len(w.encode()) // share:
                out.add((w, n, d))
    return out


def test_close_names(spark, monkeypatch):
    """Few words and many, with letters that repeat, that are equal modulo 64 and that take several bytes, against all pairs."""
    rng = random.Random(1)
    made = lambda n: ["".join(rng.choice("aAab_1éġ!") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    words, names = made(60), made(300)
    w, n = (spark.createDataFrame([(x,) for x in v], "s string") for v in (words, names))
    for few in (match.FEW, 0):
        monkeypatch.setattr(match, "FEW", few)
        for share in (2, 3, None):
            got = [tuple(r) for r in match.close(w, n, share).collect()]
            assert len(got) == len(set(got)) and set(got) == _close(words, names, share)
        held = [tuple(r) for r in match.contained(w, n).collect()]
        assert len(held) == len(set(held)) and set(held) == {(a, b) for a in words for b in names if a in b}


def test_crowded_citations(spark, monkeypatch):
    """Many claims about a name that many units bear: their product is dealt over tasks, and is whole."""
    monkeypatch.setattr(text, "CITED", 100)
    claims = spark.createDataFrame([(i, "It is `add_item` and ADD_ITEM, `one`.") for i in range(50)], "claim_id long, text string")
    units = spark.createDataFrame([(i, "add_item", f"a.{i}", "function") for i in range(40)] + [(99, "x", "b.one.x", "function")], "id long, name string, qualified_name string, unit_type string")
    df = text.citations(claims, units)
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted([(c, r, u, s) for c in range(50) for r, s in (("add_item", "direct"), ("ADD_ITEM", "partial")) for u in range(40)] + [(c, "one", 99, "strong") for c in range(50)])
    assert sum(n > 0 for n in df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) > 3
    ground = {(r["refs"], r["supported"]) for r in text.ground_claims(claims, units).collect()}
    assert ground == {(3, 3)}


def test_claims_make_no_edges(spark, sf, tmp_path):
    g = projection.Projected(spark, sf, f"file:{tmp_path}/g")
    analytics._cut_names(g).units.count()
    assert g._done == {"units"}


def test_more_out_edges_than_the_limit(spark, monkeypatch):
    """The limit on out-edges is the builder's; a query of bad edges may ask for none."""
    from cairngraph.functions import schema as S
    from cairngraph.graph import CodeGraph

    n = S.MAX_OUT_EDGES + 5
    units = spark.range(n + 1).selectExpr("id", "'x' AS name")
    edges = spark.range(1, n + 1).selectExpr("0L AS source_id", "id AS target_id", "'calls' AS edge_type", "1D AS weight", "0L AS created_at", "0 AS context", "1L AS edge_ord")
    g = CodeGraph(units, edges)
    assert g.rejected_edges().count() == 5 and g.rejected_edges(None).count() == 0
    assert g.build(strict=False, max_out=None).edges.count() == n


def test_many_plain_ignore_rules(spark):
    """Rules without wildcards are looked up; with them, anchored, of folders and taken back, they leave out what each pattern says."""
    from cairngraph.sources import scan

    lines = ["*.rs", "/top", "a/b.txt", "name.x", "dir/", "!keep.rs", "sp ace-1.y", "[ab].z", "!/in/a.z", "q+.w", "**/m/n"]
    paths = ["/r/a.rs", "/r/keep.rs", "/r/in/keep.rs", "/r/top", "/r/in/top", "/r/top/x", "/r/a/b.txt", "/r/c/a/b.txt", "/r/in/name.x", "/r/name.xx", "/r/dir", "/r/dir/f", "/r/u/dir/f", "/r/sp ace-1.y", "/r/in/a.z", "/r/b.z", "/s/a.rs", "/r/q+.w", "/r/qq.w", "/r/k/m/n", "/r/m/n/o"]
    rules = scan.ignore_rules(spark.createDataFrame([("/r/.gitignore", bytearray("\n".join(lines).encode()))], "path string, content binary"))
    plain = rules.where(f"regexp_extract(rule, r'{scan.PLAIN}', 2) <> ''").count()
    got = {r["path"] for r in scan.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert plain == 9  # **/m/n among them, which a name alone does not settle
    assert got == {"/r/a.rs", "/r/top", "/r/top/x", "/r/a/b.txt", "/r/in/name.x", "/r/dir/f", "/r/u/dir/f", "/r/sp ace-1.y", "/r/b.z", "/r/q+.w", "/r/k/m/n", "/r/m/n/o"}
