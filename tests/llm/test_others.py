"""Language ID, chat, HTML, URLs, WARC, decontamination."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import words_of

from cairngraph.llm import chat, decontaminate, html, langid, urls, warc

# -- language ID


def test_language_accuracy(spark, sf):
    d = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    out = langid.identify_documents(d).toPandas()
    assert (out.declared == out.lang)[out.accepted].mean() > 0.95  # declared is the label, which is no evidence
    held = d.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    unseen = langid.identify_documents(held).where("declared is null").toPandas().set_index("doc_id").lang
    truth = d.toPandas().set_index("doc_id").lang
    assert len(unseen) > 400 and (unseen == truth[unseen.index]).mean() > 0.98
    assert out.accepted.mean() > 0.9
    assert ((out.posterior >= 0) & (out.posterior <= 1)).all()


@pytest.mark.parametrize("extra", [False, True])
def test_language_cases(spark, docs, extra):
    en, de = "the house and the garden are with the water ", "der hund und die katze nicht haben wir "
    rows = [(i, (en if i % 2 else de) * 5) for i in range(40)]
    d = docs([*rows, (100, None), (101, ""), (102, "12 34 !!"), (None, en * 3), (1, en * 5), (103, en * 20000)], extra)
    d = d.withColumn("lang", F.when(F.col("text").contains("hund"), "de").otherwise("en"))
    got = {r["doc_id"]: (r["lang"], r["accepted"]) for r in langid.identify_documents(d).collect()}
    assert got[100] == got[101] == got[102] == ("und", False)
    assert got[1] == ("en", True) and got[2] == ("de", True) and got[103] == ("en", True) and got[None] == ("en", True)
    kept = langid.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == 43
    assert langid.identify_documents(d.limit(0)).count() == 0
    none = d.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(none).count() == 0


def test_junk_is_rejected(spark, docs, sf):
    """What is no text of a language goes, whatever its label says; the rest stays."""
    rng = np.random.default_rng(4)
    junk = ["".join(chr(97 + c) for c in rng.integers(0, 26, 400)), " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(60)), "zqxjkv " * 50, "%% $$ 12 && 99 ## " * 40, "\u2603\u2602 " * 30]
    d = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    planted = spark.createDataFrame([(10**6 + i, t, "en", "src0", len(t)) for i, t in enumerate(junk)], d.schema)
    kept = {r["doc_id"] for r in langid.keep_identified(d.unionByName(planted)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in d.select("doc_id").collect()}


def test_page_cases(spark, docs):
    en = "the house and the garden are with the water "
    d = docs([(i, en * 5) for i in range(20)])
    page = f"<html lang=en><p>{en * 9}</p></html>"
    rows = [(1, "http://a.com/", page), (1, "http://a.com/", page), (2, None, page), (3, "no address", page), (4, "http://a.com/", None), (5, "http://a.com/", ""), (6, "http://a.com/", "<p>12</p>"), (None, "http://a.com/", page), (7, "http://a.com/", f"<script>{en}</script>"), (8, "http://b.org/", "<script>" * 20000 + page), (9, "http://b.org/", "<p>" + en * 20000)]
    p = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, declared string, `__cairn_lang` string")
    got = [(r["page_id"], r["lang"], r["accepted"]) for r in langid.identify_pages(p, d).collect()]
    no = ("und", False)
    assert {i: (x, a) for i, x, a in got} == {1: ("en", True), 2: ("en", True), 3: ("en", True), 4: no, 5: no, 6: no, None: ("en", True), 7: no, 8: no, 9: ("en", True)} and len(got) == len(rows)
    assert langid.identify_pages(p.limit(0), d).count() == 0 and langid.identify_pages(p, d.limit(0)).where("accepted").count() == 0


def test_evidence_is_fused(spark):
    """A text that fits two languages alike is decided by its host, and by what it declares."""
    rows = [(i, "anna otto bob " * 3 + ("the with and " if i % 2 else "der mit und ") * 9, "en" if i % 2 else "de", "a.com" if i % 2 else "b.de") for i in range(200)]
    rows += [(1000, "anna otto bob", None, "a.com"), (1001, "anna otto bob", None, "b.de"), (1002, "anna otto bob", "de", None), (1003, "anna otto bob", "en", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train(d.where("doc_id < 1000"), "doc_id", F.col("text"), F.col("lang"))
    done, (lang, _, _) = langid.identify(d, langid.Evidence(F.col("text"), F.col("lang"), F.col("source"), F.regexp_extract("source", r"\.(\w+)$", 1)), model)
    got = {r["doc_id"]: r[lang] for r in done.collect()}
    assert (got[1000], got[1001], got[1002], got[1003]) == ("en", "de", "de", "en")


def test_pages(spark, sf):
    p, d = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify_pages(p, d).toPandas()
    assert len(out) == p.count() and set(out.lang) <= {"en", "de", "fr", "es", "und"}


# -- chat


def link(spark, calls, results, schemas=None):
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    return {x["conv_id"]: x for x in chat.link(c, r, schemas).collect()}


def test_linking(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}
    calls = [
        (1, "z", 0, "add", '{"b":1.5,"a":2}', []), (1, "y", 1, "add", '{"a":"no"}', ["z"]), (1, "x", 0, "add", '{"a":1}', ["y"]), (1, "w", 2, "none", "{}", None), (1, "v", 3, "add", "{bad", None), (1, "z", 5, "add", "{}", []),
        (2, "p", 0, "add", '{"a":1}', ["q"]), (2, "q", 1, "add", '{"a":1}', ["p"]), (None, "n", 0, "add", "{}", []), (3, None, 0, "add", "{}", []),
    ]
    got = link(spark, calls, [(1, "z", 4, "two"), (1, "z", 6, "later"), (1, "lost", 1, "x"), (2, "p", 9, None)], schema)
    assert set(got) == {1, 2}
    one = json.loads(got[1]["json"])
    assert [c["id"] for c in one["calls"]] == ["z", "y", "x", "w", "v"] and one["orphans"] == ["lost"]
    assert one["calls"][0]["arguments"] == {"a": 2, "b": 1.5} and one["calls"][0]["result"] == "two" and '"arguments":{"a":2,"b":1.5}' in got[1]["json"]
    assert [bool(c["errors"]) for c in one["calls"]] == [False, True, False, True, True]
    assert (got[1]["n_calls"], got[1]["n_unanswered"], got[1]["n_orphans"], got[1]["n_invalid"]) == (5, 4, 1, 3)
    assert got[2]["n_cyclic"] == 2


def test_schema_checks():
    s = {"type": "object", "properties": {"k": {"enum": [1, 2]}, "l": {"type": "array", "items": {"type": "number", "minimum": 0}, "maxItems": 2}, "s": {"type": ["string", "null"], "maxLength": 2}}, "additionalProperties": False, "required": ["k"]}
    assert chat.violations({"k": 1, "l": [0, 1.5], "s": None}, s) == []
    assert len(chat.violations({"l": [-1, True, 3], "s": "long", "q": 1}, s)) == 6
    assert chat.violations(1.0, {"type": "integer"}) == [] and chat.violations(True, {"type": "integer"})


def test_conversations(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    users = c.where("role = 'user'").groupBy("conv_id").count().toPandas().set_index("conv_id")["count"].to_dict()
    got = {r["conv_id"]: r["n_calls"] for r in chat.format_conversations(c).collect()}
    assert {k: v for k, v in got.items() if v} == users


def test_conversation_cases(spark):
    call = json.dumps({"tool_calls": [{"id": "k", "name": "reply", "arguments": '{"prompt":"x","turn":1}'}]})
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, None, "x"), (4, 0, "assistant", call), (4, 1, "tool", '{"tool_call_id":"k","content":"done"}'), (5, 0, "user", "w" * 100000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, call_id string, content int")
    got = {r["conv_id"]: r for r in chat.format_conversations(d).collect()}
    assert set(got) == {1, 4, 5}
    assert json.loads(got[1]["json"])["calls"][0]["result"] == "a" and got[1]["n_invalid"] == 1
    assert [c["result"] for c in json.loads(got[4]["json"])["calls"]] == ["done"]
    assert chat.format_conversations(d.limit(0)).count() == 0


def test_turns_that_dont_alternate(spark):
    """Calls follow the user turn before them and answers the turn they follow, whatever stands between."""
    rows = [(1, 0, "user", "a"), (1, 1, "system", "s"), (1, 2, "assistant", "A"), (1, 3, "assistant", "A2"), (1, 4, "user", "b"), (1, 5, "user", "c"), (1, 6, "system", "s"), (1, 7, "assistant", "C"), (2, 5, "assistant", "first"), (3, 0, "system", "only")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = chat.calls_of_turns(d)
    assert {(r["call_id"], tuple(r["after"])) for r in calls.collect()} == {("c1-0", ()), ("c1-4", ("c1-0",)), ("c1-5", ("c1-4",))}
    got = {r["conv_id"]: json.loads(r["json"]) for r in chat.link(calls, results).collect()}
    assert [(c["id"], c["result"]) for c in got[1]["calls"]] == [("c1-0", "A"), ("c1-4", None), ("c1-5", "C")]
    assert got[1]["orphans"] == ["c1-2"] and got[2]["orphans"] == ["c2-4"] and set(got) == {1, 2}


def test_ties_of_calls(spark):
    """Calls of one turn are ordered by their ids, however they arrive."""
    calls = [(1, i, 0, "add", "{}", []) for i in ("b", "a", "c")]
    for order in (calls, calls[::-1]):
        assert [c["id"] for c in json.loads(link(spark, order, [(9, "x", 0, "y")])[1]["json"])["calls"]] == ["a", "b", "c"]


# -- HTML

PAGE = """<html><head><title>t</title></head><body><nav><a href="/">Home</a> <a href="/x">X</a></nav><div><a>one</a> <a>two</a> <a>three</a></div>
<p>%s</p><p>%s</p>%s<div><a>foot</a><a>note</a></div><footer>all rights</footer><script>var x = "no";</script></body></html>""" % ("A long first sentence of the article. " * 6, "And a second paragraph &amp; more of it. " * 6, "<div><a>k</a><a>l</a></div>" * 4)  # the kernel reaches three lines beyond the text


def test_content():
    text, lines, kept = html.extract(PAGE)
    assert "long first sentence" in text and "paragraph & more" in text and "var x" not in text and "all rights" not in text and "Home" not in text
    assert "footnote" not in text and kept < lines


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<div><b>", "<!-- x", "<script>", "&#0;", "plain text only", "<p>x</p>" * 20000, "</p></div>" * 50, "<![bad"])
def test_odd_pages(page):
    text, lines, kept = html.extract(page)
    assert kept <= lines and isinstance(text, str)
    assert html.extract(page) == (text, lines, kept)


@pytest.mark.parametrize("around", ["<html><head><title>t</title><body>%s</body></html>", "<body><nav><a>Home</a>%s</body>", "<body><div><button>Go</div>%s</body>", "<body><select><option>a%s", "<body><form action=x>%s</form></body>", "<body><nav><button>x</nav>%s</body>"])
def test_omitted_ends(around):
    """An omitted end tag, or a form around the page, hides no text."""
    body = "<p>" + "A long sentence of the article. " * 9 + "</p>"
    text = html.extract(around % (body * 3))[0]
    assert text.count("A long sentence") == 27 and "t\n" not in text
    assert "Home" not in html.extract("<head><title>t</title><body><nav><a>Home</a></nav>" + body)[0]


def brute_content(texts, tags):
    """The rule on lists of numbers: smooth, threshold, fill gaps, grow clusters."""
    import math
    import statistics

    ratio = [len(t) / max(1, n) for t, n in zip(texts, tags, strict=True)]
    n, reach = len(ratio), max(1, math.ceil(3 * html.SIGMA))
    weight = {d: math.exp(-0.5 * (d / html.SIGMA) ** 2) for d in range(-reach, reach + 1)}
    even = [sum(w * ratio[min(n - 1, max(0, i + d))] for d, w in weight.items()) / sum(weight.values()) for i in range(n)]
    limit = html.SHARE * statistics.pstdev(even)
    kept = {i for i in range(n) if even[i] >= limit and even[i] > 0}
    core = sorted(kept)
    for a, b in zip(core, core[1:], strict=False):
        if b - a <= html.GAP + 1:
            kept |= set(range(a, b))
    while grown := {j for i in kept for j in (i - 1, i + 1) if 0 <= j < n and j not in kept and ratio[j] >= limit}:
        kept |= grown
    return [texts[i] for i in sorted(kept)]


def test_content_of_real_pages(spark, sf):
    """Every page of the table against the rule on plain lists, over lines that regular expressions cut."""
    import html as entities
    import re

    block = "|".join(sorted(html._BLOCK, key=len, reverse=True))
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        page = re.sub(r"(?is)<(script|style|noscript|template|head|nav|footer|aside|select|button|svg|iframe)\b[^>]*>.*?</\1\s*>", lambda m: "".join(t for t in re.findall(r"</?[a-zA-Z][^>]*>", m[0])[:1]) + "\x01" * max(0, len(re.findall(r"</?[a-zA-Z][^>]*>", m[0])) - 1), r["html"])
        if "\x01" in page and re.search(rf"(?i)<(?:{block})\b", "".join(re.findall(r"<[^>]*>\x01+", page))):
            continue  # block tags inside what is hidden: the lines differ, the golden pages cover it
        lines, tags, text, count = [], [], "", 0
        for part in re.findall(r"<[^>]*>|\x01|\n|[^<\x01\n]+", page):
            m = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)", part)
            cut = part == "\n" or m and m[2].lower() in html._BLOCK
            if m and m[1]:
                count += 1
            if cut and (text or count):
                lines, tags, text, count = [*lines, text], [*tags, count], "", 0
            if m and not m[1]:
                count += 1
            if part == "\x01":
                count += 1
            if not m and part not in ("\n", "\x01") and not part.startswith("<"):
                text += entities.unescape(part)
        lines, tags = [*lines, text], [*tags, count]
        kept, sums, wait = [], [], 0
        for t, n in zip(lines, tags, strict=True):
            t = re.sub(r"\s+", " ", t).strip()
            if t:
                kept, sums, wait = [*kept, t], [*sums, n + wait], 0
            else:
                wait += n
        assert html.content_lines(kept, sums) == brute_content(kept, sums)
        got = html.extract(r["html"])
        assert got[0] == "\n".join(brute_content(kept, sums))


@pytest.mark.parametrize("page", ["<a" * 40000, "<!--" * 40000, "</" * 40000, "<![x" * 40000, "<?" * 40000, "<a href='" * 20000 + ">", "<!--" * 40000 + ">", "<nav>" * 16000 + "</p>" * 16000, "<nav><button>" * 8000 + "</p></button>" * 8000])
def test_hostile_pages_take_linear_time(page):
    import time

    start = time.process_time()
    html.extract(page)
    assert time.process_time() - start < 5


@pytest.mark.parametrize("seed", range(5))
def test_content_rule(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        texts = ["w" * int(k) + str(i) for i, k in enumerate(rng.choice([1, 3, 20, 90, 300], n))]
        tags = rng.integers(0, 6, n).tolist()
        assert html.content_lines(texts, tags) == brute_content(texts, tags)


def test_plain_text_stays():
    assert html.extract("plain text only")[0] == "plain text only"


def test_smoothing():
    x = np.array([0, 0, 10.0, 0, 0, 0, 0])
    y = html.smooth(x)
    assert y.argmax() == 2 and abs(y.sum() - 10) < 0.1 and len(y) == 7


def test_html_table(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, content string")
    out = html.extract_pages(d).collect()
    assert len(out) == 3 and out[0] == out[2] and out[1]["content"] == "" and out[1]["page_id"] is None
    assert html.extract_pages(d.limit(0)).count() == 0


# -- URLs


def covered(url, rules):
    """The longest rule that covers a URL, each rule tried in turn."""
    from urllib.parse import urlsplit

    if not url or "//" not in url:
        return None
    u = urlsplit(url)
    host, path = (u.hostname or "").strip("."), u.path.rstrip("/")
    whole = host + path
    found = [r for r in map(str.strip, rules) if r and (host == r or host.endswith("." + r) or whole == r or ("/" in r and whole.startswith(r + "/")))]
    return max(found, key=len, default=None)


@pytest.mark.parametrize("limit", [urls.SHARD_RULES, 1])
def test_urls(spark, limit):
    rules = ["bad.com", "x.org/path", "x.org/path/deep", " ", "ünï.de"]
    rows = ["http://bad.com/a", "https://WWW.Bad.com", "http://notbad.com", "https://x.org/path/deep/er?q#f", "http://x.org/pathology", "http://u:p@x.org:80/path/", "//bad.com/x", "bad.com", None, "", "ftp://ünï.de/a", "http://x.org/PATH", "http://bad.com/" + "a/" * 5000]
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)] + [(0, rows[0], "x"), (None, rows[0], "x")], "page_id long, url string, rule string")
    got = [(r["url"], r["rule"], r["blocked"]) for r in urls.filter_urls(d, rules, limit).collect()]
    table = spark.createDataFrame([(r, 1) for r in [*rules, *rules, None, ""]], "rule string, url int")
    assert [(r["url"], r["rule"], r["blocked"]) for r in urls.filter_urls(d, table, limit).collect()] == got
    assert [r for _, r, _ in got][:11] == ["bad.com", "bad.com", None, "x.org/path/deep", None, "x.org/path", "bad.com", None, None, None, "ünï.de"]
    assert all(b == (r is not None) and r == covered(u, set(rules)) for u, r, b in got)
    assert urls.filter_urls(d.limit(0), rules).count() == 0 and urls.filter_urls(d, []).where("blocked").count() == 0


def test_collisions(tmp_path):
    (tmp_path / "r").write_bytes(urls.pack(["a.com", "b.com", "c.com"], np.array([5, 5, 9])))
    a = urls.DigestArray(str(tmp_path / "r"))
    keys = ["a.com", "b.com", "zzz.com", "c.com"]  # of one digest: only the stored string counts
    assert a.contains(np.array([5, 5, 5, 5]), [(0, len(k), k) for k in keys]).tolist() == [True, True, False, False]


def test_keys_are_all_prefixes_and_domains():
    keys = [w[a:b] for _, a, b, w in urls.keys_of("https://u:p@X.Bad.org:80//a//b/c/?q")]
    assert keys == ["x.bad.org//a//b/c", "x.bad.org//a//b", "x.bad.org//a", "x.bad.org", "bad.org", "org"]
    import xxhash

    assert all(d == xxhash.xxh64_intdigest(w[a:b], seed=urls.SEED) for d, a, b, w in urls.keys_of("http://a.b/c/d"))
    assert len(urls.keys_of("http://a.b/" + "x/" * 200_000)) == 200_002 and len(urls.keys_of("http://" + "a." * 100_000 + "b/")) == 1
    assert urls.keys_of(None) == urls.keys_of("x") == urls.keys_of("http:///a") == []


# -- WARC


def test_warc(spark):
    page = "<html lang=de><head><title>A \n B</title></head><body><p>x &lt; y</p><a href='/'>l</a><script>no</script></body></html>"
    d = spark.createDataFrame([(1, "http://a.de/", page, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "http://a.de/", page, "x")], "page_id long, url string, html string, block string")
    out = warc.derivatives_of_pages(d)
    rows = out.collect()
    assert len(rows) == 8 and out.where("page_id = 1").distinct().count() == 2
    meta, conv = (next(r for r in rows if r["page_id"] == 1 and r["record_type"] == k) for k in ("metadata", "conversion"))
    assert meta["refers_to"] == conv["refers_to"] and meta["record_id"] != conv["record_id"] and meta["payload_digest"] == conv["payload_digest"]
    assert meta["block"].startswith("title: A B\r\nlanguage: de\r\noutlinks: 1\r\n") and conv["block"] == "x < y\nl"
    assert conv["content_length"] == len(conv["block"].encode()) and "Content-Length: " + str(len(page)) in conv["source_headers"]
    record = warc.serialise(out).where("page_id = 1 and record_type = 'conversion'").first()["record"]
    assert record.startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and record.endswith("\r\n\r\nx < y\nl\r\n\r\n") and f"WARC-Refers-To: {conv['refers_to']}" in record
    assert warc.derivatives_of_pages(d.limit(0)).count() == 0


def warc_record(kind, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}-{len(block)}>", "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in fields.items()}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    """Responses of plain and compressed files become derivatives that refer to them; what is broken ends its file."""
    page = "<html lang=fr><title>T</title><p>d\u00e9j\u00e0 vu</p></html>"
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + page.encode("latin-1")
    body = gzip.compress(page.encode())
    chunks = b"".join(f"{len(c):x}\r\n".encode() + c + b"\r\n" for c in (body[:20], body[20:])) + b"0\r\n\r\n"
    packed = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    records = [warc_record("warcinfo", b"x: y\r\n"), warc_record("request", b"GET / HTTP/1.1\r\n\r\n"), warc_record("response", plain, WARC_Target_URI="http://a.fr/", WARC_Date="2024-01-02T03:04:05Z"), warc_record("response", packed)]
    (tmp_path / "a.warc").write_bytes(b"".join(records) + b"junk\n" + warc_record("response", b"no head") + warc_record("response", plain)[:-40])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_responses(spark, str(tmp_path)).collect()
    assert sorted(r["payload"] for r in got) == sorted([page] * 4 + [""])
    one = next(r for r in got if r["target_uri"])
    assert one["date"] == "2024-01-02T03:04:05Z" and one["headers"].startswith("HTTP/1.1 200 OK\r\n") and one["headers"].endswith("\r\n")
    out = warc.derive(warc.read_responses(spark, str(tmp_path))).collect()
    assert len(out) == 10 and {r["refers_to"] for r in out} == {r["record_id"] for r in got}
    conv = next(r for r in out if r["record_type"] == "conversion" and r["target_uri"])
    assert conv["block"] == "d\u00e9j\u00e0 vu" and conv["source_headers"] == one["headers"]
    # what is written is read again
    written = warc.serialise(warc.derive(warc.read_responses(spark, str(tmp_path)))).collect()
    for r in written:
        ((head, block),) = warc.records_of(r["record"].encode())
        assert head["warc-type"] == r["record_type"] and head["content-length"] == str(len(block))


def test_derivative_cases(spark):
    rows = [("r1", "u", "d", None, None), (None, None, None, "h", ""), ("r2", "u", "d", "h", "<p>" + "word " * 200_000), ("r3", "u", "d", "h", "<script>" * 30_000), ("r4", "u", "d", "h", "<!--" * 60_000), ("r5", "u", "d", "h", "<a" * 60_000), ("r6", "u", "d", "h", "<title" * 60_000), ("r7", "u", "d", "h", "<html " * 60_000)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "record_id string, target_uri string, date string, headers string, payload string, block string")
    out = {(r["refers_to"], r["record_type"]): r for r in warc.derive(d).collect()}
    assert len(out) == 2 * len(rows) and out["r1", "conversion"]["block"] == "" and out["r1", "conversion"]["source_headers"] == ""
    assert out[None, "metadata"]["record_id"] is None and out["r2", "conversion"]["content_length"] == 999_999
    assert out["r3", "conversion"]["block"] == out["r4", "conversion"]["block"] == "" and out["r5", "conversion"]["block"] == "<a" * 60_000


# -- decontamination


def stretches(places, n):
    """Maximal runs of the words that [p, p + n) cover."""
    out = []
    for p in sorted(places):
        if out and p <= out[-1][1]:
            out[-1][1] = p + n
        else:
            out.append([p, p + n])
    return out


def brute_leaks(text, items):
    """(first, end, item_id) of what leaks, item by item on lists of words."""
    w, least, found = words_of(text), decontaminate.LEAST, []
    for i, t in items:
        s = words_of(t)
        rank = (len(s), i is None, i or 0)
        n = min(least, len(s))
        if not n:
            continue
        own = {tuple(s[k : k + n]): None for k in range(len(s) - n + 1)}
        hit = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in own]
        said = {tuple(w[p : p + n]) for p in hit}
        covered = {q for k in range(len(s) - n + 1) if tuple(s[k : k + n]) in said for q in range(k, k + n)}
        if covered and len(covered) >= decontaminate.COVERAGE * len(s):
            found += [(a, b, rank) for a, b in stretches(hit, n)]
        if len(s) < least:
            continue
        for a in range(len(w)):  # the longest match from each word
            b = a
            while b < len(w) and any(s[k : k + b - a + 1] == w[a : b + 1] for k in range(len(s) - (b - a))):
                b += 1
            if b - a >= decontaminate.LENGTH:
                found.append((a, b, rank))
    wide = {(a, b): min(r for x, y, r in found if (x, y) == (a, b)) for a, b, _ in found if not any((c < a and b <= d) or (c <= a and b < d) for c, d, _ in found)}
    return sorted((a, b, r[2] if not r[1] else None) for (a, b), r in wide.items())


def leaks_by_doc(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], []).append((r["first_word"], r["end_word"], r["item_id"]))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("shard_words", [decontaminate.SHARD_WORDS, 50])
def test_leaks(spark, docs, rng, make_prose, shard_words):
    phrases = [make_prose(n) for n in (5, 6, 7, 9)]  # that items share
    items = [(i, " ".join([make_prose(rng.randrange(3, 20)), rng.choice(phrases), make_prose(rng.randrange(0, 12)), rng.choice(phrases)])) for i in range(15)]
    items += [(15, "ba be bi"), (16, None), (17, ""), (18, "x1 y1"), (19, items[3][1] + " " + make_prose(4))]
    rows = []
    for i in range(80):
        parts = [make_prose(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            item = (rng.choice([*items[:15], items[18], items[19]])[1]).split()
            a = rng.randrange(0, len(item))
            parts += [rng.choice([" ".join(item[a : a + rng.randrange(3, 30)]).upper() + "!", rng.choice(phrases)]), make_prose(rng.randrange(0, 20))]
        rows.append((i, " ".join(parts)))
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = leaks_by_doc(decontaminate.find_leaks(docs(rows), bench, shard_words=shard_words))
    want = {i: x for i, t in rows if (x := brute_leaks(t, items))}
    assert got == want and want
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove_leaks(docs(rows), bench, shard_words=shard_words).collect()}
    for i, t in rows:
        keep = [x for k, x in enumerate(words_of(t)) if not any(a <= k < b for a, b, _ in want.get(i, []))]
        assert words_of(left.get(i, "")) == keep and (i in want or left[i] == t)


@pytest.mark.parametrize("shard_words", [decontaminate.SHARD_WORDS, 1])
def test_shared_phrases_count_for_every_item(spark, docs, shard_words):
    """Each item's coverage is its own, whichever other items hold the same words, and in whatever shards they lie."""
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(15)]
    b[:6] = a[:6]
    c = ["c0", "c1", *a[14:20], *[f"c{i}" for i in range(30)]]
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "item_id long, text string")
    rows = [(1, ["x", *a[:6], "y", *a[9:15], "z"]), (2, ["x", *a[:6], "y", "z"]), (3, ["x", *c[:8], "y", *a[:5], "z"]), (4, ["x", *a[:5], "y", *c[:8]]), (5, [*a[:5], "x"] * 4)]
    d = docs([(i, " ".join(w)) for i, w in rows])
    got = leaks_by_doc(decontaminate.find_leaks(d, bench, shard_words=shard_words))
    assert got == {1: [(1, 7, 1), (8, 14, 1)], 3: [(1, 9, 3), (10, 15, 1)], 4: [(1, 6, 1), (7, 15, 3)]}
    assert got == {i: x for i, w in rows if (x := brute_leaks(" ".join(w), [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]))}
    left = {r["doc_id"]: r["text"].split() for r in decontaminate.remove_leaks(d, bench, shard_words=shard_words).collect()}
    assert left[1] == ["x", "y", "z"] and left[2] == rows[1][1] and left[3] == ["x", "y", "z"] and left[4] == ["x", "y"]


def test_short_items_match_whole(spark, docs):
    bench = spark.createDataFrame([(1, "q1 q2 q3"), (2, "q4")], "item_id long, text string")
    d = docs([(1, "a q1 q2 q3 b q1 q2"), (2, "q4"), (3, "q2 q3")])
    assert leaks_by_doc(decontaminate.find_leaks(d, bench)) == {1: [(1, 4, 1)], 2: [(0, 1, 2)]}
    assert {r["doc_id"]: r["text"] for r in decontaminate.remove_leaks(d, bench).collect()} == {1: "a  b q1 q2", 3: "q2 q3"}


@pytest.mark.parametrize("extra", [False, True])
def test_leak_cases(spark, docs, make_prose, extra):
    item = make_prose(12)
    bench = spark.createDataFrame([(1, item), (1, item), (None, make_prose(9))], "item_id long, text string")
    d = docs([(1, f"Start, {item}. End"), (2, None), (3, ""), (4, item), (None, item), (1, f"Start, {item}. End"), (5, make_prose(30000))], extra)
    out = decontaminate.remove_leaks(d, bench)
    assert out.columns == d.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(t for i, t in left if i == 1) == ["Start, . End"] * 2 and 4 not in [i for i, _ in left] and len(left) == 5
    assert decontaminate.find_leaks(d.limit(0), bench).count() == 0 and decontaminate.find_leaks(d, bench.limit(0)).count() == 0


def test_shards(spark, docs, make_prose):
    items = [(i, make_prose(20)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert len(decontaminate.publish_automata(bench, 50)) == 2
    long = make_prose(20000)
    got = leaks_by_doc(decontaminate.find_leaks(docs([(1, "x9 " + long)]), spark.createDataFrame([(1, long)], "item_id long, text string")))
    assert got == {1: [(1, 20001, 1)]}
