"""Language ID of pages and documents against a row-by-row version of the formula."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from cairngraph.llm import langid, queries
from cairngraph.llm._text import lower

EN, DE, BOTH = "the house and the garden with water ", "der hund und die katze nicht haben ", "anna otto bob "


def brute(rows, model, first=0):
    """[(language, posterior)] of (text, declared, host, suffix) rows, from the ``first`` on."""
    languages, k = model.languages, len(model.languages)
    scores, size = langid.text_scores(lower(pa.array([r[0] for r in rows], pa.string())), model.weights)
    best = [int(s.argmax()) if n else None for s, n in zip(scores, size, strict=True)]
    seen = [(r, b) for r, b in zip(rows, best, strict=True) if b is not None]
    total, n = Counter(b for _, b in seen), len(seen)
    base = [(total[i] + 1) / (n + k) for i in range(k)]

    def prior(host, suffix):
        s = [b for r, b in seen if r[3] == suffix]
        h = [b for r, b in seen if r[2:] == (host, suffix)]
        smooth = [(s.count(i) + langid.SUFFIX_STRENGTH * base[i]) / (len(s) + langid.SUFFIX_STRENGTH) for i in range(k)]
        return [math.log((h.count(i) + langid.HOST_STRENGTH * smooth[i]) / (len(h) + langid.HOST_STRENGTH)) for i in range(k)] if h else [math.log(x) for x in base]

    def said(d):
        own = [b for r, b in seen if r[1] == d]
        return [math.log((own.count(i) + langid.DECLARED_STRENGTH * len(own) / (n + 1)) / (total[i] + langid.DECLARED_STRENGTH)) if d and own else 0.0 for i in range(k)]

    out = []
    for r, s, m in list(zip(rows, scores, size, strict=True))[first:]:
        x = [langid.TEXT_WEIGHT * s[i] + a + b for i, (a, b) in enumerate(zip(prior(*r[2:]), said(r[1]), strict=True))]
        p = [math.exp(v - max(x)) for v in x]
        known = m > 0 and s.max() > langid.FLOOR * m
        out.append((languages[p.index(max(p))], max(p) / sum(p)) if known else (langid.UNKNOWN, 0.0))
    return out


def site(spark, tmp_path):
    docs = [(i, (EN if i % 2 else DE) * 5, "en" if i % 2 else "de", f"src{i % 3}", 1) for i in range(60)]
    pages = [(i, f"http://h{i % 4}.{'com' if i % 2 else 'de'}/x", f'<html lang="{"en" if i % 2 else "de"}"><style>der die</style><p>{(EN if i % 2 else DE) * 3}</p></html>') for i in range(40)]
    pages += [(100, "http://new.com/", f"<html><p>{BOTH}</p></html>"), (101, "http://h0.de/", f"<html><p>{BOTH}</p></html>"), (102, "http://h1.com/", f"<html lang=de><p>{BOTH}</p></html>"), (103, "http://h1.com/", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return docs, pages


def test_every_page_and_document(spark, tmp_path):
    docs, pages = site(spark, tmp_path)
    got = queries.op2_language_id(spark, str(tmp_path)).collect()
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(table, "doc_id", F.col("text"), F.lower("lang"))
    bare = [re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", h or "") for _, _, h in pages]
    lang = [(re.findall(r'<html lang="?(\w+)', h or "") or [""])[0] for _, _, h in pages]
    host = [u.split("/")[2] for _, u, _ in pages]
    want = brute(list(zip(bare, lang, host, [h.split(".")[-1] for h in host], strict=True)), model)
    found = {r["page_id"]: (r["lang"], r["posterior"]) for r in got if r["page_id"] is not None}
    assert len(got) == len(docs) + len(pages) and len(found) == len(pages)
    for (i, _, _), (name, p) in zip(pages, want, strict=True):
        assert found[i][0] == name and abs(found[i][1] - p) < 1e-9
    want = brute([(t, "", s, "") for _, t, _, s, _ in docs], model)
    found = {r["doc_id"]: (r["lang"], r["posterior"]) for r in got if r["doc_id"] is not None}
    for (i, *_), (name, p) in zip(docs, want, strict=True):
        assert found[i][0] == name and abs(found[i][1] - p) < 1e-9


def test_rare_languages_are_modelled(spark):
    """A language that a sample over all rows hardly holds is modelled like any other."""
    ru = "этот дом и сад с водой не для нас "
    rows = [(i, EN * 2, "en", "a.com") for i in range(40000)] + [(50000 + i, ru * 3, "ru", "b.ru") for i in range(12)] + [(60000, DE * 5, "de", "c.de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert langid.train(d, "doc_id", F.col("text"), F.lower("lang")).languages == ["de", "en", "ru"]
    got = {r["doc_id"]: (r["lang"], r["accepted"]) for r in langid.identify_documents(d).where("doc_id >= 50000").collect()}
    assert len(got) == 13 and all(x == (("de" if i == 60000 else "ru"), True) for i, x in got.items())


def test_rare_declarations_are_evidence(spark):
    """What a language rarely declares counts, however many declarations are more frequent."""
    rows = [(i, (EN if i % 2 else DE) * 3, f"x{i // 2}", None) for i in range(10000)] + [(20000 + i, DE * 3, "zz", None) for i in range(1)] + [(30000, BOTH, "zz", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, said string, source string")
    model = langid.train(d.withColumn("lang", F.when(F.col("text").contains("hund"), "de").otherwise("en")), "doc_id", F.col("text"), F.col("lang"))
    got = langid.identify(d, langid.Evidence(F.col("text"), F.col("said")), model)[0].where("doc_id = 30000").first()
    want = brute([(t, s, "", "") for _, t, s, _ in rows], model, len(rows) - 1)[-1]
    assert got["__cairn_lang"] == want[0] and abs(got["__cairn_posterior"] - want[1]) < 1e-9
