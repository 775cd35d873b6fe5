"""The pipeline against its brute-force version, and the registered queries over the smallest tables."""

from __future__ import annotations

import os

import __spark_entry__
import pytest
from test_dedup import TOKEN, brute_groups, brute_spans, words_of
from test_others import brute_leaks

import corpus_pipeline
from cairngraph.llm import bpe, langid, repeats

NAMES = [*(f"op{n}_" for n in range(1, 11)), "pipeline"]


def cut(text, spans):
    """The text without ranges of words, by regular expression."""
    at = [m.span() for m in TOKEN.finditer(text)]
    out, last = [], 0
    for a, b in sorted(spans):
        if at[a][0] >= last:
            out.append(text[last : at[a][0]])
        last = max(last, at[b - 1][1])
    return "".join(out) + text[last:]


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_dedup", "decontamination", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no rank file")
def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    kept = {r["doc_id"] for r in langid.identify_documents(docs).where("accepted").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    group = brute_groups(rows)
    rows = [(i, t) for i, t in rows if group.get(i, i) == i]
    spans = brute_spans(rows, repeats.LENGTH)
    rows = [(i, cut(t, spans[i]) if i in spans else t) for i, t in rows]
    rows = [(i, t) for i, t in rows if words_of(t)]
    done = []
    for i, t in rows:
        found = brute_leaks(t, items)
        left = cut(t, [(a, b) for a, b, _ in found]) if found else t
        if words_of(left):
            done.append((i, left))
    got = corpus_pipeline.run(spark, sf)
    text = {r["doc_id"]: r["text"] for r in bpe.decode(got).collect()}
    assert text == dict(done)
    assert got.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"]


def test_language_stage_by_the_formula(spark, sf):
    """The first stage against the posterior row by row."""
    from pyspark.sql import functions as F
    from test_langid import brute

    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(d, "doc_id", F.col("text"), F.lower("lang"))
    rows = d.orderBy("doc_id").collect()
    want = brute([(r["text"], "", r["source"], "") for r in rows], model)
    kept = [r["doc_id"] for r in corpus_pipeline.language_id(spark, d, sf).orderBy("doc_id").collect()]
    assert kept == [r["doc_id"] for r, (_, p) in zip(rows, want, strict=True) if p >= langid.LEAST_POSTERIOR]


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no rank file")
def test_pipeline_cases(spark, sf, tmp_path, make_prose):
    """Nulls, empty and very long texts, repeated rows, clashing names and an empty table pass through all stages."""
    t = make_prose(80)
    rows = [(i, make_prose(60), "en", "src0") for i in range(30)] + [(100, t, "en", None), (101, t, "en", "src1"), (102, None, "en", "src1"), (103, "", None, None), (None, make_prose(70), "en", "s"), (104, make_prose(40000), None, "src2"), (100, t, "en", None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, item_id int, `__cairn_text` string, `__cairn_spans` string, `__cairn_rank` int, `__cairn_lang` string, `__cairn_scores` string, `__cairn_d` string"
    spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", "x", 1, "x", "x", "x") for r in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert {(r[6], r[8], r[9]) for r in stage(spark, docs, str(tmp_path)).collect()} == {("x", 1, "x")}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == [*((False, i) for i in range(30)), (False, 100), (False, 104), (True, None)]
    assert all(r["round_trip"] for r in got)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_queries_are_registered():
    q = list(__spark_entry__.queries())
    for n in NAMES:
        assert sum(x.startswith(n) for x in q) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(q)


@pytest.mark.parametrize("prefix", [n for n in NAMES if n != "pipeline"])
def test_queries(spark, sf, prefix):
    import duckdb

    name = next(x for x in __spark_entry__.queries() if x.startswith(prefix))
    df = __spark_entry__.queries()[name](spark, sf).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(sql).df()
    norm = lambda x: sorted(tuple(map(str, r)) for r in x[sorted(x.columns)].itertuples(index=False))
    assert norm(df) == norm(want)
