from __future__ import annotations

import os

import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cairngraph.llm import bpe
from cairngraph.llm.lexicon import Lexicon, compile_lexicon

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no rank file")
ODD = ["", None, "it's we'll  you'd\n\n x ", "'s 'll '", "  \t a", "日本語 テキスト", "a" * 5000, " x y", "émigré naïve 12３½", "🙂🙃 \x00 end ", "x'ReT'll", " ' s", "don''t"]


def reference():
    v = bpe.vocabulary(bpe.VOCABULARY)
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=v.rank, special_tokens={})


def test_against_another_encoder():
    enc = reference()
    got = bpe.encode_column(pa.array(ODD)).to_pylist()
    for t, g in zip(ODD, got, strict=True):
        assert g["token_ids"] == enc.encode_ordinary(t or "") and g["round_trip"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's tlrevmd\n\t 1é語'’."), max_size=30), min_size=1, max_size=5))
def test_split_is_that_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    off = [0]
    for r in raw:
        off.append(off[-1] + len(r))
    import numpy as np

    text, start, _, first = bpe.split(b"".join(raw), np.array(off))
    ends = [*start[1:].tolist(), len(text)]
    got = [[text[a:b] for a, b in zip(start[first[k] : first[k + 1]].tolist(), ends[first[k] : first[k + 1]], strict=True)] for k in range(len(texts))]
    assert got == [regex.findall(bpe.PATTERN, t) for t in texts]


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(sorted({f"{a}{b}ing" for a in "abcdef" for b in "xyz"} | {"a", "ab", "abc", " ring"}))}
    (tmp_path / "l").write_bytes(compile_lexicon(words))
    lex = Lexicon(str(tmp_path / "l"))
    probes = [*words, b"", b"zzz", b"axin", b"axingg", b"abcd"]
    got = [lex.ids_of(r) if r >= 0 else None for r in lex.ranks(probes).tolist()]
    assert got == [words.get(p) for p in probes]
    langs = {b""} | {w[k:] for w in words for k in range(len(w) + 1)}
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    right = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(lex.final) == len(right) and langs


def test_round_trip_and_cases(spark, docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (0, ""), (2, ODD[2])]
    for extra in (False, True):
        out = bpe.encode(docs(rows, extra))
        assert out.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"] and out.count() == len(rows)
        assert out.where("not round_trip").count() == 0
        back = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in bpe.decode(out).collect())
        assert back == sorted((i if i is not None else -1, t or "") for i, t in rows)
    assert bpe.encode(docs([]).limit(0)).count() == 0


def test_frequent_pieces(spark, docs):
    d = docs([(1, "aa bb aa"), (2, "aa bb cc"), (3, None)])
    assert sorted(bpe.frequent_pieces(d)) == [" bb", "aa"]
    assert bpe.frequent_pieces(d, 1) == []
    assert bpe.frequent_pieces(docs([(1, "x x x x y y")]), 1) == [" x"]


def test_whole_table(spark, sf):
    enc = reference()
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in bpe.encode(d).collect():
        assert r["token_ids"] == enc.encode_ordinary(text[r["doc_id"]])
