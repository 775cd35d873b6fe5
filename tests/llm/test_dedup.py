"""MinHash near-dedup, run-length index, removal of repeats, embedding near-dedup, against brute force."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from cairngraph.llm import _text, itq, minhash, repeats
from cairngraph.llm._shared import Scratch, components
from cairngraph.llm.rindex import RunLengthIndex, suffix_array

ALONE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _text.ALONE)
TOKEN = regex.compile(rf"[{ALONE}]|(?:(?![{ALONE}])[\p{{L}}\p{{M}}\p{{N}}])+")


def words_of(text):
    return TOKEN.findall((text or "").lower())


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def groups_of(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def brute_groups(rows, threshold=minhash.THRESHOLD):
    sets = {i: shingles_of(t) for i, t in rows if i is not None}
    sets = {i: s for i, s in sets.items() if s}
    keys = sorted(sets)
    return groups_of((a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


def edited(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


def group_rows(df, key="doc_id"):
    return {r[key]: r["group_id"] for r in df.collect()}


def test_groups(spark, docs, rng, make_prose):
    rows = [(i, make_prose(rng.randrange(20, 200))) for i in range(80)]
    n = 80
    for i in range(30):
        for share in (0.0, 0.02, 0.05):
            rows.append((n, edited(rng, rows[i][1], share)))
            n += 1
    want, got = brute_groups(rows), group_rows(minhash.near_groups(docs(rows)))
    wrong = {i for i in set(want) | set(got) if want.get(i) != got.get(i)}
    assert len(wrong) <= 0.02 * len(want)
    kept = {r["doc_id"] for r in minhash.drop_near_copies(docs(rows)).collect()}
    assert kept == {i for i, _ in rows if got.get(i, i) == i}


@pytest.mark.parametrize("extra", [False, True])
def test_group_cases(spark, docs, make_prose, extra):
    t, u = make_prose(40), make_prose(40)
    rows = [(1, t), (2, t), (3, ""), (4, None), (5, "!!"), (None, t), (6, "ab"), (7, "AB!"), (8, u), (8, u), (9, u + " " + make_prose(30000)), (2, t)]
    d = docs(rows, extra)
    out = minhash.near_groups(d)
    assert {(r["doc_id"], r["group_id"], r["group_size"], r["keep"]) for r in out.collect()} == {(1, 1, 2, True), (2, 1, 2, False), (6, 6, 2, True), (7, 6, 2, False)}
    kept = minhash.drop_near_copies(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 8, 9]
    assert minhash.near_groups(d.limit(0)).count() == 0


@pytest.mark.parametrize(("threshold", "miss"), [(0.5, 0.01), (0.8, 0.05)])
def test_posterior_bounds(threshold, miss):
    """The posterior's tail by integrating its density over a fine grid."""
    least = minhash.least_matches(threshold, miss)
    assert len(least) == 8 and (np.diff(least) > 0).all()
    x = (np.arange(200_000) + 0.5) / 200_000

    def tail(m, n):
        log = m * np.log(x) + (n - m) * np.log1p(-x)
        density = np.exp(log - log.max())
        return density[x >= threshold].sum() / density.sum()

    for k, m in enumerate(least):
        n = 16 * (k + 1)
        assert tail(m, n) >= miss and (m == 0 or tail(m - 1, n) < miss)


def test_components(spark, rng):
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a long, b long")
    for limit in (10**6, 7):  # seven edges a union: many rounds
        got = {r["id"]: r["root"] for r in components(df, Scratch(spark), limit).collect()}
        assert got == groups_of(edges)
    assert components(df.limit(0), Scratch(spark)).count() == 0
    assert {tuple(r) for r in components(spark.createDataFrame([(5, 5), (5, 6), (7, 7)], "a long, b long"), Scratch(spark)).collect()} == {(5, 5), (6, 5), (7, 7)}


def test_words():
    """Words by code points: blanks and punctuation of any script separate, scripts without blanks have words of one."""
    rows = ["Ein\u00a0\u201eWort\u201c \u2013 na\u00efve caf\u00e9s", "\u4f60\u597d\uff0c\u4e16\u754c abc\u6f22", "\u041f\u0440\u0438\u0432\u0435\u0442 x\u0301y", "", "\U0001f600 a\U00020000b", "\u0e2a\u0e27\u0e31\u0e2a"]
    low = _text.lower(pa.array(rows))
    words = _text.Words(low)
    raw, _ = _text.buffers(low)
    for r, text in enumerate(low.to_pylist()):
        got = [bytes(raw[words.start[k] : words.end[k]]).decode() for k in range(words.first[r], words.first[r + 1])]
        assert got == TOKEN.findall(text)
        a, b = _text.cased_ranges(rows[r].encode())
        assert [rows[r].encode()[x:y].decode().lower() for x, y in zip(a, b, strict=True)] == got
    assert words.counts.tolist() == [4, 6, 2, 0, 3, 4]


# -- run-length index


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=25), min_size=1, max_size=4), st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 6))
def test_matching_statistics(pieces, query, length):
    arrays = [np.array(p, np.uint64) for p in pieces]
    index = RunLengthIndex(arrays, [np.full(len(p), k) for k, p in enumerate(pieces)])
    found = index.matches([np.array(query, np.uint64)], length, longest=7)[0]
    for i in range(len(query)):
        w = query[i : i + length]
        holders = {k for k, p in enumerate(pieces) for j in range(len(p) - length + 1) if p[j : j + length] == w} if len(w) == length else set()
        assert found[i] in holders if holders else found[i] == -1


def test_suffix_array_and_runs():
    t = np.array([3, 1, 3, 1, 3, 1, 2, 0])
    sa, lcp = suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert lcp.tolist()[1:] == [next((k for k in range(9) if t[a : a + k + 1].tolist() != t[b : b + k + 1].tolist()), 0) for a, b in zip(sa[:-1], sa[1:], strict=True)]
    word = np.arange(100, dtype=np.uint64)
    assert RunLengthIndex([np.concatenate([word] * 20)], [np.zeros(2000, np.int64)]).runs < 250


def brute_spans(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words_of(t)
        marks = [False] * len(w)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if key in seen:
                marks[k : k + length] = [True] * length
            seen.add(key)
        spans, k = [], 0
        while k < len(w):
            if marks[k]:
                j = k
                while j < len(w) and marks[j]:
                    j += 1
                spans.append((k, j))
                k = j
            k += 1
        if spans:
            out[i] = spans
    return out


def merged(rows):
    out = {}
    for i, a, b in sorted(rows):
        s = out.setdefault(i, [])
        if s and a <= s[-1][1]:
            s[-1] = (s[-1][0], max(b, s[-1][1]))
        else:
            s.append((a, b))
    return out


def repeated_docs(rng, make_prose):
    passages = [make_prose(n) for n in (49, 50, 51, 60, 90, 140)]
    rows = []
    for i in range(60):
        parts = [make_prose(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(passages), make_prose(rng.randrange(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows.append((200, " ".join([passages[3]] * 5)))
    return rows


@pytest.mark.parametrize("block", [repeats.BLOCK, 700])
def test_repeats(spark, docs, rng, make_prose, block):
    rows = repeated_docs(rng, make_prose)
    got = repeats.find_repeats(docs(rows), block=block).collect()
    assert merged((r["doc_id"], r["first_word"], r["end_word"]) for r in got) == brute_spans(rows, repeats.LENGTH)
    text = {i: words_of(t) for i, t in rows}
    for r in got:
        w, source = text[r["doc_id"]][r["first_word"] : r["first_word"] + repeats.LENGTH], text[r["source_doc_id"]]
        assert r["source_doc_id"] <= r["doc_id"] and any(source[k : k + repeats.LENGTH] == w for k in range(len(source)))


def test_repeats_are_cut(spark, docs, rng, make_prose):
    rows = repeated_docs(rng, make_prose)
    left = {r["doc_id"]: r["text"] for r in repeats.drop_repeats(docs(rows)).collect()}
    spans = brute_spans(rows, repeats.LENGTH)
    for i, t in rows:
        w = words_of(t)
        keep = [x for k, x in enumerate(w) if not any(a <= k < b for a, b in spans.get(i, []))]
        assert words_of(left.get(i, "")) == keep
        if i not in spans:
            assert left[i] == t


@pytest.mark.parametrize("extra", [False, True])
def test_repeat_cases(spark, docs, make_prose, extra):
    p = make_prose(60)
    rows = [(1, p), (2, f"One. {p.upper()}! Two."), (3, None), (4, ""), (None, p), (2, f"One. {p.upper()}! Two."), (5, p), (6, make_prose(30000))]
    d = docs(rows, extra)
    got = {(r["doc_id"], r["first_word"], r["end_word"], r["source_doc_id"]) for r in repeats.find_repeats(d).collect()}
    assert {g[:3] for g in got} == {(2, 1, 61), (5, 0, 60)}
    out = repeats.drop_repeats(d)
    assert out.columns == d.columns
    left = {r["doc_id"]: r for r in out.collect()}
    assert left[2]["text"] == "One. ! Two." and left[2]["n_chars"] == len("One. ! Two.")
    assert 5 not in left and left[1]["text"] == p and left[None]["text"] == p and left[3]["text"] is None and left[4]["text"] == ""
    assert repeats.find_repeats(d.limit(0)).count() == 0


def test_repeats_of_one_component(spark, docs, make_prose):
    """Passages that join all documents are no one task's; compared block by block, this component took minutes."""
    passages = [make_prose(60) for _ in range(1500)]
    rows = [(i, " ".join([passages[i % 1500], make_prose(40), passages[i * 7 % 1500], make_prose(40), passages[(i + 1) % 1500]])) for i in range(3000)]
    began = time.monotonic()
    left = {r["doc_id"]: words_of(r["text"]) for r in repeats.drop_repeats(docs(rows), block=700).collect()}
    assert time.monotonic() - began < 60
    spans = brute_spans(rows, repeats.LENGTH)
    for i, t in rows:
        assert left.get(i, []) == [x for k, x in enumerate(words_of(t)) if not any(a <= k < b for a, b in spans.get(i, []))]


def test_repeats_beside_a_common_phrase(spark, docs, make_prose):
    """A phrase that every document has in other text crowds its keys: their windows are dealt one by one, with the same result."""
    phrase, passage = make_prose(40), make_prose(60)
    rows = [(i, " ".join([make_prose(30), phrase, make_prose(30), passage if i % 5 == 0 else make_prose(10)])) for i in range(600)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 600, 50)]
    d = docs(rows)
    keys = repeats.crowded_keys(d, repeats.LENGTH, repeats.ANCHOR, repeats.BLOCK, 300)
    assert len(keys) and (np.diff(keys.astype(object)) > 0).all()
    for crowd in (300, repeats.CROWD):
        got = repeats.find_repeats(d, crowd=crowd).collect()
        assert sorted((r["doc_id"], r["first_word"], r["end_word"]) for r in got) == sorted((i, a, b) for i, x in brute_spans(rows, repeats.LENGTH).items() for a, b in x)


# -- embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    n = 400
    for i in range(150):
        for noise in (0.0, 0.2, 0.45):
            rows.append((n, (base[i] + noise * rng.standard_normal(64)).tolist()))
            n += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= itq.THRESHOLD, 1))
    want, got = groups_of(zip(a.tolist(), b.tolist(), strict=True)), group_rows(itq.near_groups(df), "vec_id")
    joined = sum(got.get(i) is not None and got.get(i) == got.get(j) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert joined >= 0.9 * len(a)
    assert all(want.get(i) == want.get(r) for i, r in got.items())


def test_embedding_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (1, [1.0, 0.0]), (8, [float("inf"), 1.0]), (9, [])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, id long, v string")
    assert {(r["vec_id"], r["group_id"], r["group_size"]) for r in itq.near_groups(df).collect()} == {(1, 1, 2), (2, 1, 2)}
    assert itq.near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("norm", [0.8, 0.88])
def test_embeddings_of_a_common_mean(spark, norm):
    """Near copies are found where all vectors share a strong component, so that centred ones lie further apart."""
    rng = np.random.default_rng(5)
    own = rng.standard_normal((1200, 64))
    own[:, 0] = 0
    base = math.sqrt(1 - norm**2) * own / np.linalg.norm(own, axis=1, keepdims=True)
    base[:, 0] = norm
    noise = rng.standard_normal((400, 64))
    noise -= (noise * base[:400]).sum(1, keepdims=True) * base[:400]
    cosine = rng.uniform(0.9, 0.95, (400, 1)) + 1e-4
    near = cosine * base[:400] + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))], "vec_id long, embedding array<float>")
    got = group_rows(itq.near_groups(df), "vec_id")
    assert np.mean([got.get(i) is not None and got.get(i) == got.get(1200 + i) for i in range(400)]) >= 0.9
