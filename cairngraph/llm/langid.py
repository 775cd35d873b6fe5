"""Language identification by Bayesian evidence fusion.

posterior(l) is proportional to prior(l | host) * P(declared | l) * P(text | l)^w, where

* the text likelihood is a naive Bayes model of hashed byte trigrams, trained on a bounded sample of labelled rows;
* the declared language is that of the mark-up, whose reliability is a smoothed confusion matrix (documents have no
  mark-up; their column lang holds the labels that the text model is fitted on, so it is no evidence);
* the host prior is smoothed towards its address suffix' and that towards all rows' distribution, all of them grouped
  counts of the text model's decisions over the whole table.

The counts are one narrow aggregation; the decision is one more pass over the texts, which becomes a few scores a row
before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.llm._shared import Scratch, checked_join, free, releasing
from cairngraph.llm._text import buffers, lower, row_chunks, word_bytes

#: Ids of each label whose rows the text model is fitted on at most (those of the least hashes).
TRAIN_ROWS = 6000
BUCKETS = 1 << 16
#: Weight of the text's log-likelihood (trigrams overlap, so they aren't independent), least posterior, strength of the
#: smoothing of a host towards its suffix and of a suffix towards all, and of the confusion matrix.
TEXT_WEIGHT, LEAST_POSTERIOR, HOST_STRENGTH, SUFFIX_STRENGTH, DECLARED_STRENGTH = 0.25, 0.5, 20.0, 50.0, 5.0
#: A text is of no known language if its trigrams are on average less likely than a random bucket.
FLOOR = float(-np.log(BUCKETS))
UNKNOWN = "und"
_PREFIX = "__cairn_"


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, whether it counts, each row's first) of the byte trigrams; texts get a blank at either end.

    All but letters is blank, and a trigram counts if its middle isn't, so numbers and symbols are no evidence.
    """
    raw, off = buffers(column)
    n = len(column)
    size = np.diff(off)
    start = np.cumsum(size + 2) - (size + 2)
    data = np.full(int((size + 2).sum()), 32, np.uint32)
    keep = np.ones(len(data), bool)
    keep[start] = False
    keep[start + size + 1] = False
    own = raw[off[0] : off[-1]]
    data[keep] = np.where(word_bytes(own)[0], own, 32) if own.max(initial=0) > 127 else own
    data[(data < 97) | (data > 122) & (data < 128)] = 32
    code = np.zeros(len(data), np.uint32)
    code[:-2] = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
    code ^= code >> 15
    counts = np.zeros(len(data), bool)
    counts[:-2] = data[1:-1] != 32  # this also leaves out trigrams that reach into the next text
    return ((code * np.uint32(0x2C1B3C6D)) >> 16).astype(np.int64), counts, start


def text_scores(column: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood[rows, languages], trigrams of each row) of lower-cased texts; model is [languages, BUCKETS]."""
    scores, sizes = [np.zeros((0, len(model)))], [np.zeros(0, np.int64)]
    for i, j in row_chunks(column):
        code, counts, start = _trigrams(column[i:j])
        at = np.flatnonzero(counts)
        code, cuts = code[at], np.searchsorted(at, np.r_[start, len(counts)])
        part = np.zeros((j - i, len(model)))
        full = np.flatnonzero(np.diff(cuts))
        if len(full):
            for k, row in enumerate(model):
                part[full, k] = np.add.reduceat(row[code], cuts[full])
        scores.append(part)
        sizes.append(np.diff(cuts))
    return np.concatenate(scores), np.concatenate(sizes)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, texts that hold it) of (lang, text): no text, however long or repetitive, makes a trigram frequent."""
    for batch in batches:
        label, text = np.array(batch.column(0).to_pylist(), object), lower(batch.column(1))
        for lang in sorted(set(label)):
            rows = text.take(pa.array(np.flatnonzero(label == lang)))
            n = np.zeros(BUCKETS, np.int64)
            for i, j in row_chunks(rows):
                code, counts, start = _trigrams(rows[i:j])
                at = np.flatnonzero(counts)
                row = np.searchsorted(start, at, "right")
                n += np.bincount(np.unique(row * BUCKETS + code[at]) % BUCKETS, minlength=BUCKETS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])


@dataclass
class Evidence:
    """Columns of a table that carry the evidence; each may be missing."""

    text: Column
    declared: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    host: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    suffix: Column = field(default_factory=lambda: F.lit(None).cast("string"))

    @staticmethod
    def of_documents() -> Evidence:
        """A document's own columns: its source stands for the host."""
        return Evidence(F.col("text"), host=F.col("source"), suffix=F.regexp_extract("source", r"\.([A-Za-z]+)$", 1))

    @staticmethod
    def of_pages() -> Evidence:
        """A page's mark-up without its tags, its html lang attribute, and the host and top-level domain of its address."""
        host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1))
        body = F.regexp_replace("html", r"(?is)<(?:script|style)\b.*?(?:</(?:script|style)[^<>]*>|\z)|<!--.*?(?:-->|\z)|<[a-z/!?][^<>]*>", " ")
        return Evidence(body, F.lower(F.regexp_extract("html", r"""(?i)<html[^<>]*\blang=["']?([A-Za-z]+)""", 1)), host, F.regexp_extract(host, r"\.([a-z]+)$", 1))


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray


def train(rows: DataFrame, key: str, text: Column, label: Column, limit: int = TRAIN_ROWS) -> TextModel:
    """Fits the trigram model on at most ``limit`` ids of each label, those of the smallest hashes; every label is modelled."""
    labelled = rows.select(F.xxhash64(key).alias("h"), text.alias("t"), label.alias("l")).where(F.col(key).isNotNull() & F.col("t").isNotNull() & (F.col("l") != ""))
    # the hashes are uniform, so about 2 limit ids of a label lie below the rough bound, and only those are sorted
    scratch = Scratch(rows.sparkSession)
    rough = scratch.keep(labelled.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("low")))
    below = (F.col("h") / float(2**64) + 0.5) * F.col("n") <= 2.0 * limit
    near = checked_join(labelled.select("h", "l"), rough, "l", "inner").where(below | (F.col("h") == F.col("low"))).select("l", "h").distinct()
    bound = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= limit).groupBy("l").agg(F.max("h").alias("bound"))
    bound = scratch.keep(bound)
    sample = checked_join(labelled, bound, "l", "inner").where("h <= bound")
    counted = sample.select("l", "t").mapInArrow(_count_trigrams, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(r["l"] for r in bound.select("l").collect())
    counts = np.zeros((len(languages), BUCKETS))
    for k, x in enumerate(languages):
        own = counted[counted.lang == x]
        counts[k, own.bucket.to_numpy()] = own.n.to_numpy()
    smooth = counts + 0.05
    return TextModel(languages, np.log(smooth / smooth.sum(1, keepdims=True)))


def _tally(model: TextModel):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = lower(batch.column(0))
            scores, size = text_scores(text, model.weights)
            best = scores.argmax(1)
            t = pa.table({"host": batch.column(1), "suffix": batch.column(2), "declared": batch.column(3), "best": pa.array(best.astype(np.int32))})
            t = t.filter(pa.array(size > 0)).group_by(["host", "suffix", "declared", "best"]).aggregate([([], "count_all")])
            yield from t.rename_columns(["host", "suffix", "declared", "best", "n"]).to_batches()

    return run


def identify(rows: DataFrame, evidence: Evidence, model: TextModel, least: float = LEAST_POSTERIOR, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(the columns ``keep`` of rows, all by default, with three more; the names of these: language, posterior, whether accepted)."""
    out_names = free(rows, *[_PREFIX + n for n in ("lang", "posterior", "accepted")])
    kept = [F.col(f"`{c}`") for c in (rows.columns if keep is None else keep)]
    scratch = Scratch(rows.sparkSession)
    k = len(model.languages)
    named = {"text": evidence.text, "host": F.coalesce(evidence.host, F.lit("")), "suffix": F.coalesce(evidence.suffix, F.lit("")), "declared": F.coalesce(evidence.declared, F.lit(""))}
    if not k:
        return rows.select(*kept, *[v.alias(n) for v, n in zip((F.lit(UNKNOWN), F.lit(0.0), F.lit(False)), out_names, strict=True)]), out_names
    narrow = rows.select(*[c.alias(n) for n, c in named.items()])
    tally = narrow.select("text", "host", "suffix", "declared").mapInArrow(_tally(model), "host string, suffix string, declared string, best int, n long")
    tally = scratch.table(tally.groupBy("host", "suffix", "declared", "best").agg(F.sum("n").alias("n")), "tally")
    n_of = [F.coalesce(F.sum(F.when(F.col("best") == i, F.col("n"))), F.lit(0)).cast("double").alias(f"n{i}") for i in range(k)]
    total = tally.agg(*n_of).first()
    base = np.array([total[i] for i in range(k)]) + 1.0
    base /= base.sum()
    suffix = tally.groupBy("suffix").agg(*n_of)
    in_suffix = [((F.col(f"n{i}") + SUFFIX_STRENGTH * float(base[i])) / (sum(F.col(f"n{j}") for j in range(k)) + SUFFIX_STRENGTH)).alias(f"s{i}") for i in range(k)]
    host = tally.groupBy("host", "suffix").agg(*n_of).join(suffix.select("suffix", *in_suffix), "suffix")
    prior = F.array(*[F.log((F.col(f"n{i}") + HOST_STRENGTH * F.col(f"s{i}")) / (sum(F.col(f"n{j}") for j in range(k)) + HOST_STRENGTH)) for i in range(k)])
    score_at, host_at, suffix_at, declared_at, prior_at, said_at = free(rows, *[_PREFIX + n for n in ("scores", "host", "suffix", "declared", "prior", "said")])
    priors = host.select(F.col("host").alias(host_at), F.col("suffix").alias(suffix_at), prior.alias(prior_at))
    # P(declared | best): what a language's rows declare; smoothed towards what all rows declare
    every = float(tally.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) + 1.0
    said = tally.where("declared <> ''").groupBy("declared").agg(*n_of, F.sum("n").alias("n"))
    likely = F.array(*[F.log((F.col(f"n{i}") + DECLARED_STRENGTH * F.col("n") / every) / (float(total[i]) + DECLARED_STRENGTH)) for i in range(k)])
    said = said.select(F.col("declared").alias(declared_at), likely.alias(said_at)).checkpoint(eager=True)
    priors = scratch.keep(priors)
    languages, weights = model.languages, model.weights

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(text: pa.Array) -> pa.Array:
        """The log-likelihood in each language, then the number of trigrams."""
        scores, size = text_scores(lower(text), weights)
        flat = np.concatenate([scores, size[:, None].astype(float)], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))

    narrow = rows.select(*kept, score.asNondeterministic()(named["text"]).alias(score_at), named["host"].alias(host_at), named["suffix"].alias(suffix_at), named["declared"].alias(declared_at))
    joined = checked_join(checked_join(narrow, priors, [host_at, suffix_at], "left"), said, declared_at, "left")
    scores, n, zeros, even = F.slice(score_at, 1, k), F.element_at(score_at, k + 1), F.array(*[F.lit(0.0)] * k), F.array(*[F.lit(float(x)) for x in np.log(base)])
    fused = F.zip_with(F.transform(scores, lambda x: x * TEXT_WEIGHT), F.zip_with(F.coalesce(said_at, zeros), F.coalesce(prior_at, even), lambda a, b: a + b), lambda a, b: a + b)
    fused_at, best_at = free(joined, _PREFIX + "fused", _PREFIX + "best")
    known = (n > 0) & (F.array_max(scores) > FLOOR * n)
    best, posterior = F.col(best_at), F.lit(1.0) / F.aggregate(fused_at, F.lit(0.0), lambda s, x: s + F.exp(x - F.col(best_at)))
    lang = F.element_at(F.array(*map(F.lit, languages)), F.array_position(fused_at, best).cast("int"))
    out = joined.withColumn(fused_at, fused).withColumn(best_at, F.array_max(fused_at))
    values = F.when(known, lang).otherwise(UNKNOWN), F.when(known, posterior).otherwise(0.0), known & (posterior >= least)
    return out.select(*kept, *[v.alias(c) for v, c in zip(values, out_names, strict=True)]), out_names


def identify_documents(docs: DataFrame, least: float = LEAST_POSTERIOR, model: TextModel | None = None) -> DataFrame:
    """(doc_id, declared, lang, posterior, accepted) of every row of documents; ``declared`` is the column lang, which is not evidence.

    Defined results: a text that is null, has no letter, or is less likely than chance in every language is 'und' with
    posterior 0 and is rejected, as is a best posterior below ``least``; a missing source or suffix is no evidence; very
    long texts are read whole; ties go to the language that sorts first; rows that repeat are decided alike; a null doc_id
    stays null; a table without labelled rows is rejected whole; an empty table gives no rows; other columns are not read.
    """
    model = model or train(docs, "doc_id", F.col("text"), F.lower("lang"))
    done, new = identify(docs.select("doc_id", "text", "lang", "source"), Evidence.of_documents(), model, least, ["doc_id", "lang"])
    return done.select(F.col("doc_id").cast("long"), F.col("lang").alias("declared"), *[F.col(c).alias(n) for c, n in zip(new, ("lang", "posterior", "accepted"), strict=True)])


def identify_pages(pages: DataFrame, docs: DataFrame, least: float = LEAST_POSTERIOR, model: TextModel | None = None) -> DataFrame:
    """(page_id, url, declared, lang, posterior, accepted) of every page, by the text model of the labelled documents.

    Defined results as in identify_documents: a page that is null, empty or of no letter outside its tags is rejected; a
    missing or unknown declaration, host or suffix is no evidence; a null page_id or url stays null.
    """
    model = model or train(docs, "doc_id", F.col("text"), F.lower("lang"))
    evidence = Evidence.of_pages()
    named = pages.select("page_id", "url", "html", evidence.declared.alias("declared"))
    done, new = identify(named, evidence, model, least, ["page_id", "url", "declared"])
    return done.select("page_id", "url", "declared", *[F.col(c).alias(n) for c, n in zip(new, ("lang", "posterior", "accepted"), strict=True)])


def identify_all(docs: DataFrame, pages: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """(doc_id, page_id, url, declared, lang, posterior, accepted) of every row of both tables, by one text model.

    A document has no page_id and url, a page no doc_id; see identify_documents and identify_pages for the rest.
    """
    model = train(docs, "doc_id", F.col("text"), F.lower("lang"))
    both = identify_documents(docs, least, model).unionByName(identify_pages(pages, docs, least, model), allowMissingColumns=True)
    return both.select("doc_id", "page_id", "url", "declared", "lang", "posterior", "accepted")


def keep_identified(docs: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """The rows of documents whose language is identified (``accepted`` of identify_documents); columns stay as they are."""
    model = train(docs, "doc_id", F.col("text"), F.lower("lang"))
    done, new = identify(docs, Evidence.of_documents(), model, least)
    return done.where(F.col(new[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
