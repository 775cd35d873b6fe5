"""Exact vector search: cosine in double precision by higher-order functions, top-k by TakeOrderedAndProject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.functions import schema as S


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where their lengths differ, one is null or empty, or the norms' product is below 1e-12."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (norms >= 1e-12), _dot(a, b) / norms).otherwise(0.0)


def _top(scored: DataFrame, top_k: int, min_similarity: float) -> DataFrame:
    kept = scored.where(F.col("score") >= min_similarity).orderBy(F.round("score", 12).desc(), "id")
    return kept.limit(top_k) if top_k > 0 else kept


def semantic_search(vectors: DataFrame, query: Sequence[float], top_k: int = 10, min_similarity: float = 0.0) -> DataFrame:
    """(id, score) of the rows of (id, vector) that are closest to the query; top_k 0 is all."""
    if not query:
        raise S.DimensionMismatch("empty query vector")
    q = F.array(*[F.lit(float(x)) for x in query])
    return _top(vectors.select("id", cosine(F.col("vector"), q).alias("score")), top_k, min_similarity)


def similarity(vectors: DataFrame, unit_id: int, top_k: int = 10, min_similarity: float = 0.0) -> DataFrame:
    """(id, score) of the vectors closest to a unit's own, without itself."""
    own = vectors.where(F.col("id") == unit_id).first()
    if own is None:
        raise S.UnitNotFound(str(unit_id))
    others = vectors.where(F.col("id") != unit_id)
    if not own["vector"]:
        return _top(others.select("id", F.lit(0.0).alias("score")), top_k, min_similarity)
    return semantic_search(others, own["vector"], top_k, min_similarity)


def index_search(vectors: DataFrame, query: Sequence[float], top_k: int = 10) -> DataFrame:
    """As semantic_search, over vectors of the query's dimension with a norm above 1e-10 only; no rows for an empty query."""
    if not query:
        return vectors.limit(0).select("id", F.lit(0.0).alias("score"))
    v = F.col("vector")
    fit = vectors.where(v.isNotNull() & (F.size(v) == len(query))).where(F.sqrt(_dot(v, v)) > 1e-10)
    return semantic_search(fit, query, top_k, -1.0)


def explain_match(score: Column) -> Column:
    """Why a match counts, in words."""
    return F.when(score > 0.9, "nearly the same").when(score > 0.7, "very similar").when(score > 0.4, "related").otherwise("loosely related")
