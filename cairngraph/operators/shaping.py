"""Pages, extraction levels, versioned deltas, token accounting, and what may be shared."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.functions import schema as S

#: Levels of detail, their columns (None: all) and the tokens that a row of them costs, estimated.
LEVELS: dict[str, tuple[tuple[str, ...] | None, int]] = {
    "exists": ((), 1), "ids": (("id",), 2), "summary": (("id", "name", "unit_type"), 10), "fields": (("id", "name", "unit_type", "qualified_name", "file_path", "language"), 25), "full": (None, 100),
}
CREDENTIALS = ("api-key", "api_key", "apikey", "authorization", "aws_access_key", "bearer", "passwd", "password", "private_key", "secret", "token")
SHAREABLE = ("pattern", "statistics", "mistakes", "languages")
LAYERS = ("cache", "index", "scoped", "delta", "full")


def page(df: DataFrame, order: Sequence[str], offset: int = 0, size: int = 50) -> tuple[DataFrame, int, bool]:
    """(rows, total, has_more) of a page by offset."""
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(size), total, offset + size < total


def page_after(df: DataFrame, key: str, after: object | None = None, size: int = 50) -> DataFrame:
    """A page by key: the rows after the last key of the page before; costs the same at any depth."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def extract(df: DataFrame, level: str, fields: Sequence[str] | None = None) -> DataFrame:
    """The columns of a level, so that scans read no more; ``exists`` gives one row (found)."""
    if level not in LEVELS:
        raise S.QueryError(f"unknown level {level}")
    if level == "exists":
        return df.limit(1).agg((F.count("*") > 0).alias("found"))
    columns = fields if level == "fields" and fields else LEVELS[level][0]
    return df.select(*columns) if columns is not None else df


def token_estimate(level: str, rows: int) -> int:
    return LEVELS[level][1] * (1 if level == "exists" else rows)


@dataclass
class TokenBudget:
    """Tokens that a session may spend."""

    limit: int
    spent: int = 0

    @property
    def remaining(self) -> int:
        return max(0, self.limit - self.spent)

    @property
    def utilisation(self) -> float:
        return self.spent / self.limit if self.limit else 1.0

    def can_spend(self, n: int) -> bool:
        return n <= self.remaining

    def try_spend(self, n: int) -> bool:
        if not self.can_spend(n):
            return False
        self.spent += n
        return True


def changes_since(log: DataFrame, version: int) -> DataFrame:
    """Rows of (key, version, ts, change_type, value) after a version, in order."""
    return log.where(F.col("version") > version).orderBy("version", "key")


def state_at(log: DataFrame, version: int | None = None) -> DataFrame:
    """(key, value): the last value of each key up to a version; deleted keys aren't listed."""
    rows = log if version is None else log.where(F.col("version") <= version)
    last = rows.groupBy("key").agg(F.max_by(F.struct("change_type", "value"), "version").alias("s"))
    return last.where(F.col("s.change_type") != "delete").select("key", "s.value")


def layer_report(audit: DataFrame) -> DataFrame:
    """(layer, operations, tokens, saved, share) of an audit table (layer, tokens, full_tokens)."""
    saved = F.greatest(F.lit(0), F.col("full_tokens") - F.col("tokens"))
    g = audit.groupBy("layer").agg(F.count("*").alias("operations"), F.sum("tokens").alias("tokens"), F.sum(saved).alias("saved"))
    total = audit.agg(F.sum("full_tokens").alias("all"))
    return g.crossJoin(F.broadcast(total)).select("layer", "operations", "tokens", "saved", (F.col("saved") / F.greatest(F.lit(1), F.col("all"))).alias("share"))


def conservation(audit: DataFrame) -> DataFrame:
    """(operations, tokens, full_tokens, score, verdict): the share of tokens saved; excellent from 0.9, good 0.7, fair 0.5, poor 0.3, else wasteful."""
    g = audit.agg(F.count("*").alias("operations"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("full_tokens"), F.lit(0)).alias("full_tokens"))
    score = F.when(F.col("full_tokens") > 0, 1.0 - F.col("tokens") / F.greatest(F.lit(1), F.col("full_tokens"))).otherwise(0.0)
    s = F.col("score")
    return g.withColumn("score", F.greatest(F.lit(0.0), score)).withColumn("verdict", F.when(s >= 0.9, "excellent").when(s >= 0.7, "good").when(s >= 0.5, "fair").when(s >= 0.3, "poor").otherwise("wasteful"))


def looks_secret(text: Column) -> Column:
    """Whether a text holds a word that credentials go with."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.greatest(*[low.contains(w) for w in CREDENTIALS])


def shareable(items: DataFrame) -> DataFrame:
    """The rows of (kind, text) that may leave: patterns, statistics, mistakes and languages, and raw text without credentials."""
    return items.where(F.col("kind").isin(*SHAREABLE) | ((F.col("kind") == "raw_text") & ~looks_secret(F.col("text"))))


def content_id(*columns: str) -> Column:
    """A name for a row's content: the digest of its JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def serialise(log: DataFrame) -> DataFrame:
    """(version, json, checksum): each row of a delta log as text, with a checksum of it."""
    j = F.to_json(F.struct(*[F.col(f"`{c}`") for c in log.columns]))
    return log.select("version", j.alias("json")).withColumn("checksum", F.sha2("json", 256))


def deserialise(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The log of serialised rows; rows that don't fit their checksum are left out."""
    return rows.where(F.sha2("json", 256) == F.col("checksum")).select(F.from_json("json", schema).alias("r")).select("r.*")


#: The operation that ends a session.
SESSION_END = "session_end"


def sessions(log: DataFrame) -> DataFrame:
    """(session_id, started, last, operations, ended) of a log (session_id, timestamp, tool, summary); ended if its last row says so."""
    over = F.col("tool") == SESSION_END
    return log.groupBy("session_id").agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("last"), F.sum(F.when(over, 0).otherwise(1)).alias("operations"), F.max_by(over, "timestamp").alias("ended"))


def resume(log: DataFrame, session_id: str | None = None, n: int = 20) -> DataFrame:
    """The last n operations of a session (none: the latest one), the newest first."""
    if session_id is None:
        last = log.orderBy(F.col("timestamp").desc(), "session_id").select("session_id").first()
        session_id = last["session_id"] if last else None
    own = log.where(F.col("session_id").eqNullSafe(F.lit(session_id)) & (F.col("tool") != SESSION_END))
    return own.select("session_id", "timestamp", "tool", "summary").orderBy(F.col("timestamp").desc(), "tool").limit(n)


def operation_log(log: DataFrame, n: int = 20) -> DataFrame:
    """The last n rows of (timestamp, tool, summary), the newest first."""
    return log.orderBy(F.col("timestamp").desc(), "tool").limit(n)
