"""The change log as a stream: windowed activity with a watermark, sessions of an author, and running state per path.

Every query has a batch twin of the same expressions, so that a stream's result is held against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (key, ts, author, is_fix, size)
EVENTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("author", T.StringType()), T.StructField("is_fix", T.BooleanType()), T.StructField("size", T.LongType())])


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files of EVENTS."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def of_changes(changes: DataFrame) -> DataFrame:
    """A change log as EVENTS."""
    return changes.select(F.col("path").alias("key"), F.timestamp_seconds("timestamp").alias("ts"), "author", F.col("is_bugfix").alias("is_fix"), (F.col("lines_added") + F.col("lines_deleted")).cast("long").alias("size"))


def activity(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(window_start, key, n, fixes, churn) by tumbling or sliding windows; rows later than ``late`` are dropped in a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "key").agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_fix"), 1).otherwise(0)).alias("fixes"), F.sum("size").alias("churn"))
    return g.select(F.col("w.start").alias("window_start"), "key", "n", "fixes", "churn")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(author, session_start, session_end, n): runs of an author's changes without a pause of ``gap``."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "author").agg(F.count("*").alias("n"))
    return g.select("author", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without those that repeat (key, ts, author) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key", "ts", "author"])


def totals(events: DataFrame) -> DataFrame:
    """(key, n, fixes, churn): what ``running`` has come to when all events have arrived."""
    return events.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_fix"), 1).otherwise(0)).alias("fixes"), F.sum(F.coalesce("size", F.lit(0))).alias("churn"))


RUNNING = "key string, n long, fixes long, churn long"
_STATE = "n long, fixes long, churn long"


def _running(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, fixes, churn = state.get if state.exists else (0, 0, 0)
    for f in frames:
        n, fixes, churn = n + len(f), fixes + int(f["is_fix"].fillna(False).sum()), churn + int(f["size"].fillna(0).sum())
    state.update((n, fixes, churn))
    yield pd.DataFrame({"key": [key[0]], "n": [n], "fixes": [fixes], "churn": [churn]})


def running(events: DataFrame) -> DataFrame:
    """(key, n, fixes, churn) so far, for each key that a batch changes: state of three numbers per key, outside any window."""
    return events.groupBy("key").applyInPandasWithState(_running, RUNNING, _STATE, "update", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs through all that is there and stops; Parquet sinks append, others go through foreachBatch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
