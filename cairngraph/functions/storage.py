"""Where intermediate tables live: the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own on a local master, an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return _with_scheme(spark, d)
    jd = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jd.isDefined():
        return jd.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="cairn-shared-")
    atexit.register(shutil.rmtree, d, True)
    spark.sparkContext.setCheckpointDir("file://" + d)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _with_scheme(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that a path without one belongs to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Parquet tables in the shared folder that cut lineage; dropped when the operator no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """A reliable checkpoint of a small result, then the tables go; Spark's cleaner removes it with the last use."""
        kept = df.checkpoint(eager=True)
        self.drop()
        return kept
