"""A graph as two DataFrames, with validation, storage and lookups."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.functions import schema as S
from cairngraph.functions.storage import Scratch


def has_reversed(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/reversed")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass
class CodeGraph:
    """``units`` and ``edges``; see functions.schema for their columns. Extra columns are kept and not read."""

    units: DataFrame
    edges: DataFrame
    #: The same edges, stored by their targets; None where they aren't stored.
    incoming: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.units.sparkSession

    def with_units(self, units: DataFrame) -> CodeGraph:
        """The same edges between other units."""
        return CodeGraph(units, self.edges, self.incoming)

    # construction

    @staticmethod
    def empty(spark: SparkSession) -> CodeGraph:
        return CodeGraph(spark.createDataFrame([], S.UNITS), spark.createDataFrame([], S.EDGES))

    @staticmethod
    def of_rows(spark: SparkSession, units: Iterable[dict], edges: Iterable[tuple]) -> CodeGraph:
        """Units from dicts (missing columns take their defaults) and edges from (source, target, type[, weight[, context]])."""
        names = S.UNITS.fieldNames()
        rows = [tuple((S.DEFAULTS | u).get(n) for n in names) for u in units]
        seen: dict[tuple, int] = {}
        out = []
        for e in edges:
            s, t, kind, w, c = (*e, 1.0, 0)[:5] if len(e) == 3 else (*e, 0)[:5]
            seen[s, t] = seen.get((s, t), 0) + 1
            out.append((s, t, kind, float(min(1.0, max(0.0, w))), 0, c, seen[s, t]))
        return CodeGraph(spark.createDataFrame(rows, S.UNITS), spark.createDataFrame(out, S.EDGES))

    def rejected_edges(self, max_out: int | None = S.MAX_OUT_EDGES) -> DataFrame:
        """Edges that a graph can't have, with the reason: self, missing endpoint, more than ``max_out`` of a unit (None: any number)."""
        ids = self.units.select("id")
        no = F.row_number().over(Window.partitionBy("source_id").orderBy("edge_ord", "target_id", "edge_type")) if max_out is not None else F.lit(0)
        e = self.edges.withColumn("out_no", no)
        e = e.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source")), "source_id", "left")
        e = e.join(ids.select(F.col("id").alias("target_id"), F.lit(True).alias("has_target")), "target_id", "left")
        reason = (
            F.when(F.col("source_id") == F.col("target_id"), "self_edge")
            .when(F.col("has_source").isNull() | F.col("has_target").isNull(), "missing_endpoint")
            .when(F.col("out_no") > (max_out or 0), "too_many_edges")
        )
        return e.withColumn("reason", reason).where("reason is not null").select(*self.edges.columns, "reason")

    def build(self, strict: bool = True, max_out: int | None = S.MAX_OUT_EDGES) -> CodeGraph:
        """The graph of its valid edges; strict raises if there are others."""
        bad = self.rejected_edges(max_out)
        if strict and (first := bad.first()) is not None:
            raise S.InvalidEdge(f"{first['source_id']} -> {first['target_id']}: {first['reason']}")
        keys = ["source_id", "target_id", "edge_type", "edge_ord"]
        return CodeGraph(self.units, self.edges.join(bad.select(*keys), keys, "left_anti"))

    @staticmethod
    def assign_ids(raw: DataFrame, *keys: str) -> DataFrame:
        """Dense ids from 0 in the order of a stable key: partition sizes are counted, then added up."""
        ordered = raw.orderBy(*keys).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
        ordered = Scratch(raw.sparkSession).keep(ordered)
        sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
        base = sizes.select("part", "low", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
        return ordered.join(F.broadcast(base), "part").select((F.col("base") + F.col("at") - F.col("low")).alias("id"), *raw.columns)

    # storage

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """units/ by ranges of ids, edges/ by type and ranges of sources, reversed/ by type and ranges of targets, so that either
        direction prunes files; no type is one task's. Both tables are computed once, into the shared folder, as the ranges
        are sampled before they are sorted."""
        scratch = Scratch(self.spark)
        units, edges = scratch.table(self.units, "units"), scratch.table(self.edges.select(*S.EDGES.fieldNames()), "edges")
        units.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(f"{path}/units")
        for name, end in (("edges", "source_id"), ("reversed", "target_id")):
            edges.repartitionByRange("edge_type", end).sortWithinPartitions("edge_type", end).write.mode(mode).partitionBy("edge_type").parquet(f"{path}/{name}")
        scratch.drop()
        n_units, n_edges = self.spark.read.parquet(f"{path}/units").count(), self.spark.read.parquet(f"{path}/edges").count()
        meta = self.spark.createDataFrame([(S.SCHEMA_VERSION, n_units, n_edges)], "schema_version int, n_units long, n_edges long")
        meta.coalesce(1).write.mode(mode).json(f"{path}/meta")

    @staticmethod
    def info(spark: SparkSession, path: str) -> dict[str, int]:
        """schema_version, n_units, n_edges and bytes of a stored graph, without reading it."""
        meta = spark.read.schema("schema_version int, n_units long, n_edges long").json(f"{path}/meta").first()
        if meta is None or meta["schema_version"] is None:
            raise S.StorageError(f"no graph is stored in {path}")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
        return {**meta.asDict(), "bytes": size}

    @staticmethod
    def load(spark: SparkSession, path: str, policy: str = "auto") -> CodeGraph:
        """A stored graph. A later version than this engine's is an error; an earlier one is read with defaults for what it
        lacks (policy "auto") or is an error ("strict"); "off" doesn't look at the version."""
        if policy not in ("auto", "strict", "off"):
            raise S.QueryError(f"unknown policy {policy}")
        if policy != "off":
            version = CodeGraph.info(spark, path)["schema_version"]
            if version > S.SCHEMA_VERSION or version < S.SCHEMA_VERSION and policy == "strict":
                raise S.StorageError(f"version {version} of {path} isn't {S.SCHEMA_VERSION}")

        def full(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
            more = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in schema if f.name not in df.columns}
            return df.withColumns(more) if more else df

        edges = full(spark.read.parquet(f"{path}/edges"), S.EDGES, S.EDGE_DEFAULTS).select(*S.EDGES.fieldNames())
        g = CodeGraph(full(spark.read.parquet(f"{path}/units"), S.UNITS, S.DEFAULTS), edges)
        if has_reversed(spark, path):
            g.incoming = full(spark.read.parquet(f"{path}/reversed"), S.EDGES, S.EDGE_DEFAULTS).select(*S.EDGES.fieldNames())
        return g

    def to_json(self) -> DataFrame:
        """(kind, json): a row for each unit (7 columns) and edge (4 columns), for a text sink."""
        u = self.units.select(F.lit("unit").alias("kind"), F.to_json(F.struct("id", "unit_type", "name", "qualified_name", "file_path", "language", "complexity")).alias("json"))
        e = self.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source_id", "target_id", "edge_type", "weight")).alias("json"))
        return u.unionByName(e)

    @staticmethod
    def of_json(rows: DataFrame) -> CodeGraph:
        """The inverse of to_json; columns that it lacks take their defaults."""
        u = rows.where("kind = 'unit'").select(F.from_json("json", S.UNITS).alias("u")).select("u.*").na.fill(S.DEFAULTS)
        e = rows.where("kind = 'edge'").select(F.from_json("json", S.EDGES).alias("e")).select("e.*").na.fill(S.EDGE_DEFAULTS)
        return CodeGraph(u, e)

    # lookups

    def require(self, *ids: int) -> None:
        """Raises UnitNotFound unless every id is a unit's."""
        found = {r["id"] for r in self.units.where(F.col("id").isin(list(ids))).select("id").collect()}
        if missing := [i for i in ids if i not in found]:
            raise S.UnitNotFound(", ".join(map(str, missing)))

    def get(self, unit_id: int) -> DataFrame:
        return self.units.where(F.col("id") == unit_id)

    def edges_of(self, *kinds: str) -> DataFrame:
        """All edges, or those of the given types."""
        return self.edges.where(F.col("edge_type").isin(*kinds)) if kinds else self.edges

    def edges_from(self, unit_id: int, *kinds: str) -> DataFrame:
        return self.edges_of(*kinds).where(F.col("source_id") == unit_id)

    def edges_to(self, unit_id: int, *kinds: str) -> DataFrame:
        back = self.edges if self.incoming is None else self.incoming
        return (back.where(F.col("edge_type").isin(*kinds)) if kinds else back).where(F.col("target_id") == unit_id)

    def has_edge(self, source: int, target: int, kind: str) -> bool:
        return not self.edges_from(source, kind).where(F.col("target_id") == target).isEmpty()

    def in_degree(self, *kinds: str, name: str = "n") -> DataFrame:
        """(id, n): incoming edges of each unit that has any."""
        return self.edges_of(*kinds).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias(name))

    def out_degree(self, *kinds: str, name: str = "n") -> DataFrame:
        return self.edges_of(*kinds).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias(name))

    def degree(self, *kinds: str, name: str = "n") -> DataFrame:
        """(id, n): incoming and outgoing edges of each unit that has any."""
        e = self.edges_of(*kinds)
        ends = e.select(F.explode(F.array("source_id", "target_id")).alias("id"))
        return ends.groupBy("id").agg(F.count("*").alias(name))

    def stats(self) -> DataFrame:
        """(kind, label, n): units by type and by language and edges by type, one pass over each table."""
        u = self.units.groupingSets([["unit_type"], ["language"], []], "unit_type", "language").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        u = u.select(F.when(F.col("g") == 1, "unit_type").when(F.col("g") == 2, "language").otherwise("units").alias("kind"), F.coalesce("unit_type", "language", F.lit("all")).alias("label"), "n")
        e = self.edges.groupingSets([["edge_type"], []], "edge_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        e = e.select(F.when(F.col("g") == 0, "edge_type").otherwise("edges").alias("kind"), F.coalesce("edge_type", F.lit("all")).alias("label"), "n")
        return u.unionByName(e)

    def list_units(self, unit_type: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        u = self.units.where(F.col("unit_type") == unit_type) if unit_type else self.units
        return u.orderBy("id").offset(offset).limit(limit)

    def detail(self, *ids: int) -> DataFrame:
        """(id, direction, edge_type, other_id, other_name): the edges of the given units, or of all."""
        names = self.units.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
        out = self.edges.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "edge_type", F.col("target_id").alias("other_id"))
        inc = self.edges.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "edge_type", F.col("source_id").alias("other_id"))
        both = out.unionByName(inc)
        return (both.where(F.col("id").isin(*ids)) if ids else both).join(names, "other_id").select("id", "direction", "edge_type", "other_id", "other_name")
