"""The star schema of the test tables seen as a graph: one SQL text that Spark and DuckDB both read.

Every row of every table is a unit or part of one, and every line item becomes an edge: by its return flag a test of a
part by an order, a part's use of a supplier, or a call of the part in the order's next line (of the last line, a
breakage); the other columns give attributes.  Parts inherit within their brand and type along a heap (from the part of
half the rank) and implement its first part; calls between parts of different languages are foreign bindings.

``graph(spark, sf_dir)`` builds the tables once per session and input and stores them in the shared folder, each when it
is first asked for: the units, and the edges by types, so that a query shuffles no table that it doesn't read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.functions import schema as S
from cairngraph.functions.storage import shared_dir
from cairngraph.graph import CodeGraph

_LANGS = ("Python", "Rust", "TypeScript", "JavaScript", "Go", "C++", "Java", "C#")


def _lang(key: str) -> str:
    return f"CASE {key} % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LANGS)) + " END"


CTES = {
    "part_stats": """SELECT l_partkey AS k, CAST(count(*) AS INT) AS n,
        CAST(floor(1e2 * CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS DOUBLE) / 1e2 AS stab FROM lineitem GROUP BY l_partkey""",
    "supp_stats": "SELECT l_suppkey AS k, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY l_suppkey",
    "cust_stats": "SELECT o_custkey AS k, CAST(count(*) AS INT) AS n FROM orders GROUP BY o_custkey",
    "units": f"""
      SELECT CAST(r_regionkey AS BIGINT) AS id, 'module' AS unit_type, 'Python' AS language, r_name AS name, r_name AS qualified_name, r_name AS file_path, 1 AS start_line, 500 AS end_line,
             CAST(NULL AS STRING) AS signature, CAST(NULL AS STRING) AS doc_summary, 'public' AS visibility, 0 AS complexity, false AS is_async, 0 AS change_count, 1e0 AS stability_score FROM region
      UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), 'module', {_lang("n_nationkey")}, n_name, concat(r_name, '.', n_name), r_name, 1, 200,
             NULL, concat('Module of ', n_name), 'internal', 0, false, 0, 1e0 FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 1000000 + s_suppkey, 'type', {_lang("s_suppkey")}, s_name, concat(n_name, '.', s_name), concat(n_name, '/suppliers'), 1, 40,
             NULL, NULL, 'private', 0, false, coalesce(n, 0), CASE WHEN s_acctbal < 0 THEN 25e-2 ELSE 75e-2 END FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN supp_stats ON k = s_suppkey
      UNION ALL SELECT 10000000 + c_custkey, 'impl', {_lang("c_custkey")}, c_name, concat(n_name, '.', c_name), concat(n_name, '/customers'), 1, 20,
             NULL, NULL, 'private', 0, false, coalesce(n, 0), 1e0 FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN cust_stats ON k = c_custkey
      UNION ALL SELECT 100000000 + p_partkey, CASE WHEN p_partkey % 23 = 0 THEN 'trait' ELSE 'function' END, {_lang("p_partkey")}, replace(p_name, ' ', '_'), concat(p_brand, '.', p_type, '.', replace(p_name, ' ', '_')), concat(p_brand, '/', p_type),
             CAST(p_partkey % 500 AS INT) + 1, CAST(p_partkey % 500 AS INT) + 1 + CAST(p_size AS INT), CASE WHEN p_partkey % 6 = 0 THEN concat('fn ', replace(p_name, ' ', '_'), '(size)') END,
             CASE WHEN p_partkey % 5 = 0 THEN concat('Builds ', p_name, ' parts.') END, CASE p_partkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'internal' END,
             CAST(p_size AS INT), p_partkey % 4 = 0, coalesce(n, 0), coalesce(stab, 1e0) FROM part LEFT JOIN part_stats ON k = p_partkey
      UNION ALL SELECT 1000000000 + o_orderkey, 'test', 'Python', concat('test_', CAST(o_orderkey AS STRING)), concat('tests.test_', CAST(o_orderkey AS STRING)), concat('tests/', o_orderpriority), 1, 10,
             NULL, NULL, 'unknown', 0, false, 0, 1e0 FROM orders""",
    "brand_parts": """SELECT p_partkey AS k, p_brand AS brand, p_type AS type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS first FROM part""",
    "order_parts": "SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem",
    "lines": "SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag, l_linenumber AS n, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS following FROM lineitem",
    "calls": "SELECT p AS s, following AS t, CAST(min(10 * n) AS INT) AS line FROM lines WHERE flag = 'R' AND following <> p GROUP BY p, following",
    "pairs": "SELECT a.p AS s, b.p AS t, count(*) AS n FROM order_parts a JOIN order_parts b ON a.o = b.o WHERE a.p < b.p GROUP BY a.p, b.p HAVING count(*) >= 2",
    "edge_rows": """
      SELECT CAST(n_regionkey AS BIGINT) AS source_id, CAST(1000 + n_nationkey AS BIGINT) AS target_id, 'contains' AS edge_type, 1e0 AS weight, 0 AS context, 6 AS code FROM nation
      UNION ALL SELECT CAST(1000 + s_nationkey AS BIGINT), 1000000 + s_suppkey, 'contains', 1e0, 0, 6 FROM supplier
      UNION ALL SELECT CAST(1000 + c_nationkey AS BIGINT), 10000000 + c_custkey, 'contains', 1e0, 0, 6 FROM customer
      UNION ALL SELECT 100000000 + s, 100000000 + t, 'calls', 1e0, line, 1 FROM calls
      UNION ALL SELECT DISTINCT 100000000 + p, 1000000 + s, 'uses_type', 1e0, 0, 16 FROM lines WHERE flag = 'N'
      UNION ALL SELECT DISTINCT 1000000000 + o, 100000000 + p, 'tests', 1e0, 0, 8 FROM lines WHERE flag = 'A'
      UNION ALL SELECT 100000000 + s, 100000000 + t, 'couples_with', CAST(pairs.n AS DOUBLE) / CAST(greatest(x.n, y.n) AS DOUBLE), 0, 11 FROM pairs JOIN part_stats x ON x.k = s JOIN part_stats y ON y.k = t
      UNION ALL SELECT 100000000 + a.k, 100000000 + b.k, 'inherits', 1e0, 0, 3 FROM brand_parts a JOIN brand_parts b ON a.brand = b.brand AND a.type = b.type AND a.r - a.r % 2 = 2 * b.r
      UNION ALL SELECT 100000000 + k, 100000000 + first, 'implements', 1e0, 0, 4 FROM brand_parts WHERE first <> k
      UNION ALL SELECT DISTINCT 1000000 + s, 100000000 + p, 'breaks_with', 1e0, 0, 12 FROM lines WHERE flag = 'R' AND (following IS NULL OR following = p)
      UNION ALL SELECT 100000000 + s, 100000000 + t, 'ffi_binds', 1e0, 0, 15 FROM calls WHERE s % 8 <> t % 8
      UNION ALL SELECT 100000000 + p_partkey, 100000000 + CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT), 'version_of', 1e0, 0, 14 FROM part WHERE p_partkey > 0""",
    "edges": "SELECT source_id, target_id, edge_type, weight, context, row_number() OVER (PARTITION BY source_id, target_id ORDER BY code) AS edge_ord FROM edge_rows",
    "changes": """SELECT DISTINCT concat('part/', CAST(l_partkey AS STRING)) AS path, CASE WHEN l_linestatus = 'F' THEN 'modify' ELSE 'add' END AS change_type, CAST(l_orderkey AS STRING) AS commit_id,
        CAST({epoch} AS BIGINT) AS timestamp, concat('dev', CAST(l_suppkey AS STRING)) AS author, l_returnflag = 'R' AS is_bugfix, CAST(l_quantity AS INT) AS lines_added,
        CAST(floor(l_discount * 100 + 5e-1) AS INT) AS lines_deleted FROM lineitem""",
}
_EPOCH = {"spark": "unix_timestamp(l_shipdate)", "duckdb": "epoch(l_shipdate)"}


#: Views that Spark makes another way, with the same rows: an order's parts are gathered where its lines are sorted, so pairs
#: need no join; ``parts`` stands on an order's first line.
SPARK = CTES | {
    "lines": """SELECT o, p, s, flag, n, following, CASE WHEN no = 1 AND o IS NOT NULL THEN parts END AS parts FROM (
        SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag, l_linenumber AS n, lead(l_partkey) OVER w AS following, row_number() OVER w AS no, collect_set(l_partkey) OVER (PARTITION BY l_orderkey) AS parts
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) x""",
    "pairs": """SELECT s, t, count(*) AS n FROM (SELECT s, explode(filter(parts, x -> x > s)) AS t FROM (SELECT parts, explode(parts) AS s FROM lines WHERE size(parts) > 1) a) b
        GROUP BY s, t HAVING count(*) >= 2""",
}
#: Edge types that are stored together: those that can share both ends with others are numbered by one window, the later of
#: them only where they are asked for, as no earlier one's number depends on them.
EARLY, LATE = ("calls", "inherits", "implements"), ("couples_with", "version_of", "ffi_binds")
ALONE = ("contains", "uses_type", "tests", "breaks_with")


def _rows(kinds: Iterable[str]) -> str:
    """The parts of the view edge_rows that make edges of the given types."""
    parts = [b for b in CTES["edge_rows"].split("UNION ALL") if any(f"'{k}'" in b for k in kinds)]
    return " UNION ALL ".join(f"SELECT * FROM ({b.strip()}) x (source_id, target_id, edge_type, weight, context, code)" for b in parts)


def sql(dialect: str, *names: str, stored: tuple[str, ...] = (), more: dict[str, str] | None = None) -> str:
    """A WITH clause of the named views, of which ``more`` has further ones, and all they build on but the stored ones."""
    need: list[str] = []
    texts = (SPARK if dialect == "spark" else CTES) | (more or {})

    def visit(n: str) -> None:
        if n in need or n in stored:
            return
        for other in texts:
            if other != n and other in texts[n].replace("(", " ").replace(",", " ").replace(")", " ").split():
                visit(other)
        need.append(n)

    for n in names:
        visit(n)
    text = "WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in need)
    text = text.replace("{epoch}", _EPOCH[dialect])
    return text if dialect == "spark" else text.replace("AS STRING", "AS VARCHAR")


def view(spark: SparkSession, sf_dir: str, name: str, stored: dict[str, DataFrame] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """One of the views as a DataFrame over the tables of sf_dir, and over other views that are stored already."""
    text = sql("spark", name, stored=tuple(stored or ()), more=more) + f"\nSELECT * FROM {name}"
    frames = dict(stored or {})
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for t, df in frames.items():
        df.createOrReplaceTempView(f"cairn_{t}")
        text = _replace_word(text, t, f"cairn_{t}")
    return spark.sql(text)


def _replace_word(text: str, word: str, by: str) -> str:
    return re.sub(rf"\b{word}\.", f"{by}.", re.sub(rf"\b(FROM|JOIN) {word}\b", rf"\1 {by}", text))


def _complete(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    more = {n: F.lit(defaults.get(n)).cast(schema[n].dataType) for n in schema.fieldNames() if n not in df.columns}
    return df.withColumns(more).select(*[F.col(n).cast(schema[n].dataType) for n in schema.fieldNames()])


class Projected(CodeGraph):
    """The projected graph; units, edges by groups of types, and the reversed edges are stored when they are first read."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str):
        self._spark, self._sf_dir, self._path, self._done, self._units = spark, sf_dir, path, set(), None

    def with_units(self, units: DataFrame) -> Projected:
        other = copy(self)
        other._units = units
        return other

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def units(self) -> DataFrame:
        if self._units is not None:
            return self._units
        if "units" not in self._done:
            u = _complete(view(self._spark, self._sf_dir, "units"), S.UNITS, S.DEFAULTS)
            u.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self._path}/units")
            self._done.add("units")
        return self._spark.read.schema(S.UNITS).parquet(f"{self._path}/units")

    @property
    def edges(self) -> DataFrame:
        return self.edges_of()

    @property
    def incoming(self) -> DataFrame:
        if "reversed" not in self._done:
            e = self.edges.repartitionByRange("edge_type", "target_id").sortWithinPartitions("edge_type", "target_id")
            e.write.partitionBy("edge_type").parquet(f"{self._path}/reversed")
            self._done.add("reversed")
        return self._spark.read.schema(S.EDGES).parquet(f"{self._path}/reversed").select(*S.EDGES.fieldNames())

    def edges_of(self, *kinds: str) -> DataFrame:
        """All edges, or those of the given types; no others are read, or made unless they are numbered with them."""
        kinds = [k for k in EARLY + LATE + ALONE if not kinds or k in kinds]
        if not kinds:
            return self._spark.createDataFrame([], S.EDGES)
        need = {k for k in kinds if k in ALONE}
        need |= set(EARLY + LATE) if set(kinds) & set(LATE) else set(EARLY) if set(kinds) & set(EARLY) else set()
        if need - self._done:
            self._store(need - self._done)
        paths = [p for k in kinds if self._stored(p := f"{self._path}/edges/edge_type={k}")]
        if not paths:
            return self._spark.createDataFrame([], S.EDGES)
        return self._spark.read.schema(S.EDGES).option("basePath", f"{self._path}/edges").parquet(*paths).select(*S.EDGES.fieldNames())

    def _stored(self, path: str) -> bool:
        p = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _view(self, name: str) -> DataFrame:
        """lines, calls and pairs, that several edge types are made of, stored once."""
        path = f"{self._path}/{name}"
        if name not in self._done:
            made = {n: self._view(n) for n in ("lines",) if n != name}
            view(self._spark, self._sf_dir, name, made).write.parquet(path)
            self._done.add(name)
        return self._spark.read.parquet(path)

    def _store(self, kinds: set[str]) -> None:
        need = [n for n, of in (("lines", {"uses_type", "tests", "breaks_with"}), ("calls", {"calls", "ffi_binds"}), ("pairs", {"couples_with"})) if kinds & of]
        made = {n: self._view(n) for n in need}
        numbered = kinds & set(EARLY + LATE) | (set(EARLY) if kinds & set(LATE) else set())
        if "calls" in numbered:
            made["calls"] = self._view("calls")
        for group in (numbered, kinds & set(ALONE)):
            if not group:
                continue
            e = view(self._spark, self._sf_dir, "some_edges", made, {"some_edges": _rows(sorted(group))}).repartitionByRange("source_id")
            number = F.expr("row_number() over (partition by source_id, target_id order by code)") if group is numbered else F.lit(1)
            e = _complete(e.withColumn("edge_ord", number), S.EDGES, S.EDGE_DEFAULTS).where(F.col("edge_type").isin(*kinds))
            e.sortWithinPartitions("edge_type", "source_id").write.mode("append").partitionBy("edge_type").parquet(f"{self._path}/edges")
        self._done |= kinds


_built: dict[tuple, object] = {}


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The projected graph, each of its tables stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Projected(spark, sf_dir, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}")
    return _built[key]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projected change log, stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "changes")
    if key not in _built:
        path = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
        view(spark, sf_dir, "changes").selectExpr("*", "cast(null as string) as old_path").write.parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])
