"""Schemas, closed vocabularies and errors of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

UNIT_TYPES = ("module", "symbol", "type", "function", "parameter", "import", "test", "doc", "config", "pattern", "trait", "impl", "macro")
CALLABLE = ("function", "macro")
CONTAINER = ("module", "type", "trait", "impl")
EDGE_TYPES = (
    "calls", "imports", "inherits", "implements", "overrides", "contains", "references", "tests", "documents",
    "configures", "couples_with", "breaks_with", "pattern_of", "version_of", "ffi_binds", "uses_type", "returns", "param_type",
)
DEPENDENCY = ("calls", "imports", "inherits", "implements", "uses_type", "ffi_binds")
TEMPORAL = ("couples_with", "breaks_with", "version_of")
VISIBILITY = ("public", "private", "internal", "protected", "unknown")
LANGUAGES = ("Python", "Rust", "TypeScript", "JavaScript", "Go", "C++", "Java", "C#", "Unknown")
EXTENSIONS = {
    "py": "Python", "pyi": "Python", "rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "go": "Go", "cpp": "C++", "cc": "C++", "cxx": "C++", "c": "C++", "h": "C++", "hpp": "C++", "hxx": "C++", "java": "Java", "cs": "C#",
}
#: Version of stored graphs.
SCHEMA_VERSION = 2
#: Out-edges that one unit may have.
MAX_OUT_EDGES = 16_384

_L, _S, _I, _D, _B = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
UNITS = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("id", _L), ("unit_type", _S), ("language", _S), ("name", _S), ("qualified_name", _S), ("file_path", _S), ("start_line", _I), ("start_col", _I), ("end_line", _I), ("end_col", _I),
            ("signature", _S), ("doc_summary", _S), ("visibility", _S), ("complexity", _I), ("is_async", _B), ("is_generator", _B), ("created_at", _L), ("last_modified", _L),
            ("change_count", _I), ("stability_score", _D), ("collective_usage", _L), ("content_hash", _S),
        )
    ]
)
EDGES = T.StructType([T.StructField(n, t) for n, t in (("source_id", _L), ("target_id", _L), ("edge_type", _S), ("weight", _D), ("created_at", _L), ("context", _I), ("edge_ord", _L))])
CHANGES = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (("path", _S), ("change_type", _S), ("commit_id", _S), ("timestamp", _L), ("author", _S), ("is_bugfix", _B), ("lines_added", _I), ("lines_deleted", _I), ("old_path", _S))
    ]
)
#: What a unit has where its source says nothing.
DEFAULTS = {
    "language": "Unknown", "start_line": 0, "start_col": 0, "end_line": 0, "end_col": 0, "visibility": "unknown", "complexity": 0, "is_async": False, "is_generator": False,
    "created_at": 0, "last_modified": 0, "change_count": 0, "stability_score": 1.0, "collective_usage": 0,
}
EDGE_DEFAULTS = {"weight": 1.0, "created_at": 0, "context": 0, "edge_ord": 1}


class GraphError(Exception):
    """Base of the engine's errors."""


class UnitNotFound(GraphError):
    """No unit has the given id."""


class InvalidEdge(GraphError):
    """A self-edge, an edge to a unit that doesn't exist, or one too many of a unit."""


class PathNotFound(GraphError):
    """No path leads from one unit to the other."""


class DimensionMismatch(GraphError):
    """Vectors of different dimensions, or an empty query vector."""


class QueryError(GraphError):
    """A query that can't be understood."""


class StorageError(GraphError):
    """A stored graph that isn't there or is of a version that can't be read."""


class DepthExceeded(GraphError):
    """A driver-side walk met more units than its caller allows."""
