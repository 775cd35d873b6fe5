"""What the projected graph stores, and when."""

from __future__ import annotations

import glob
import os

import duckdb

from cairngraph.plans import projection


def _folders(g):
    root = g._path.removeprefix("file:")
    return {os.path.basename(p) for p in glob.glob(f"{root}/*")}, {os.path.basename(p).removeprefix("edge_type=") for p in glob.glob(f"{root}/edges/edge_type=*")}


def test_only_what_is_read_is_stored(spark, sf, tmp_path):
    """Units alone make no edges, and edges of a type no units and no later types; in whatever order, the numbers are those of the view."""
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = sorted(c.sql(projection.sql("duckdb", "edges") + " SELECT source_id, target_id, edge_type, round(weight, 9), context, edge_ord FROM edges").fetchall())
    got = lambda df: sorted((r[0], r[1], r[2], round(r[3], 9), r[4], r[5]) for r in df.select("source_id", "target_id", "edge_type", "weight", "context", "edge_ord").collect())

    a = projection.Projected(spark, sf, f"file:{tmp_path}/a")
    assert a.units.count() > 0 and _folders(a) == ({"units"}, set())
    b = projection.Projected(spark, sf, f"file:{tmp_path}/b")
    assert got(b.edges_of("calls")) == [r for r in want if r[2] == "calls"]
    assert _folders(b) == ({"lines", "calls", "edges"}, {"calls", "inherits", "implements"})
    assert b.edges_of("imports").count() == 0
    assert got(b.edges_of("ffi_binds", "tests")) == [r for r in want if r[2] in ("ffi_binds", "tests")]
    assert "units" not in _folders(b)[0]
    assert got(b.edges) == want and got(b.incoming) == want
    c = projection.Projected(spark, sf, f"file:{tmp_path}/c")
    assert got(c.edges) == want
