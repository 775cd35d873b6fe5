"""Registered queries of the graph engine and their SQL."""

from __future__ import annotations

from functools import cache

from cairngraph.plans import analytics, core, extra, streams
from cairngraph.plans.registry import Query, Registry


@cache
def registry() -> Registry:
    r = Registry()
    for module in (core, analytics, extra, streams):
        module.register(r)
    return r


def queries() -> dict[str, Query]:
    return dict(registry().queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry().oracles)
