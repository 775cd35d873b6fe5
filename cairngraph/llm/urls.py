"""URL filter: sorted arrays of 64-bit xxhash digests, memory-mapped and probed by vectorised binary search.

A rule is a domain (it covers its subdomains) or a URL without its scheme, query and fragment (it covers itself and
what lies below it).  A URL's keys are all names and paths that a rule could have; a digest that is carried along the
path gives all of them in one pass.  Keys found among the digests are confirmed against the stored strings, so digests
that collide don't block anything.  The longest confirmed rule counts.

Rules are a table or a list of any length: Spark sorts their digests, tasks pack ranges of them into files, and workers
map the files into memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm._shared import local_file, open_arrays, pack_arrays, publish, tune

#: Domains of advertising, betting, pharmacy, adult and link-farm sites, rules of the registered query.
BLOCKED = tuple(sorted(f"{name}.example.{tld}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org")))
#: Rules of one file; seed of the digests (that of Spark's own function); longest name that the domain system has.
SHARD_RULES, SEED, NAME = 1_000_000, 42, 253
_URL = re.compile(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)")
_open: dict[str, DigestArray] = {}


def _parts(url: str | None) -> tuple[str, str]:
    """(host, path) without what doesn't count; both empty for a null or relative URL."""
    m = _URL.match(url or "")
    host = m[1].lower().strip(".") if m else ""
    return (host, m[2].rstrip("/")) if host else ("", "")


def address(url: str | None) -> str | None:
    """The rule that covers just the URL and what lies below it."""
    return "".join(_parts(url)) or None


def keys_of(url: str | None) -> list[tuple[int, int, int, str]]:
    """(digest, first, end, whole) of all rules whole[first:end] that would cover the URL, the longest first.

    None for a null or relative URL; a host longer than a domain name can be stands for itself only.
    """
    host, path = _parts(url)
    if not host:
        return []
    whole, out = host + path, []
    h, at = xxhash.xxh64(host, seed=SEED), len(host)
    while at < len(whole):
        end = whole.find("/", at + 1)
        end = len(whole) if end < 0 else end
        h.update(whole[at:end])
        if whole[end - 1] != "/":
            out.append((h.intdigest(), 0, end, whole))
        at = end
    out.reverse()
    first = 0
    while True:
        out.append((xxhash.xxh64_intdigest(whole[first : len(host)], seed=SEED), first, len(host), whole))
        first = host.find(".", first) + 1
        if not first or len(host) > NAME:
            return out


def pack(rules: list[str], digests: np.ndarray) -> bytes:
    """The file of rules in the order of their digests."""
    strings = [r.encode() for r in rules]
    return pack_arrays(digests=digests, offsets=np.cumsum([0, *map(len, strings)]).astype(np.int64), strings=np.frombuffer(b"".join(strings), np.uint8))


class DigestArray:
    """A packed file of rules, memory-mapped."""

    def __init__(self, path: str):
        a = open_arrays(path)
        self.digests, self.offsets, self.strings = a["digests"], a["offsets"], a["strings"]

    def contains(self, digests: np.ndarray, own: list[tuple[int, int, str]]) -> np.ndarray:
        """Whether each whole[first:end], of (first, end, whole), is a rule; only those whose digest is found are cut out."""
        out = np.zeros(len(digests), bool)
        low, high = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        for k in np.flatnonzero(high > low).tolist():
            first, end, whole = own[k]
            key = whole[first:end].encode()
            out[k] = any(bytes(self.strings[self.offsets[i] : self.offsets[i + 1]]) == key for i in range(low[k], high[k]))
        return out


def _array(handle: str) -> DigestArray:
    if handle not in _open:
        _open[handle] = DigestArray(local_file(handle))
    return _open[handle]


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, digests = [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(rules, np.array(digests, np.int64))], pa.large_binary())], names=["file"])

        for batch in batches:
            digests += batch.column(0).to_pylist()
            rules += batch.column(1).to_pylist()
            if len(rules) >= limit:
                yield flush()
                rules, digests = [], []
        if rules:
            yield flush()

    return run


def publish_rules(spark: SparkSession, rules: DataFrame | Iterable[str], limit: int = SHARD_RULES) -> list[str]:
    """Sorts and packs rules (a table's first column, or strings) and publishes the files, one at a time; blank ones don't count."""
    if isinstance(rules, DataFrame):
        table = rules.select(F.col(f"`{rules.columns[0]}`").alias("rule"))
    else:
        table = spark.createDataFrame([(r,) for r in rules], "rule string")
    table = table.select(F.trim("rule").alias("rule")).where("rule <> ''").distinct().select(F.xxhash64("rule").alias("digest"), "rule").orderBy("digest", "rule")
    return [publish(spark, "rules", bytes(r["file"])) for r in table.mapInArrow(_shards(limit), "file binary").toLocalIterator()]


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[str] = BLOCKED, limit: int = SHARD_RULES) -> DataFrame:
    """(page_id, url, rule, blocked) of every row of pages; rule is null where none covers the URL.

    Defined results: a null, empty or relative URL is never blocked; case counts in paths, not in hosts; user, port,
    query, fragment and a trailing slash don't count; very long URLs take time in proportion to their length; of
    several rules the longest counts; repeated rows are decided alike; null and repeated rules don't matter; no rules
    block nothing; an empty table gives no rows; other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    tune(spark)
    handles = publish_rules(spark, rules, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_url = [keys_of(u) for u in batch.column(1).to_pylist()]
            flat = [k for keys in per_url for k in keys]
            digests = np.array([k[0] for k in flat], np.uint64).view(np.int64)
            own = [k[1:] for k in flat]
            hit = np.zeros(len(flat), bool)
            for handle in handles:
                hit |= _array(handle).contains(digests, own)
            rule: list[str | None] = [None] * len(per_url)
            row = np.repeat(np.arange(len(per_url)), [len(k) for k in per_url])
            for k in np.flatnonzero(hit)[::-1].tolist():  # the longest is each URL's first and is set last
                first, end, whole = own[k]
                rule[row[k]] = whole[first:end]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rule, pa.string()), pa.array([r is not None for r in rule], pa.bool_())], names=["page_id", "url", "rule", "blocked"])

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, "page_id long, url string, rule string, blocked boolean")


def delivered(pages: DataFrame) -> DataFrame:
    """(rule): the addresses that a feed has delivered, as rules."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)", 1)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)", 2)
    return pages.where(F.col("url").contains("utm_source=feed")).select(F.concat(F.lower(host), F.regexp_replace(path, "/+$", "")).alias("rule")).where("rule <> ''")


def filter_seen_and_blocked(pages: DataFrame) -> DataFrame:
    """filter_urls by the blocked domains and by the addresses that a feed has delivered."""
    rules = pages.sparkSession.createDataFrame([(r,) for r in BLOCKED], "rule string").unionByName(delivered(pages))
    return filter_urls(pages, rules)


def oracle() -> str:
    """The same as filter_seen_and_blocked."""
    values = ", ".join(f"('{r}')" for r in BLOCKED)
    return f"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(?::[0-9]*)?([^?#]*)', 1), '/+$', '') AS path FROM pages),
rules(rule) AS (SELECT * FROM (VALUES {values}) v UNION SELECT host || path FROM p WHERE contains(url, 'utm_source=feed') AND host || path <> ''),
m AS (SELECT p.page_id, p.url, max_by(r.rule, strlen(r.rule)) AS rule FROM p LEFT JOIN rules r
      ON p.host = r.rule OR ends_with(p.host, '.' || r.rule) OR p.host || p.path = r.rule OR (contains(r.rule, '/') AND starts_with(p.host || p.path, r.rule || '/')) GROUP BY p.page_id, p.url)
SELECT page_id, url, rule, rule IS NOT NULL AS blocked FROM m"""
