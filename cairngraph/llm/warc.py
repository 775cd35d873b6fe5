"""Derivatives of WARC responses: a metadata record and a plain-text conversion record for each response.

Derivatives are built of SQL expressions: one scan, no shuffle, no Python; only WARC files themselves are parsed in
Python.  A derivative keeps the response's identifier
in WARC-Refers-To, its target, date, HTTP headers and payload digest; its own identifier is a name-based UUID of the
response's identifier and the record type, so a rerun gives the same records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm._shared import tune

CRAWL_DATE = "2024-01-01T00:00:00Z"
#: (pattern, replacement), in order; the same patterns mean the same in Java's and in RE2's regular expressions.
TEXT_RULES = (
    (r"(?is)<(?:script|style|noscript|template)\b.*?(?:</(?:script|style|noscript|template)[^<>]*>|\z)|<!--.*?(?:-->|\z)|<title\b[^<>]*>[^<]*", " "),
    (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|footer|header|main|aside|blockquote|pre|title|head|body|html)\b[^<>]*>", "\n"),
    (r"<[a-zA-Z/!?][^<>]*>", ""),
    (r"&nbsp;|&#160;", " "),
    (r"[ \t\r]+", " "),
    (r" ?\n[ \n]*", "\n"),
)
#: No pattern scans a text again from each of many starts: a tag ends before the next "<", what has no end ends with the text.
TITLE, LANG, LINK = r"(?is)<title[^<>]*>([^<]*)</title", r"""(?is)<html[^<>]*\blang=["']?([A-Za-z-]+)""", r"(?i)<a\b[^<>]*\bhref="
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _uuid(name: Column) -> Column:
    h = F.md5(name)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(name.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")))


def plain_text(html: Column) -> Column:
    """The text of HTML: scripts, styles, comments and the title go, block tags end a line, blanks collapse."""
    for pattern, by in TEXT_RULES:
        html = F.regexp_replace(html, pattern, by)
    for name, char in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(char))
    return F.btrim(html, F.lit(" \n"))


def responses_of_pages(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """(page_id, record_id, target_uri, date, headers, payload): each page as the payload of a response.

    A null url or html counts as empty, a null page_id stays null. Repeated rows make equal records.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    name = F.concat(F.lit("response "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), url)
    return pages.select(F.col("page_id").cast("long"), _uuid(name).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), html.alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """(page_id if given, record_type, record_id, refers_to, target_uri, date, content_type, content_length, source_headers, payload_digest, block_digest, block).

    Two rows for each response. The metadata block has warc-fields: the title, the declared language, the number of
    links and the length of the text; the conversion block is the plain text.  Defined results: a null payload or null
    headers count as empty, an empty payload has an empty text; a null target, date or page_id stays null; a null
    record_id gives null identifiers; very long payloads are read whole, in linear time; repeated responses make equal
    records; an empty table gives no rows; other columns are not read.
    """
    html = F.coalesce("payload", F.lit(""))
    title, lang = F.regexp_extract(html, TITLE, 1), F.regexp_extract(html, LANG, 1)
    links = F.size(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)))
    key = [c for c in ("page_id",) if c in responses.columns]
    base = responses.select(*key, "record_id", "target_uri", "date", F.coalesce("headers", F.lit("")).alias("headers"), F.concat(F.lit("sha256:"), F.sha2(html, 256)).alias("payload_digest"), plain_text(html).alias("text"), title.alias("title"), lang.alias("lang"), links.alias("links"))
    fields = F.concat(
        F.lit("title: "), F.regexp_replace("title", r"[ \t\r\n]+", " "), F.lit("\r\nlanguage: "), F.col("lang"), F.lit("\r\noutlinks: "), F.col("links").cast("string"),
        F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"), F.lit("\r\n"),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = base.select(*key, "record_id", "target_uri", "date", "headers", "payload_digest", F.inline(both))
    return rows.select(
        *key, "record_type", _uuid(F.concat("record_type", F.lit(" "), "record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), F.col("headers").alias("source_headers"), "payload_digest", F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("block_digest"), "block",
    )


def derivatives_of_pages(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """The derivatives of every page; see responses_of_pages and derive for nulls, empty texts and repeated rows."""
    return derive(responses_of_pages(pages, date))


# -- reading -------------------------------------------------------------------------------------------------------


class _Stream:
    """Lines and blocks of a file's bytes, of which compressed members are unpacked piece by piece."""

    def __init__(self, data: bytes):
        self.pieces, self.held = self._unpack(data), b""

    @staticmethod
    def _unpack(data: bytes) -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        while data[:2] == b"\x1f\x8b":
            one, at = zlib.decompressobj(31), 0
            while at < len(data) and not one.eof:
                try:
                    yield one.decompress(data[at : at + (1 << 20)])
                except zlib.error:
                    return
                at += 1 << 20
            data = one.unused_data + data[at:]

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\n")) < 0:
            if not self._more():
                return None
        line, self.held = self.held[:end], self.held[end + 1 :]
        return line.rstrip(b"\r")

    def block(self, size: int) -> bytes | None:
        parts, have = [self.held], len(self.held)
        while have < size and (piece := next(self.pieces, None)) is not None:
            parts.append(piece)
            have += len(piece)
        whole = b"".join(parts)
        self.held = whole[size:]
        return whole[:size] if have >= size else None


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each whole record of a WARC file, compressed or not.

    What isn't a record is skipped line by line; a record without a length, or cut short, ends the file.
    """
    stream = _Stream(data)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = head.get("content-length", "")
        block = stream.block(int(size)) if size.isdigit() else None
        if block is None:
            return
        yield head, block


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        try:
            n = int(size, 16)
        except ValueError:
            return body
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def http_parts(block: bytes) -> tuple[str, str]:
    """(status line and headers, payload as text) of an HTTP response: chunks joined, gzip unpacked, its charset or UTF-8."""
    head, _, body = block.partition(b"\r\n\r\n")
    text = head.decode("latin-1")
    low = text.lower()
    if re.search(r"(?m)^transfer-encoding:.*\bchunked\b", low):
        body = _dechunk(body)
    if re.search(r"(?m)^content-encoding:.*\bgzip\b", low):
        one = zlib.decompressobj(31)
        try:
            body = one.decompress(body)
        except zlib.error:
            body = b""
    charset = re.search(r"(?m)^content-type:.*\bcharset=\"?([\w.:-]+)", low)
    try:
        payload = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        payload = body.decode("utf-8", "replace")
    return text + "\r\n", payload.replace("\0", "")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, target_uri, date, headers, payload) of the response records of the WARC files of a path, for derive.

    A file is one task's, as its compression demands. Defined results: other records are passed over; a field that a
    record lacks is null; broken files give the records before the fault; files without responses give no rows.
    """
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "target_uri", "date", "headers", "payload"]
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in records_of(data.as_py()):
                    if head.get("warc-type") == "response":
                        rows.append((head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), *http_parts(block)))
                        size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, target_uri string, date string, headers string, payload string")


# -- writing -------------------------------------------------------------------------------------------------------


def serialise(derivatives: DataFrame) -> DataFrame:
    """(page_id, record_type, record): each derivative as a whole WARC/1.1 record, ready for a text or binary sink; a null field has no line."""
    head = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Refers-To-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit("\r\n")), F.lit("")) for k, c in head]
    key = [c for c in ("page_id",) if c in derivatives.columns]
    return derivatives.select(*key, "record_type", F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))


def _sql_uuid(name: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({name}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _quote(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")" if len(parts) > 1 else f"'{parts[0]}'"


def oracle() -> str:
    text = "payload"
    for pattern, by in TEXT_RULES:
        text = f"regexp_replace({text}, {_quote(pattern)}, {_quote(by)}, 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, {_quote(name)}, {_quote(char)})"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH r AS (
  SELECT page_id, url AS target_uri, html AS payload, {_sql_uuid("'response ' || page_id || ' ' || url")} AS record_id,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) || {crlf} AS headers
  FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)),
b AS (
  SELECT *, 'sha256:' || sha256(payload) AS payload_digest, trim({text}, ' ' || chr(10)) AS text,
         regexp_replace(regexp_extract(payload, {_quote(TITLE)}, 1), '[ \\t\\r\\n]+', ' ', 'g') AS title,
         regexp_extract(payload, {_quote(LANG)}, 1) AS lang,
         len(regexp_extract_all(payload, {_quote(LINK)})) AS links
  FROM r),
d AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'title: ' || title || {crlf} || 'language: ' || lang || {crlf} || 'outlinks: ' || links || {crlf} || 'text-length: ' || strlen(text) || {crlf} AS block FROM b
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM b)
SELECT page_id, record_type, {_sql_uuid("record_type || ' ' || record_id")} AS record_id, record_id AS refers_to, target_uri, '{CRAWL_DATE}' AS date, content_type,
       strlen(block) AS content_length, headers AS source_headers, payload_digest, 'sha256:' || sha256(block) AS block_digest, block
FROM d"""
