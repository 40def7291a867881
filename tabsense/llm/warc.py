"""Metadata and plain-text records derived from web responses.

A response gives two records that refer to it: ``metadata`` (title, language, links) and
``conversion`` (the text). Record ids are derived from the response's id, so a second run
gives the same records; the response's target, date, HTTP headers and payload digest go along.
"""

from __future__ import annotations

import html as markup
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # of responses made from pages, which carry none

# what is cut out, from an opening to the next closing; tags that end a line; where values stand
CUT = (("(?s)<!--.*?-->", "-->"), *((rf"(?is)<{t}\b[^<>]*>.*?</{t}\s*>", rf"(?i)</{t}\s*>") for t in ("script", "style", "head")))
LINE = r"(?i)</?(?:p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|table|section|article|aside|main|header|footer|nav|body|html|blockquote|pre|form)\b[^>]*>"
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'<>]+)"""
TITLE, TITLE_END = r"(?is)<title\b[^<>]*>(.*?)</title\s*>", r"(?i)</title\s*>"
LANGUAGE, LINK = rf"(?i)<html\b[^<>]*?\slang\s*=\s*{VALUE}", rf"(?i)<a\b[^<>]*?\shref\s*=\s*{VALUE}"

_CUT = [(re.compile(p), re.compile(end)) for p, end in CUT]
_LINE, _TAG, _CLOSE = re.compile(LINE), re.compile("<[^>]*>"), re.compile(">")
_TITLE, _TITLE_END, _LANGUAGE, _LINK = (re.compile(p) for p in (TITLE, TITLE_END, LANGUAGE, LINK))
_ENTITY = re.compile("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_BLANKS, _BREAKS, _BREAK = re.compile(r"[ \t\f\r\x0B]+"), re.compile(r" ?\n[ \n]*"), re.compile(r"[\r\n]+")


def _entities(text: str) -> str:
    """Named and numeric entities put back, once: what they give is not read again."""
    return _ENTITY.sub(lambda m: markup.unescape(m.group()), text) if "&" in text else text


def _tidy(text: str) -> str:
    """One space between words, one line break between lines, none at the ends."""
    return _BREAKS.sub("\n", _BLANKS.sub(" ", text)).strip(" \n")


def _parted(text: str, end: re.Pattern) -> tuple[str, str]:
    """The text up to the last place where ``end`` matches, and the rest.

    An opening in the rest is never closed. Looking for its end would read the rest once for
    each of them, so patterns that reach for an end are used on the first part only.
    """
    at = 0
    for m in end.finditer(text):
        at = m.end()
    return text[:at], text[at:]


def plain_text(html: str) -> str:
    """Text of a page: without comments, scripts, styles and the head; block tags end lines, other tags vanish."""
    for pattern, end in _CUT:
        head, rest = _parted(html, end)
        html = pattern.sub(" ", head) + rest
    head, rest = _parted(html, _CLOSE)
    return _tidy(_entities(_TAG.sub("", _LINE.sub("\n", head)) + rest))


def _bare(value: str) -> str:
    return value[1:-1] if value[:1] in "\"'" else value


def page_facts(html: str) -> tuple[str, str, list[str]]:
    """Title, language and outgoing links, the links as they stand but for entities and line breaks."""
    title = _TITLE.search(_parted(html, _TITLE_END)[0])
    language = _LANGUAGE.search(html)
    links = [_entities(_BREAK.sub(" ", _bare(m.group(1)))) for m in _LINK.finditer(html)]
    return _tidy(_entities(title.group(1)).replace("\n", " ")) if title else "", _bare(language.group(1)) if language else "", links


def _fields(html: str) -> str:
    title, language, links = page_facts(html)
    return "".join(f"{name}: {value}{CRLF}" for name, value in (("title", title), ("language", language), *(("outlink", x) for x in links)))


def _each(fn):
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(fn)

    return F.pandas_udf(run, "string")


def _uuid(*parts: Column) -> Column:
    """A record id out of the digest of its parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), *[x for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (([F.lit("-")] if s > 1 else []) + [F.substring(h, s, n)])])


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (record_id, target_uri, date, http_headers, payload, payload_digest) of raw pages, and page_id.

    A null url or html is empty; a null page_id is part of the id as nothing.
    """
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"), url.alias("target_uri"),
        F.lit(date).alias("date"), headers.alias("http_headers"), html.alias("payload"), _digest(html).alias("payload_digest"))


def _record(rows: DataFrame, kind: str, block: Column, content_type: str) -> DataFrame:
    made = rows.withColumns({"_block": block, "_id": _uuid(F.lit(kind), F.col("record_id"))}).withColumns({"_size": F.octet_length("_block").cast("long"), "_own": _digest(F.col("_block"))})
    bare = lambda c: F.regexp_replace(F.col(c), r"[\r\n]+", " ")  # noqa: E731  a header value holds no line break
    fields = (
        ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.concat(F.lit("<"), F.col("_id"), F.lit(">"))), ("WARC-Refers-To", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        ("WARC-Target-URI", bare("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Source-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("_own")),
        ("Content-Type", F.lit(content_type)), ("Content-Length", F.col("_size").cast("string")),
    )
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])
    return made.select(
        "page_id", F.lit(kind).alias("record_type"), F.col("_id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), F.col("_own").alias("block_digest"),
        F.col("_size").alias("content_length"), head.alias("headers"), F.col("_block").alias("block"))


def derive(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response; columns as in ``_record``.

    Empty payloads give records with an empty text, no title, no language and no links. Repeated
    responses give the same records again; an empty table gives none. Other columns are ignored.
    Named and numeric entities are put back where they end with a semicolon. The source headers
    of raw pages are made up by ``responses_of_pages``, as pages carry none.
    """
    rows = responses.select("page_id", "record_id", "target_uri", "date", "http_headers", F.coalesce("payload", F.lit("")).alias("payload"), "payload_digest")
    metadata, text = _each(_fields)("payload"), _each(plain_text)("payload")
    return _record(rows, "metadata", metadata, "application/warc-fields").unionByName(_record(rows, "conversion", text, "text/plain; charset=utf-8"))


def as_records(derived: DataFrame) -> DataFrame:
    """(record): each record as it stands in a file, as bytes; files are these one after another."""
    return derived.select(F.encode(F.concat("headers", F.lit(CRLF), "block", F.lit(CRLF * 2)), "UTF-8").alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """(fields, block) of serialised records: the named header fields, and the block as its length says."""
    text = F.decode("record", "UTF-8")
    head = F.substring_index(text, CRLF * 2, 1)
    lines = F.filter(F.split(head, CRLF), lambda line: line.contains(": "))
    fields = F.map_from_entries(F.transform(lines, lambda line: F.struct(F.substring_index(line, ": ", 1), F.substring(line, F.locate(": ", line) + 2, F.length(line)))))
    split = records.select(fields.alias("fields"), F.octet_length(head).alias("_at"), "record")
    return split.select("fields", F.decode(F.expr("substring(record, _at + 5, cast(fields['Content-Length'] as int))"), "UTF-8").alias("block"))


# the entities that occur in the pages, for the SQL; & comes last
SQL_ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def _sql() -> str:
    quoted = lambda p: p.replace("'", "''")

    def replaced(text: str) -> str:
        for name, char in SQL_ENTITIES:
            text = f"replace({text}, '{name}', '{char}')"
        return text

    def tidy(text: str) -> str:
        text = f"regexp_replace({text}, '[ \\t\\f\\r\\x0B]+', ' ', 'g')"
        return f"regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"

    bare = lambda x: f"""regexp_replace({x}, '^["'']|["'']$', '', 'g')"""
    uuid = lambda text: f"(SELECT 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] FROM (SELECT md5({text}) AS h))"
    plain = "payload"
    for pattern, _ in CUT:
        plain = f"regexp_replace({plain}, '{quoted(pattern)}', ' ', 'g')"
    plain = tidy(replaced(f"regexp_replace(regexp_replace({plain}, '{LINE}', chr(10), 'g'), '<[^>]*>', '', 'g')"))
    crlf = "chr(13) || chr(10)"
    title = replaced(f"regexp_extract(payload, '{TITLE}', 1)")
    title = tidy(f"replace({title}, chr(10), ' ')")
    link = f"'outlink: ' || {replaced(f"regexp_replace({bare('x')}, '[\\r\\n]+', ' ', 'g')")} || {crlf}"
    language = bare(f"regexp_extract(payload, '{quoted(LANGUAGE)}', 1)")
    meta = f"'title: ' || {title} || {crlf} || 'language: ' || {language} || {crlf} || coalesce(array_to_string(list_transform(regexp_extract_all(payload, '{quoted(LINK)}', 1), lambda x: {link}), ''), '')"
    fields = [("WARC-Type", "record_type"), ("WARC-Record-ID", "'<' || record_id || '>'"), ("WARC-Refers-To", "'<' || refers_to || '>'"), ("WARC-Target-URI", "regexp_replace(target_uri, '[\\r\\n]+', ' ', 'g')"),
              ("WARC-Date", "date"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "CAST(content_length AS VARCHAR)")]
    head = f"'WARC/1.1' || {crlf} || " + " || ".join(f"'{n}: ' || {v} || {crlf}" for n, v in fields)
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri")} AS refers_to, '{DATE}' AS date,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload) AS source_headers, 'sha256:' || sha256(payload) AS source_digest FROM p),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {meta} AS block FROM r
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {plain} FROM r),
d AS (SELECT *, {uuid("record_type || '|' || refers_to")} AS record_id, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM b)
SELECT page_id, record_type, record_id, refers_to, target_uri, date, source_headers, source_digest, block_digest, content_length, {head} AS headers, block FROM d
"""


SQL = _sql()
