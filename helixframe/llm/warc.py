"""Derived WARC records: from each response a metadata record and a plain-text conversion record.

Both carry the response's target URI and date, refer to its record id, target URI and date, and state digests of
the source payload and of their own block. The text is taken from the HTML by DataFrame functions.

Contract: a null payload is empty and still gives both records; a null target URI or date stays null and its header
line is left out; record ids follow from the response's id (or, for page tables, from page_id, url and a digest of
the html), so reruns agree and rows equal in all of these give equal records; an empty table gives an empty result;
columns of other names are never read. Digests are labelled with their algorithm and hexadecimal; numeric entities stay as
they are in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Where a page table states no crawl date, records carry this one.
NO_DATE = "1970-01-01T00:00:00Z"
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>"
BREAKS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|nav|footer|header|main|aside|blockquote|pre|form|title)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
BLANKS, LINES = r"[ \t\r\f]+", r" ?\n[ \n]*"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""
LANG = r"""(?i)<html\b[^>]*\blang\s*=\s*["']([^"']*)["']"""


def _entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_text(html: Column) -> Column:
    """Visible text of HTML, one line for each block."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(F.regexp_replace(_entities(text), BLANKS, " "), LINES, "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def _sha1(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text.cast("binary")))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Pages as response records: record_id, target_uri, date, http_headers and payload, with page_id."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    size = F.octet_length(payload).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n"))
    return pages.select("page_id", _urn(F.lit("response"), key, F.coalesce(F.col("url"), F.lit("")), F.sha1(payload.cast("binary"))).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"))


def derive(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response; carry names columns to take along.

    The response is read once; both records come from one row, so nothing is shuffled.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    links = F.array_join(F.transform(F.regexp_extract_all(payload, F.lit(LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), F.translate(x, "\r\n\t", ""), F.lit("\r\n"))), "")
    title = F.regexp_replace(F.regexp_replace(_entities(F.regexp_extract(payload, TITLE, 1)), r"[ \t\r\n\f]+", " "), r"^ +| +$", "")
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), F.regexp_extract(payload, LANG, 1), F.lit("\r\nsource-payload-digest: "), _sha1(payload),
        F.lit("\r\nsource-payload-length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"), links, F.lit("source-http-headers:\r\n"), F.coalesce(F.col("http_headers"), F.lit("")),
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), html_text(payload).alias("block")),
    )
    base = records.select(*carry, F.col("record_id").alias("refers_to"), "target_uri", "date", _sha1(payload).alias("source_digest"), F.explode(two).alias("_warc"))
    block = F.col("_warc.block")
    return base.select(*carry, F.col("_warc.record_type").alias("record_type"), _urn(F.col("_warc.record_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", F.col("_warc.content_type").alias("content_type"), F.octet_length(block).cast("long").alias("content_length"), _sha1(block).alias("block_digest"), "source_digest", block.alias("block"))


def as_warc(records: DataFrame) -> DataFrame:
    """Derived records as the bytes of WARC/1.1 records, one row each: concatenated they are a WARC file.

    Line breaks in a header's value (a crawled address may hold any character) are percent-encoded, so that no value
    adds a header.
    """

    def line(name: str, value: Column) -> Column:
        safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n"))).otherwise(F.lit(""))

    def uri(value: Column) -> Column:
        return F.concat(F.lit("<"), value, F.lit(">"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", uri(F.col("record_id"))), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", uri(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.select("record_id", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary").alias("warc"))


def op2_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")), carry=("page_id",))


def _sql() -> str:
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def entities(x: str) -> str:
        for name, char in ENTITIES:
            x = f"replace({x}, {q(name)}, {q(char)})"
        return x

    def urn(x: str) -> str:
        return f"'urn:uuid:' || md5({x})[1:8] || '-' || md5({x})[9:12] || '-' || md5({x})[13:16] || '-' || md5({x})[17:20] || '-' || md5({x})[21:32]"

    crlf = "chr(13) || chr(10)"
    text = f"regexp_replace(regexp_replace(regexp_replace(payload, {q(HIDDEN)}, ' ', 'g'), {q(BREAKS)}, chr(10), 'g'), {q(TAGS)}, '', 'g')"
    text = f"regexp_replace(regexp_replace({entities(text)}, {q(BLANKS)}, ' ', 'g'), {q(LINES)}, chr(10), 'g')"
    text = f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    title = f"regexp_replace(regexp_replace({entities(f'regexp_extract(payload, {q(TITLE)}, 1)')}, '[ \\t\\r\\n\\f]+', ' ', 'g'), '^ +| +$', '', 'g')"
    links = f"coalesce(list_aggregate(list_transform(regexp_extract_all(payload, {q(LINK)}, 1), lambda x: 'outlink: ' || translate(x, chr(13) || chr(10) || chr(9), '') || {crlf}), 'string_agg', ''), '')"
    fields = f"""'title: ' || {title} || {crlf} || 'language: ' || regexp_extract(payload, {q(LANG)}, 1) || {crlf} || 'source-payload-digest: ' || source_digest || {crlf}
        || 'source-payload-length: ' || octet_length(encode(payload))::VARCHAR || {crlf} || {links} || 'source-http-headers:' || {crlf}
        || 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || octet_length(encode(payload))::VARCHAR || {crlf}"""
    key = "concat('response|', coalesce(page_id::VARCHAR, ''), '|', coalesce(url, ''), '|', sha1(payload))"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
r AS (SELECT page_id, url AS target_uri, '{NO_DATE}' AS date, payload, 'sha1:' || sha1(payload) AS source_digest, {urn(key)} AS refers_to FROM p),
b AS (SELECT page_id, target_uri, date, source_digest, refers_to, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {fields} AS block FROM r
      UNION ALL SELECT page_id, target_uri, date, source_digest, refers_to, 'conversion', 'text/plain; charset=utf-8', {text} FROM r)
SELECT page_id, record_type, {urn("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, date, content_type,
       octet_length(encode(block))::BIGINT AS content_length, 'sha1:' || sha1(block) AS block_digest, source_digest, block FROM b
"""


SQL = _sql()
