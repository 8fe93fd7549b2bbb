"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: HTML entities that are written out, in this order. Fixed values.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: From markup to text, in this order.
STEPS = (
    (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>", " "),
    (r"(?i)<(?:/?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|aside|blockquote|pre)\b[^>]*)>", "\n"),
    (r"(?s)<[^>]*>", " "),
)
SPACES = ((r"[ \t\x0b\f\r]+", " "), (r" ?\n[ \n]*", "\n"))
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"(?is)<a\b[^>]*?\bhref\s*="


def _spaces(c: Column) -> Column:
    for pattern, to in SPACES:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(F.regexp_replace(c, r"^\n|\n$", ""))


def _entities(c: Column) -> Column:
    for name, to in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(to))
    return c


def plain_text(html: Column) -> Column:
    """The text of a page: blocks become lines, other tags blanks, the usual entities characters."""
    for pattern, to in STEPS:
        html = F.regexp_replace(html, pattern, to)
    return _spaces(_entities(html))


def urn(*parts: Column) -> Column:
    """A name-based record id: equal parts give equal ids."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Pages as response records: record_id, target_uri, date, headers (map), payload.

    Null url or html count as empty. Rows that repeat page_id, url and html are one record.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, html).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length(html).cast("string")
        ).alias("headers"),
        html.alias("payload"),
    ).dropDuplicates(["record_id"])


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response: a ``metadata`` and a ``conversion`` record.

    Input: record_id, target_uri, date, headers, payload (other columns are not looked at). Both
    refer to the response (refers_to) and to each other (concurrent_to), and keep its URI, date
    and headers. ``payload_digest`` is the source payload's digest, ``block_digest`` that of
    the record's own content. Metadata content has one ``name: value`` line for each fact.
    A null payload counts as empty; a null id, URI or date stays null; null headers are an empty map.
    """
    text = F.coalesce("payload", F.lit(""))
    base = records.select(
        "record_id", "target_uri", "date",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("source_headers"),
        digest(text).alias("payload_digest"),
        F.octet_length(text).alias("source_bytes"),
        _spaces(_entities(F.regexp_extract(text, TITLE, 1))).alias("title"),
        F.regexp_count(text, F.lit(LINK)).alias("links"),
        plain_text(text).alias("plain"),
    ).withColumn("text_digest", digest(F.col("plain")))
    ids = {k: urn(F.lit(k), F.coalesce("record_id", F.lit("")), "payload_digest") for k in ("metadata", "conversion")}
    facts = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), "title"),
        F.concat(F.lit("outlinks: "), F.col("links").cast("string")),
        F.concat(F.lit("sourceBytes: "), F.col("source_bytes").cast("string")),
        F.concat(F.lit("textBytes: "), F.octet_length("plain").cast("string")),
        F.concat(F.lit("textDigest: "), "text_digest"),
        F.lit(""),
    )
    both = F.array(*(
        F.struct(
            F.lit(kind).alias("warc_type"), ids[kind].alias("id"), ids[other].alias("concurrent_to"),
            F.lit(form).alias("content_type"), own.alias("block_digest"), content.alias("content"),
        )
        for kind, other, form, own, content in (
            ("metadata", "conversion", "application/warc-fields", digest(facts), facts),
            ("conversion", "metadata", "text/plain; charset=utf-8", F.col("text_digest"), F.col("plain")),
        )
    ))
    return base.withColumn("derived", F.explode(both)).select(
        "derived.warc_type", F.col("derived.id").alias("record_id"), F.col("record_id").alias("refers_to"), "derived.concurrent_to",
        "target_uri", "date", "derived.content_type", "source_headers", "payload_digest", "derived.block_digest", "derived.content",
    )


def lines(derived: DataFrame) -> DataFrame:
    """Each record as WARC text, without the two line ends that close it."""
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        *(
            F.concat(F.lit(name + ": "), c)
            for name, c in (
                ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
                ("WARC-Concurrent-To", F.col("concurrent_to")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")),
                ("WARC-Source-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("block_digest")),
            )
        ),
        F.concat_ws("\r\n", F.transform(F.array_sort(F.map_entries("source_headers")), lambda e: F.concat(F.lit("WARC-Source-Header: "), e["key"], F.lit("="), e["value"]))),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.octet_length("content").cast("string")),
    )
    return derived.select(F.concat(header, F.lit("\r\n\r\n"), "content").alias("value"))


def write(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files below ``path``, one per partition, written by the executors."""
    lines(derived).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def op8_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    out = derive(responses(read(spark, sf, "pages")))
    return out.withColumn("source_headers", F.array_join(F.transform(F.array_sort(F.map_entries("source_headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))
