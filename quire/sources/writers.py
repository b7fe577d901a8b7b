"""Sinks: tables by book, manifests, and line-made documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import calendar_escape, feast_year


def by_book(df: DataFrame, path: str, layer: str, format: str = "parquet") -> None:
    """A layer as one folder a book; rows of one book are brought together first, so that each folder holds few files."""
    df.withColumn("layer", F.lit(layer)).repartition("book_id").write.mode("overwrite").partitionBy("layer", "book_id").format(format).save(path)


def manifest(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """One row: name, rows, distinct keys, and a digest that does not depend on the order of rows."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys"), F.sum(digest).cast("string").alias("digest"))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))


def sitemap_entries(df: DataFrame, url: str, changed: str) -> DataFrame:
    """``<url>`` elements; marks that XML reserves are written out."""
    loc = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return df.select(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), F.date_format(changed, "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("line"))


#: Head and foot of a calendar file.
CALENDAR_HEAD = "\r\n".join(("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//quire//calendar//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", ""))
CALENDAR_FOOT = "END:VCALENDAR\r\n"


def calendar_events(df: DataFrame, uid: str, day: str, title: str, description: str | None = None) -> DataFrame:
    """All-day calendar entries, yearly from ``feast_year`` on, each up to the day after.

    A calendar file is ``CALENDAR_HEAD``, the entries, one after another, and ``CALENDAR_FOOT``.
    """
    start = F.make_date(feast_year(F.month(day), F.dayofmonth(day)), F.month(day), F.dayofmonth(day))
    write = lambda name, c: F.concat(F.lit(name), c)
    parts = [F.lit("BEGIN:VEVENT"), write("UID:", F.col(uid).cast("string")), write("DTSTART;VALUE=DATE:", F.date_format(start, "yyyyMMdd")), write("DTEND;VALUE=DATE:", F.date_format(F.date_add(start, 1), "yyyyMMdd")), F.lit("RRULE:FREQ=YEARLY"), write("SUMMARY:", calendar_escape(F.col(title)))]
    if description:
        parts.append(write("DESCRIPTION:", calendar_escape(F.col(description))))
    return df.select(F.concat_ws("\r\n", *parts, F.lit("END:VEVENT"), F.lit("")).alias("entry"))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def fail_on_rows(violations: DataFrame, what: str) -> None:
    """Raises if a violations plan has any row; looks at a few only."""
    bad = violations.take(5)
    if bad:
        raise AssertionError(f"{what}: {[r.asDict() for r in bad]}")
