"""Sort orders, labels, dates and small routing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import sanitised
from quire.operators.ranges import numbered
from quire.plans.kit import Catalogue
from quire.tables import load, once

C = Catalogue()

C.statement("mixed_order", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM {orders} ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey LIMIT 30")


@C.plan("SELECT slug, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_extract(slug, '([0-9]+)$', 1) = '' THEN 1 ELSE 0 END, CAST(regexp_extract(slug, '([0-9]+)$', 1) AS INT), slug) AS BIGINT) AS place FROM (SELECT DISTINCT slug FROM cms_publications WHERE regexp_matches(slug, '[0-9]+$'))")
def numeric_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of their numbers, and their places in it, numbered by ranges."""
    p = load(spark, sf_dir, "cms_publications").where(F.col("slug").rlike("[0-9]+$")).select("slug").distinct()
    return numbered(p.withColumn("no", F.regexp_extract("slug", "([0-9]+)$", 1).cast("int")), [], ["no", "slug"], "place").select("slug", "place")


@C.plan("SELECT source_id, block_id, CAST(place AS INTEGER) AS place FROM (SELECT source_id, block_id, row_number() OVER (PARTITION BY source_id ORDER BY CASE field WHEN 'html' THEN 0 WHEN 'href' THEN 1 WHEN 'src' THEN 2 ELSE 3 END, length(selector), block_id) AS place FROM (SELECT DISTINCT source_id, block_id, coalesce(heading, '') AS selector, CASE block_id % 4 WHEN 0 THEN 'alt' WHEN 1 THEN 'src' WHEN 2 THEN 'href' ELSE 'html' END AS field FROM text_blocks)) WHERE place <= 5")
def field_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in the order in which they are applied: html, href, src, alt, then the shorter selector; the first five of a source."""
    field = F.element_at(F.array(*map(F.lit, ("alt", "src", "href", "html"))), (F.col("block_id") % 4 + 1).cast("int"))
    f = load(spark, sf_dir, "text_blocks").select("source_id", "block_id", F.coalesce("heading", F.lit("")).alias("selector"), field.alias("field")).distinct()
    rank = F.array_position(F.array(*map(F.lit, ("html", "href", "src", "alt"))), F.col("field"))
    best = F.slice(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.length("selector").alias("l"), "block_id"))), 1, 5)
    top = f.withColumn("k", F.row_number().over(Window.partitionBy("source_id", F.pmod("block_id", F.lit(16))).orderBy(rank, F.length("selector"), "block_id"))).where("k <= 5")  # the best of each sixteenth of a source first
    return top.groupBy("source_id").agg(best.alias("x")).select("source_id", F.posexplode("x").alias("p", "y")).select("source_id", "y.block_id", (F.col("p") + 1).alias("place"))


C.statement("precedence_order", "SELECT source_id, block_id FROM (SELECT source_id, block_id, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN kind = 'heading' THEN 0 ELSE 1 END, length(coalesce(text, '')), block_id) AS k FROM (SELECT DISTINCT source_id, block_id, kind, text FROM {text_blocks})) WHERE k = 1")
C.statement("heading_forms", "SELECT CASE WHEN text RLIKE '^[IVXLC]+\\\\.$' THEN 'numeral' WHEN text RLIKE '^CHAP\\\\.' THEN 'chapter' WHEN text RLIKE '^HOMILY [0-9]+$' THEN 'homily' ELSE 'other' END AS form, CAST(count(DISTINCT block_id) AS BIGINT) AS n FROM {text_blocks} WHERE kind = 'heading' AND text IS NOT NULL GROUP BY 1", "SELECT CASE WHEN regexp_matches(text, '^[IVXLC]+\\.$') THEN 'numeral' WHEN regexp_matches(text, '^CHAP\\.') THEN 'chapter' WHEN regexp_matches(text, '^HOMILY [0-9]+$') THEN 'homily' ELSE 'other' END AS form, CAST(count(DISTINCT block_id) AS BIGINT) AS n FROM {text_blocks} WHERE kind = 'heading' AND text IS NOT NULL GROUP BY 1")
C.statement("prefix_kind", "SELECT DISTINCT book_id, CASE WHEN startswith(book_id, '1') THEN 'first' WHEN startswith(book_id, '2') THEN 'second' WHEN startswith(book_id, '3') THEN 'third' ELSE 'single' END AS kind FROM {grc_tokens}", "SELECT DISTINCT book_id, CASE WHEN starts_with(book_id, '1') THEN 'first' WHEN starts_with(book_id, '2') THEN 'second' WHEN starts_with(book_id, '3') THEN 'third' ELSE 'single' END AS kind FROM {grc_tokens}")
C.statement("title_with_year", "SELECT DISTINCT source_id, heading, CASE WHEN contains(heading, right(source_id, 4)) THEN heading ELSE concat(heading, ' (', right(source_id, 4), ')') END AS shown FROM {text_blocks} WHERE heading IS NOT NULL")
C.statement("month_folders", "SELECT date_format(o_orderdate, 'yyyy/MM') AS folder, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY 1", "SELECT strftime(o_orderdate, '%Y/%m') AS folder, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY 1")
C.statement("expiry", "SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderdate + INTERVAL 168 HOURS > TIMESTAMP_NTZ '2000-01-01 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS open, CAST(sum(CASE WHEN o_orderdate + INTERVAL 30 DAYS > TIMESTAMP_NTZ '2000-01-01 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS open_long FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderdate + INTERVAL 168 HOURS > TIMESTAMP '2000-01-01 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS open, CAST(sum(CASE WHEN o_orderdate + INTERVAL 30 DAYS > TIMESTAMP '2000-01-01 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS open_long FROM {orders} GROUP BY o_orderstatus")
C.statement("share_per_unit", "SELECT source_id, round(CAST(count(DISTINCT section_index) AS DOUBLE) / greatest(1, count(DISTINCT block_id)), 4) AS share FROM {text_blocks} GROUP BY source_id")
C.statement("profile_joins", "SELECT n.n_nationkey, n.n_name, r.r_name, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM {nation} n LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey LEFT JOIN (SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n FROM {supplier} GROUP BY 1) s ON s.s_nationkey = n.n_nationkey LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY 1) c ON c.c_nationkey = n.n_nationkey")
C.statement("index_map", "SELECT p.entry_id, o.other FROM {place_list} p LATERAL VIEW explode(p.other_names) o AS other", "SELECT entry_id, unnest(other_names) AS other FROM {place_list}")
C.statement("conditional_update", "SELECT DISTINCT id, CASE WHEN status = 'pending' AND NOT active THEN 'revoked' ELSE status END AS status FROM {priest_registrations}")
C.statement("ambiguous_names", "SELECT surface, CASE WHEN count(DISTINCT book_id) > 1 THEN 'ambiguous' ELSE min(book_id) END AS book FROM {grc_tokens} GROUP BY surface")
C.statement("category_route", "SELECT event_type, CAST(sum(CASE WHEN CAST(get_json_object(props, '$.k') AS INT) >= 80 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY event_type", "SELECT event_type, CAST(sum(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 80 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY event_type")
C.statement("allowed_ids", "SELECT DISTINCT e.exchange_id, array_join(filter(split(lower(e.message), ' '), w -> w IN ('hope', 'mercy', 'faith', 'trust')), ',') AS kept FROM {chat_exchanges} e WHERE message IS NOT NULL", "SELECT DISTINCT exchange_id, array_to_string(list_filter(string_split(lower(message), ' '), lambda w: w IN ('hope', 'mercy', 'faith', 'trust')), ',') AS kept FROM {chat_exchanges} WHERE message IS NOT NULL")


_SAFE = "p|br|em|strong|b|i|ul|ol|li|h2|h3|blockquote|a"


@C.plan(rf"""
    WITH p AS (SELECT DISTINCT id, body_en AS b FROM cms_publications WHERE body_en IS NOT NULL), s AS (SELECT id, regexp_replace(b, '(?is)<(?:script\b.*?(?:</script\s*>|$)|style\b.*?(?:</style\s*>|$)|iframe\b.*?(?:</iframe\s*>|$)|object\b.*?(?:</object\s*>|$)|template\b.*?(?:</template\s*>|$))|<!--.*?(?:-->|$)', '', 'g') AS b FROM p),
    m AS (SELECT id, regexp_replace(b, '(?i)<(/?)({_SAFE})\b[^>]*>?', chr(1) || '\1\2' || chr(2), 'g') AS b FROM s)
    SELECT id, replace(replace(regexp_replace(b, '<[^>]*>?', '', 'g'), chr(1), '<'), chr(2), '>') AS body FROM m""")
def sanitised_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with only harmless markup left."""
    p = once(load(spark, sf_dir, "cms_publications"), "ingested_at", "id", "body_en")
    return p.where("body_en is not null").select("id", sanitised(F.col("body_en")).alias("body"))


QUERIES, SQL = C.queries, C.sql
