"""Operational records: counts, filters, anti-joins, nesting, upserts and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import or_default
from quire.operators.changes import insert_absent, numbered_slugs, upsert_latest
from quire.plans.kit import Catalogue, unique_names_sql
from quire.tables import load, once

C = Catalogue()

C.statement("one_pass_counts", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(country) AS BIGINT) AS with_country, CAST(count(distributed_at) AS BIGINT) AS distributed, CAST(sum(CASE WHEN share_worldwide THEN 1 ELSE 0 END) AS BIGINT) AS shared, CAST(sum(CASE WHEN consent_name_sharing AND share_worldwide THEN 1 ELSE 0 END) AS BIGINT) AS both_consents FROM {prayer_network_requests}")
C.statement("status_counts", "SELECT d.status, CAST(count(DISTINCT m.id) AS BIGINT) AS n FROM (SELECT * FROM VALUES ('new'), ('assigned'), ('completed'), ('declined') AS t(status)) d LEFT JOIN {mass_intention_requests} m ON m.status = d.status GROUP BY d.status", "SELECT d.status, CAST(count(DISTINCT m.id) AS BIGINT) AS n FROM (VALUES ('new'), ('assigned'), ('completed'), ('declined')) AS d(status) LEFT JOIN {mass_intention_requests} m ON m.status = d.status GROUP BY d.status")
C.statement("filters", "SELECT DISTINCT id, status, country FROM {prayer_network_requests} WHERE status IN ('new', 'prayed') AND status NOT IN ('archived') AND country IS NOT NULL AND share_worldwide IS TRUE AND distributed_at IS NULL AND created_at >= TIMESTAMP '2024-06-01 00:00:00'", "SELECT DISTINCT id, status, country FROM {prayer_network_requests} WHERE status IN ('new', 'prayed') AND status NOT IN ('archived') AND country IS NOT NULL AND share_worldwide IS TRUE AND distributed_at IS NULL AND epoch_us(created_at) >= 1717200000000000")
C.statement("campaign_stats", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS large, greatest(CAST(count(*) - 2000 AS BIGINT), 0) AS above FROM {events} GROUP BY event_type")
C.statement("stamp_once", "SELECT user_id, event_type, min(event_id) AS first_event, max(event_id) AS last_event FROM {events} GROUP BY user_id, event_type")
C.statement("orphan_skip", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_custkey FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'")
C.statement("live_pick", "SELECT o_orderstatus, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS rn FROM {orders}) WHERE rn = 1")


@C.plan("SELECT o_orderkey, o_totalprice, CAST(count(*) OVER () AS BIGINT) AS total FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page, and how many rows there are in all: two narrow passes, as a window over everything would be one task."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 1000").select("o_orderkey", "o_totalprice")
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)
    return page.crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))  # one row


C.statement("feast_on_date", "SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d FROM {orders} WHERE month(o_orderdate) = 2 AND day(o_orderdate) IN (2, 29)", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM {orders} WHERE month(o_orderdate) = 2 AND day(o_orderdate) IN (2, 29)")
C.statement("valid_at", "SELECT DISTINCT id, status, CASE WHEN verified_at IS NULL THEN 'open' WHEN verified_at <= TIMESTAMP '2024-07-01 00:00:00' THEN 'valid' ELSE 'later' END AS validity FROM {priest_registrations} WHERE active", "SELECT DISTINCT id, status, CASE WHEN verified_at IS NULL THEN 'open' WHEN epoch_us(verified_at) <= 1719792000000000 THEN 'valid' ELSE 'later' END AS validity FROM {priest_registrations} WHERE active")
C.statement("status_labels", "SELECT DISTINCT exchange_id, CASE scope WHEN 'catholic' THEN 'answered' WHEN 'out_of_scope' THEN 'declined' ELSE 'referred' END AS label FROM {chat_exchanges}")
C.statement("anonymised", "SELECT substring(sha2(client_id, 256), 1, 12) AS client, CAST(count(DISTINCT exchange_id) AS BIGINT) AS n FROM {chat_exchanges} WHERE client_id IS NOT NULL GROUP BY 1", "SELECT substring(sha256(client_id), 1, 12) AS client, CAST(count(DISTINCT exchange_id) AS BIGINT) AS n FROM {chat_exchanges} WHERE client_id IS NOT NULL GROUP BY 1")
C.statement("optional_filters", "SELECT DISTINCT id, content_type, featured FROM {cms_publications} WHERE content_type = 'prayer' AND featured = false AND language_mode IS NOT NULL")
C.statement("source_overlay", "SELECT n.n_nationkey, coalesce(c.label, n.n_name) AS label, coalesce(c.n, 0) AS n_customers FROM {nation} n LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) > 60 THEN max(c_name) END AS label FROM {customer} GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey")
C.statement("confidence_rollup", "SELECT coalesce(source, 'all') AS source, coalesce(content_type, 'all') AS content_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY ROLLUP (source, content_type)")


@C.plan("""
    SELECT id, slug, title, epoch_us(coalesce(published_at, scheduled_at, created_at)) AS effective_us FROM (SELECT DISTINCT ON (id) *, coalesce(nullif(title_kha, ''), nullif(title_en, ''), slug) AS title FROM cms_publications)
    WHERE status = 'published' OR (status = 'scheduled' AND scheduled_at IS NOT NULL AND epoch_us(scheduled_at) <= 1727740800000000)
    ORDER BY pinned DESC, published_at DESC NULLS LAST, scheduled_at DESC NULLS LAST, created_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 5""")
def visible_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of what is visible at a given time, with fallback titles and dates."""
    p = once(load(spark, sf_dir, "cms_publications"), "ingested_at", "id", "slug", "status", "title_en", "title_kha", "pinned", "created_at", "published_at", "scheduled_at")
    seen = p.where((F.col("status") == "published") | (F.col("status") == "scheduled") & (F.col("scheduled_at") <= F.lit("2024-10-01 00:00:00").cast("timestamp")))
    d = seen.orderBy(F.col("pinned").desc(), F.desc_nulls_last("published_at"), F.desc_nulls_last("scheduled_at"), F.desc_nulls_last("created_at"), F.col("id").desc()).offset(5).limit(50)
    title = or_default(F.col("title_kha"), or_default(F.col("title_en"), F.col("slug")))
    return d.select("id", "slug", title.alias("title"), F.unix_micros(F.coalesce("published_at", "scheduled_at", "created_at")).alias("effective_us"))


@C.plan("""
    WITH o AS (SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 200), l AS (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1)
    SELECT o.o_orderkey, greatest(8 - coalesce(l.n, 0), 0) AS remaining FROM o LEFT JOIN l ON l.l_orderkey = o.o_orderkey
    WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o.o_orderkey AND x.l_suppkey <= 10) AND coalesce(l.n, 0) < 8""")
def available_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 200 first, then without those already taken, then those with room."""
    o = load(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).orderBy("o_orderdate", "o_orderkey").limit(200)
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(F.broadcast(o.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")  # 200 rows at most
    n = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("least"))
    j = o.join(n, o.o_orderkey == n.l_orderkey, "left").where((F.coalesce("least", F.lit(99)) > 10) & (F.coalesce("n", F.lit(0)) < 8))
    return j.select("o_orderkey", F.greatest(8 - F.coalesce("n", F.lit(0)), F.lit(0)).alias("remaining"))


@C.plan("SELECT o.o_orderkey, CAST(count(l.l_orderkey) AS BIGINT) AS n, coalesce(string_agg(l.l_linenumber || ':' || l.l_partkey, ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS lines FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record with its details nested in order."""
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    o = load(spark, sf_dir, "orders").select("o_orderkey").join(g, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"])), ","), F.lit("")).alias("lines"))


_NAMED = "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_brand || ' 2' ELSE p_brand END AS raw FROM part"


@C.plan(unique_names_sql(_NAMED, "p_partkey", "slug", 150))
def unique_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs made unique by number, past numbers that other names spell."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.concat("p_brand", F.lit(" 2"))).otherwise(F.col("p_brand")).alias("raw"))
    return numbered_slugs(p, "p_partkey", F.col("raw")).select("p_partkey", "slug")


@C.plan("""
    WITH n AS (SELECT user_id, event_type, max_by(value, event_id) AS value, CAST(max(event_id) AS BIGINT) AS at FROM events WHERE event_id >= 5000 GROUP BY ALL), o AS (SELECT user_id, event_type, max_by(value, event_id) AS value, CAST(max(event_id) AS BIGINT) AS at FROM events WHERE event_id < 5000 GROUP BY ALL)
    SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value, coalesce(n.at, o.at) AS at FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def upsert_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values replace old ones by key, the latest wins (D01, J24): one aggregate over both, no join."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("at"))
    return upsert_latest(e.where("at < 5000"), e.where("at >= 5000"), ["user_id", "event_type"], "at")


@C.plan("SELECT DISTINCT o_custkey AS c_custkey, 'old' AS origin FROM orders UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def idempotent_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers known from their orders, and the list of all of them imported: absent keys are added, others left alone."""
    old = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("origin", F.lit("old"))
    return insert_absent(old, load(spark, sf_dir, "customer").select("c_custkey").withColumn("origin", F.lit("new")), ["c_custkey"])


@C.plan("""
    WITH e AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
    k AS (SELECT user_id, event_type, last, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place FROM e WHERE n % 2 = 1)
    SELECT user_id, event_type, CAST(place AS INTEGER) AS place FROM k WHERE place <= 500""")
def toggled_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toggle log folded to what is on: an odd number of toggles, latest first, 500 at most."""
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).where("n % 2 = 1")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last")))).where("place <= 500").select("user_id", "event_type", "place")


@C.plan("""
    WITH f AS (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1), d AS (SELECT e.user_id, CAST(datediff('day', CAST(first_ts AS DATE), CAST(ts AS DATE)) AS INTEGER) AS day FROM events e JOIN f USING (user_id)),
    g AS (SELECT user_id, CAST(count(DISTINCT day) FILTER (day BETWEEN 0 AND 6) AS BIGINT) AS n_days FROM d GROUP BY 1) SELECT user_id, n_days, n_days = 7 AS all_seven FROM g""")
def progress_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven day flags from the first event on, their sum, and whether all are set."""
    e = load(spark, sf_dir, "events")
    f = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    day = F.datediff(F.col("ts").cast("date"), F.col("first_ts").cast("date"))
    g = e.join(f, "user_id").groupBy("user_id").agg(F.count_distinct(F.when(day.between(0, 6), day)).alias("n_days"))
    return g.withColumn("all_seven", F.col("n_days") == 7)


QUERIES, SQL = C.queries, C.sql
