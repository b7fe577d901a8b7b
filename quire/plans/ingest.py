"""Ingestion, scalar functions and event control over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import blob_sha1, page_path, safe_url, slug, summary, terms, video_id
from quire.operators.changes import numbered_slugs
from quire.operators.ranges import carried_forward
from quire.plans.kit import Catalogue, unique_names_sql
from quire.sources.readers import html_blocks, sections
from quire.sources.writers import manifest, markdown_rows, sitemap_entries
from quire.streaming.limits import limit_table, limit_tiers, replays, signatures, trailing_counts
from quire.tables import load, once

C = Catalogue()


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(load(spark, sf_dir, "cms_publications"), "ingested_at")


PUB = "pub AS (SELECT DISTINCT ON (id) * FROM cms_publications)"


@C.plan(f"""
    WITH {PUB}, b AS (SELECT id, unnest(list_filter(regexp_extract_all(coalesce(body_en, ''), '(<p>[^<]*</p>)', 1), lambda x: length(x) > 7)) AS t FROM pub)
    SELECT id, CAST(count(*) AS BIGINT) AS n_blocks, CAST(sum(length(trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))) AS BIGINT) AS n_chars FROM b GROUP BY id""")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the bodies that are markup."""
    b = html_blocks(publications(spark, sf_dir), "id", "body_en")
    return b.groupBy("id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@C.plan(f"WITH {PUB} SELECT id, left(trim(regexp_replace(regexp_replace(coalesce(body_en, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 360) AS summary, trim(regexp_replace(lower(coalesce(title_en, slug)), '[^a-z0-9]+', '-', 'g'), '-') AS name FROM pub")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain summaries and names."""
    return publications(spark, sf_dir).select("id", summary(F.col("body_en")).alias("summary"), slug(F.coalesce("title_en", "slug")).alias("name"))


@C.plan(f"WITH {PUB} SELECT id, CASE WHEN TRY_CAST(blocks_en_json AS JSON) IS NULL THEN 0 ELSE CAST(json_array_length(CAST(blocks_en_json AS JSON)) AS INTEGER) END AS n_blocks, CASE WHEN TRY_CAST(blocks_en_json AS JSON) IS NULL THEN NULL ELSE json_extract_string(CAST(blocks_en_json AS JSON), '$[0].type') END AS first_type FROM pub")
def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks stored as JSON; malformed JSON is no blocks, never an error."""
    whole = F.try_parse_json("blocks_en_json").isNotNull()
    b = F.when(whole, F.from_json("blocks_en_json", "array<struct<type:string,text:string>>"))
    return publications(spark, sf_dir).withColumn("b", b).select("id", F.when(F.col("b").isNull(), 0).otherwise(F.size("b")).alias("n_blocks"), F.get("b", F.lit(0))["type"].alias("first_type"))


@C.plan("""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
    h AS (SELECT doc_id, n, line, length(trim(line)) BETWEEN 1 AND 24 AND NOT regexp_matches(line, '[.,;:]\\s*$') AS is_heading FROM l WHERE trim(line) <> ''),
    s AS (SELECT *, CAST(sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS section_no FROM h)
    SELECT doc_id, section_no, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, section_no""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines open a section, whose number is carried on."""
    line = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.trim("line") != "")
    head = F.length(F.trim("line")).between(1, 24) & ~F.col("line").rlike(r"[.,;:]\s*$")
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("section_no", F.sum(head.cast("int")).over(w)).groupBy("doc_id", "section_no").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@C.plan("""
    WITH b AS (SELECT DISTINCT source_id, section_index, block_index, kind, text FROM text_blocks), f AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY section_index, block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM b)
    SELECT source_id, section_index, block_index, carried FROM f WHERE kind = 'paragraph'""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading carried forward over the blocks of a source, a long source in several ranges."""
    b = once(load(spark, sf_dir, "text_blocks"), "loaded_at", "block_id", "source_id", "section_index", "block_index", "kind", "text")
    b = b.select("block_id", "source_id", "section_index", "block_index", "kind", F.when(F.col("kind") == "heading", F.col("text")).alias("h"))
    got = carried_forward(b, ["source_id"], ["section_index", "block_index", "block_id"], F.col("h"), "carried")
    return got.where("kind = 'paragraph'").select("source_id", "section_index", "block_index", "carried")


@C.plan("SELECT source_id, section_index, CAST(sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END) AS BIGINT) AS n_words FROM (SELECT DISTINCT block_id, source_id, section_index, text FROM text_blocks WHERE kind = 'paragraph') GROUP BY GROUPING SETS ((source_id, section_index), (source_id))")
def section_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by section and source."""
    b = once(load(spark, sf_dir, "text_blocks").where("kind = 'paragraph'"), "loaded_at")
    n = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+")))
    return b.groupingSets([["source_id", "section_index"], ["source_id"]], "source_id", "section_index").agg(F.sum(n).alias("n_words"))


C.statement("text_hashes", "SELECT doc_id, sha2(text, 256) AS h FROM {documents}", "SELECT doc_id, sha256(text) AS h FROM {documents}")


@C.plan("SELECT doc_id, sha1(encode('blob ' || CAST(strlen(text) AS VARCHAR)) || '\\x00'::BLOB || encode(text)) AS sha1 FROM documents")
def blob_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version-control hashes of the texts."""
    return load(spark, sf_dir, "documents").select("doc_id", blob_sha1(F.col("text")).alias("sha1"))


@C.plan(unique_names_sql("SELECT doc_id, source AS raw FROM documents", "doc_id", "name", 96))
def name_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document named after its source: a name that a tenth of all rows share, numbered by ranges, each name once."""
    return numbered_slugs(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", F.col("source"), 96).select("doc_id", F.col("slug").alias("name"))


@C.plan(f"""
    WITH {PUB}, u AS (SELECT id, slug, unnest([1, 2, 3, 4, 5, 6]) AS form FROM pub)
    SELECT id, form, CASE form WHEN 1 THEN '/en/' || slug || '.html' WHEN 2 THEN '/' || slug || '/index.html' WHEN 3 THEN '/javascript:' || slug WHEN 4 THEN '/' || left(sha256(slug), 11) WHEN 5 THEN '/watch' ELSE '/mailto:' || slug || '@a.example' END AS path,
        form <> 3 AS safe, form IN (1, 4, 5) AS safe_image, CASE WHEN form IN (4, 5) THEN left(sha256(slug), 11) END AS video FROM u""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six addresses of every publication: their paths, whether they are safe as links and for images, and ids of videos."""
    p = publications(spark, sf_dir).select("id", "slug", F.left(F.sha2("slug", 256), F.lit(11)).alias("v"))
    say = lambda *x: F.concat(*[F.lit(y) if not y.startswith("$") else F.col(y[1:]) for y in x])
    forms = F.array(say("https://a.example/en/", "$slug", ".html?q=1#z"), say("/", "$slug", "/"), say("javascript:", "$slug"), say("https://youtu.be/", "$v"), say("https://v.example/watch?v=", "$v", "&t=3"), say("mailto:", "$slug", "@a.example"))
    u = p.select("id", F.posexplode(forms).alias("at", "url"))
    c = F.col("url")
    return u.select("id", (F.col("at") + 1).alias("form"), page_path(c).alias("path"), safe_url(c).isNotNull().alias("safe"), safe_url(c, image=True).isNotNull().alias("safe_image"), video_id(c).alias("video"))


@C.plan(f"""
    WITH {PUB}, m AS (SELECT id, slug, unnest(CASE WHEN language_mode = 'both' THEN ['en', 'kha'] ELSE [coalesce(nullif(language_mode, ''), 'en')] END) AS lang, coalesce(published_at, scheduled_at, created_at) AS at FROM pub WHERE status = 'published'),
    u AS (SELECT '/' || lang || '/' || slug AS path, 1 AS origin, id FROM m UNION ALL SELECT '/en/' || slug, 2, id FROM pub WHERE status = 'published')
    SELECT path, min(origin) AS origin, min_by(id, origin * 1000000 + id) AS id FROM u GROUP BY path""")
def sitemap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of two origins, one by language, the first kept."""
    p = publications(spark, sf_dir).where("status = 'published'")
    langs = F.when(F.col("language_mode") == "both", F.array(F.lit("en"), F.lit("kha"))).otherwise(F.array(F.coalesce(F.nullif("language_mode", F.lit("")), F.lit("en"))))
    a = p.select(F.explode(langs).alias("lang"), "slug", "id").select(F.concat_ws("/", F.lit(""), "lang", "slug").alias("path"), F.lit(1).alias("origin"), "id")
    b = p.select(F.concat(F.lit("/en/"), "slug").alias("path"), F.lit(2).alias("origin"), "id")
    return a.unionByName(b).groupBy("path").agg(F.min(F.struct("origin", "id")).alias("x")).select("path", "x.origin", "x.id")


@C.plan(f"WITH {PUB} SELECT '<url><loc>/' || slug || '</loc><lastmod>' || strftime(make_timestamp(epoch_us(published_at)), '%Y-%m-%d') || '</lastmod></url>' AS line FROM pub WHERE status = 'published'")
def sitemap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site map elements."""
    p = publications(spark, sf_dir).where("status = 'published'").withColumn("u", F.concat(F.lit("/"), "slug"))
    return sitemap_entries(p, "u", "published_at")


@C.plan("SELECT '| ' || source || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY source")
def matrix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as lines of a table."""
    return markdown_rows(load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), ["source", "n"])


#: The tables and their keys.
_TABLES = {
    "chat_exchanges": ["exchange_id"], "cms_publications": ["id"], "contact_messages": ["id"], "customer": ["c_custkey"], "documents": ["doc_id"], "embeddings": ["vec_id"], "events": ["event_id"], "grc_tokens": ["id"], "lineitem": ["l_orderkey", "l_linenumber"], "mass_intention_requests": ["id"], "mix_targets": ["source"],
    "nation": ["n_nationkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "place_list": ["entry_id"], "prayer_network_requests": ["id"], "priest_registrations": ["id"], "region": ["r_regionkey"], "size_limits": ["task", "record_table", "field_name"], "supplier": ["s_suppkey"], "text_blocks": ["block_id"],
}


@C.plan(" UNION ALL ".join(f"SELECT '{t}' AS name, CAST((SELECT count(*) FROM {t}) AS BIGINT) AS n_rows, CAST((SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {t})) AS BIGINT) AS n_keys, true AS has_digest" for t, k in _TABLES.items()))
def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, keys and digest of every table."""
    m = reduce(DataFrame.unionByName, [manifest(load(spark, sf_dir, t), t, keys) for t, keys in _TABLES.items()])
    return m.select("name", "n_rows", "n_keys", F.col("digest").isNotNull().alias("has_digest"))


@C.plan("""
    WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 8))) AS w FROM documents)
    SELECT w AS word, CAST(count(*) AS BIGINT) AS n_docs, min(doc_id) AS first_doc FROM w GROUP BY w""")
def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index over long words."""
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(terms(F.col("text"), 8)).alias("word")).groupBy("word").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


C.statement("markup_share", "SELECT DISTINCT id, length(body_en) - length(regexp_replace(body_en, '<[^>]*>', '')) AS markup FROM {cms_publications} WHERE body_en IS NOT NULL", "SELECT DISTINCT id, length(body_en) - length(regexp_replace(body_en, '<[^>]*>', '', 'g')) AS markup FROM {cms_publications} WHERE body_en IS NOT NULL")

HOUR = 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))


@C.plan("SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_trailing FROM events")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the user in the trailing six hours."""
    return trailing_counts(_events(spark, sf_dir), "user_id", "at_us", 6 * HOUR).select("event_id", "user_id", "n_trailing")


@C.plan("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, [t] AS win, true AS ok FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN len(list_filter(r.win, lambda x: x >= e.t - 86400000000)) < 2 THEN list_append(list_filter(r.win, lambda x: x >= e.t - 86400000000), e.t) ELSE list_filter(r.win, lambda x: x >= e.t - 86400000000) END,
                 len(list_filter(r.win, lambda x: x >= e.t - 86400000000)) < 2 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT CAST(user_id AS VARCHAR) AS k, event_id, ok AS admitted FROM r""")
def rate_limit_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events a day for each user, only admitted ones counted."""
    return limit_table(_events(spark, sf_dir), "user_id", "at_us", "event_id", 2, 24 * HOUR).select("k", F.col("tie").alias("event_id"), "admitted")


@C.plan("""
    WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) AS t, event_id, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS n FROM events),
    r AS (SELECT n, k, t, [{'t': t, 'k': k}] AS win, 1 AS used, CAST(NULL AS VARCHAR) AS why FROM e WHERE n = 1
          UNION ALL SELECT n, k, t, CASE WHEN why IS NULL THEN list_append(live, {'t': t, 'k': k}) ELSE live END, today + CASE WHEN why IS NULL THEN 1 ELSE 0 END, why FROM (
            SELECT *, CASE WHEN len(list_filter(live, lambda x: x.k = s.k)) >= 2 THEN 'key' WHEN len(live) >= 40 THEN 'all' WHEN today >= 120 THEN 'day' END AS why FROM (
              SELECT e.n, e.k, e.t, list_filter(r.win, lambda x: x.t > e.t - 21600000000) AS live, CASE WHEN e.t // 86400000000 = r.t // 86400000000 THEN r.used ELSE 0 END AS today FROM r JOIN e ON e.n = r.n + 1) s))
    SELECT CAST(k AS VARCHAR) AS k, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (why IS NULL) AS BIGINT) AS n_admitted, CAST(count(*) FILTER (why = 'day') AS BIGINT) AS n_by_day FROM r GROUP BY k""")
def rate_limit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits by user, over all users and by day."""
    return limit_tiers(_events(spark, sf_dir), "user_id", "at_us", "event_id", 2, 40, 6 * HOUR, 120).groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("refused_by").isNull()).alias("n_admitted"), F.count_if(F.col("refused_by") == "day").alias("n_by_day"))


@C.plan("""
    WITH l AS (SELECT event_id, user_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS gap FROM events)
    SELECT event_id, coalesce(gap <= 3600000000, false) AS replayed FROM l""")
def nonce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose key came within the hour before."""
    return replays(_events(spark, sf_dir), ["user_id", "event_type"], "at_us", "event_id", HOUR).select("event_id", "replayed")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


@C.plan(f"SELECT user_id, CAST(sum(CAST(('0x' || substr(sha256({' || chr(124) || '.join(_FIELD.format(c) for c in ('user_id', 'event_id', 'event_type'))}), 1, 12)) AS BIGINT)) AS VARCHAR) AS signature, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def feed_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature per user that changes when any row does."""
    return signatures(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"])


@C.plan(r"""
    WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n((?i:chap|book|homily)\b)', chr(10) || chr(10) || '\1', 'g'), '\.\n([IVXLC]+\.\n)', '.' || chr(10) || chr(10) || '\1', 'g') AS text FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(text, '\n\s*\n')), '\s+', ' ', 'g'), ' ') AS p FROM t)
    SELECT doc_id, CASE WHEN regexp_matches(p, '^(?:(?:CHAP(?:TER)?|BOOK|HOMILY)\b.*|[IVXLC]+\.)$') THEN 'heading' ELSE 'paragraph' END AS kind, CAST(count(*) AS BIGINT) AS n FROM p WHERE p <> '' GROUP BY ALL""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and paragraphs of plain texts."""
    return sections(load(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


QUERIES, SQL = C.queries, C.sql
