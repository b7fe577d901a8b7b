"""Data-quality checks: each returns the rows that break a rule; no rows mean that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.versify import violations
from quire.plans.kit import Catalogue
from quire.tables import load

C = Catalogue()

C.statement("check_unique_names", "SELECT title_en, CAST(count(DISTINCT id) AS BIGINT) AS n FROM {cms_publications} WHERE title_en IS NOT NULL GROUP BY title_en HAVING count(DISTINCT id) > 1")
C.statement("check_place_countries", "SELECT DISTINCT p.id FROM {priest_registrations} p LEFT ANTI JOIN (SELECT entry_name FROM {place_list} WHERE list_name = 'country') c ON p.country = c.entry_name WHERE p.country IS NOT NULL", "SELECT DISTINCT p.id FROM {priest_registrations} p WHERE p.country IS NOT NULL AND p.country NOT IN (SELECT entry_name FROM {place_list} WHERE list_name = 'country')")
C.statement("check_orders_without_lines", "SELECT o.o_orderkey FROM {orders} o LEFT JOIN (SELECT DISTINCT l_orderkey FROM {lineitem}) l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL")
C.statement("check_repeated_lines", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
C.statement("check_share_sum", "SELECT t.source, round(t.target_share - coalesce(d.n, 0) / d.total, 6) AS off FROM {mix_targets} t LEFT JOIN (SELECT source, count(*) * 1.0D AS n, sum(count(*)) OVER () * 1.0D AS total FROM {documents} GROUP BY source) d ON d.source = t.source WHERE abs(t.target_share - coalesce(d.n, 0) / d.total) > 0.01", "SELECT t.source, round(t.target_share - coalesce(d.n, 0) / d.total, 6) AS off FROM {mix_targets} t LEFT JOIN (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM {documents} GROUP BY source) d ON d.source = t.source WHERE abs(t.target_share - coalesce(d.n, 0) / d.total) > 0.01")
C.statement("check_required_fields", "SELECT DISTINCT id, CASE WHEN trim(coalesce(message, '')) = '' THEN 'message' WHEN trim(coalesce(email, '')) = '' THEN 'email' ELSE 'subject' END AS missing FROM {contact_messages} WHERE trim(coalesce(message, '')) = '' OR trim(coalesce(email, '')) = '' OR trim(coalesce(subject, '')) = ''")
C.statement("check_lengths", "SELECT DISTINCT id, length(intention) AS n FROM {prayer_network_requests} WHERE length(intention) > 400 OR length(name) > 120")
C.statement("check_counts_agree", "SELECT doc_id, n_chars, octet_length(text) AS n FROM {documents} WHERE n_chars <> octet_length(text)", "SELECT doc_id, n_chars, CAST(strlen(text) AS INTEGER) AS n FROM {documents} WHERE n_chars <> strlen(text)")
C.statement("check_contiguous_sections", "SELECT source_id, section_index, CAST(count(DISTINCT block_index) AS BIGINT) AS n, max(block_index) - min(block_index) + 1 AS span FROM {text_blocks} WHERE text IS NOT NULL GROUP BY source_id, section_index HAVING count(DISTINCT block_index) <> max(block_index) - min(block_index) + 1")
C.statement("check_section_words", "SELECT source_id, section_index FROM (SELECT source_id, section_index, sum(CASE WHEN kind = 'paragraph' THEN length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) ELSE 0 END) AS n FROM {text_blocks} GROUP BY source_id, section_index) WHERE n < 90")
C.statement("check_quiz_shape", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) < 5")


@C.plan("SELECT * FROM (VALUES ('unequal sides', 'bad1', '2:1'), ('merge is one to many', 'bad2', '2:1'), ('verse used twice', 'a', '1')) AS t(rule, segment, detail)")
def mapping_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of versification segments on a small literal registry."""
    segs = [("a", "identity", ["1"], ["1"]), ("b", "offset", ["2"], ["1"]), ("bad1", "renumber", ["3", "4"], ["5"]), ("bad2", "merge", ["5", "6"], ["7"]), ("ok", "split", ["7", "8"], ["9"]), ("ok2", "range", ["9"], ["9", "10"])]
    return violations(spark.createDataFrame(segs, "segment string, relationship string, canonical array<string>, source array<string>"))


QUERIES, SQL = C.queries, C.sql
