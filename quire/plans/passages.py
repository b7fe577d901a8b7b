"""References, verses, tokens, lanes, versification and lexicon joins over the Greek witnesses and the block corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.greek import align_key_udf, fold_udf, transliterate_udf
from quire.operators.align import align_tokens
from quire.operators.references import PLACE, lookup, parse_references, render
from quire.operators.versify import resolve
from quire.plans.kit import Catalogue
from quire.tables import load, once

C = Catalogue()

#: One row per token however often delivered; every statement of this module starts from it.
TOK = "tok AS (SELECT DISTINCT id, witness, book_id, chapter, verse, position, surface, transliteration FROM grc_tokens)"


_CHAPTER = ["witness", "book_id", "chapter"]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(load(spark, sf_dir, "grc_tokens"), "loaded_at")


_REFS = ["Luke 2:3", "luke 2", "1 John 3:4-9", "John 3:4", "1  JOHN  2 : 5 – 7", "Luke", "Luke x", "Nowhere 3:4", "Luke 0:1", "Luke 3:9-4", "Luke 3:1-102", "Luke 3:1-101", "2 Peter. 1:5", "", "Acts 5:6 7"]


@C.plan(rf"""
    WITH refs(ref) AS (VALUES {", ".join(f"('{r}')" for r in _REFS)} UNION SELECT DISTINCT upper(book_id) || '  ' || chapter || ' : ' || verse || '–' || (CAST(verse AS INTEGER) + 2) FROM grc_tokens UNION SELECT DISTINCT regexp_replace(book_id, '^([0-9])', '\1 ') || '. ' || chapter FROM grc_tokens),
    f AS (SELECT ref, regexp_replace(lower(trim(regexp_replace(translate(ref, '–—.', '--'), '\s+', ' ', 'g'))), '\s*([:-])\s*', '\1', 'g') AS f FROM refs),
    al AS (SELECT DISTINCT book_id, regexp_replace(book_id, '^([0-9])', '\1 ') AS alias FROM grc_tokens UNION SELECT DISTINCT book_id, book_id FROM grc_tokens),
    m AS (SELECT f.ref, f.f, max_by(struct_pack(book_id, alias), length(alias)) AS b FROM f LEFT JOIN al ON f.f = alias OR starts_with(f.f, alias || ' ') GROUP BY f.ref, f.f),
    r AS (SELECT ref, b.book_id AS book_id, trim(substring(f, length(b.alias) + 1)) AS rest FROM m),
    p AS (SELECT *, TRY_CAST(regexp_extract(rest, '{PLACE}', 1) AS INTEGER) AS chapter, TRY_CAST(regexp_extract(rest, '{PLACE}', 2) AS INTEGER) AS verse_from, coalesce(TRY_CAST(regexp_extract(rest, '{PLACE}', 3) AS INTEGER), TRY_CAST(regexp_extract(rest, '{PLACE}', 2) AS INTEGER)) AS verse_to FROM r)
    SELECT ref, book_id, chapter, verse_from, verse_to, CASE WHEN book_id IS NULL THEN 'unknown' WHEN rest = '' THEN 'chapter required' WHEN NOT regexp_matches(rest, '{PLACE}') THEN 'malformed'
        WHEN chapter = 0 OR coalesce(verse_from, 1) = 0 OR coalesce(verse_to, 1) = 0 THEN 'zero' WHEN verse_to < verse_from THEN 'inverted' WHEN verse_to - verse_from > 100 THEN 'too long' ELSE 'ok' END AS status FROM p""")
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to every verse and chapter in untidy spellings, and odd ones, resolved against the books, longest alias first."""
    t = load(spark, sf_dir, "grc_tokens").select("book_id", "chapter", "verse").distinct()
    verse = F.concat(F.upper("book_id"), F.lit("  "), F.col("chapter"), F.lit(" : "), F.col("verse"), F.lit("–"), F.col("verse").cast("int") + 2)
    spaced = F.regexp_replace("book_id", "^([0-9])", "$1 ")
    refs = spark.createDataFrame([(r,) for r in _REFS], "ref string").union(t.select(verse)).union(t.select(F.concat(spaced, F.lit(". "), F.col("chapter")))).distinct()
    books = t.select("book_id").distinct()
    return parse_references(refs, "ref", books.select("book_id", spaced.alias("alias")).union(books.select("book_id", "book_id")).distinct())


_VERSES = f"""{TOK}, v AS (SELECT witness, book_id, chapter, verse, CAST(verse AS INTEGER) AS n, string_agg(surface, ' ' ORDER BY position, id) AS text FROM tok GROUP BY ALL)"""


def verse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of a verse joined in order."""
    g = tokens(spark, sf_dir).groupBy("witness", "book_id", "chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("position", "id", "surface"))).alias("x"))
    return g.select("witness", "book_id", "chapter", "verse", F.array_join("x.surface", " ").alias("text"))


@C.plan(f"WITH {_VERSES} SELECT witness, book_id, chapter, CAST(count(*) AS INTEGER) AS n_verses, CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg(verse || ' ' || text, ' ' ORDER BY n, verse) END AS passage FROM v GROUP BY witness, book_id, chapter")
def passage_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as passages: one verse bare, several numbered, in canon order."""
    return render(verse_texts(spark, sf_dir), ["witness", "book_id", "chapter"])


@C.plan(f"""
    WITH {_VERSES}, w AS (SELECT witness, book_id, chapter, unnest(range(1, max(n) + 1)) AS verse_no FROM v GROUP BY witness, book_id, chapter)
    SELECT w.witness, w.book_id, w.chapter, CAST(verse_no AS INTEGER) AS verse_no, v.verse, CASE WHEN v.verse IS NOT NULL THEN false END AS bridge FROM w LEFT JOIN v ON w.witness = v.witness AND w.book_id = v.book_id AND w.chapter = v.chapter AND v.n = verse_no""")
def verse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number up to the last verse of a chapter looked up in it; labels that cover several numbers are expanded first, so that it is an equi-join."""
    v = tokens(spark, sf_dir).select(*_CHAPTER, "verse").distinct()
    wanted = v.groupBy(*_CHAPTER).agg(F.max(F.col("verse").cast("int")).alias("last")).select(*_CHAPTER, F.explode(F.sequence(F.lit(1), "last")).alias("verse_no"))
    return lookup(wanted, v, _CHAPTER)


@C.plan(f"""
    WITH {TOK} SELECT book_id, coalesce(CAST(chapter AS VARCHAR), 'all') AS chapter, CAST(count(DISTINCT verse) AS BIGINT) AS n_verses, CAST(count(*) AS BIGINT) AS n_tokens, CAST(min(position) AS INTEGER) AS least, CAST(max(position) AS INTEGER) AS greatest
    FROM tok GROUP BY GROUPING SETS ((book_id, chapter), (book_id))""")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses and tokens by chapter and book in one pass."""
    t = tokens(spark, sf_dir)
    g = t.groupingSets([["book_id", "chapter"], ["book_id"]], "book_id", "chapter").agg(F.countDistinct("verse").alias("n_verses"), F.count("*").alias("n_tokens"), F.min("position").alias("least"), F.max("position").alias("greatest"))
    return g.withColumn("chapter", F.coalesce(F.col("chapter").cast("string"), F.lit("all")))


@C.plan(f"""
    WITH {TOK} SELECT id, upper(book_id) || '-' || chapter || '-' || verse || '-GR-' || lpad(CAST(row_number() OVER (PARTITION BY witness, book_id, chapter, verse ORDER BY position, id) AS VARCHAR), 3, '0') AS token_id FROM tok""")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running position within the verse, and the id made from it."""
    w = Window.partitionBy("witness", "book_id", "chapter", "verse").orderBy("position", "id")
    return tokens(spark, sf_dir).select("id", F.concat_ws("-", F.upper("book_id"), "chapter", "verse", F.lit("GR"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")).alias("token_id"))


@C.plan(f"""
    WITH {TOK}, s AS (SELECT witness, book_id, chapter, verse, CAST(count(*) AS BIGINT) AS n_surface FROM tok GROUP BY ALL),
    l AS (SELECT witness, book_id, chapter, verse, CAST(count(*) AS BIGINT) AS n_read FROM tok WHERE transliteration IS NOT NULL GROUP BY ALL),
    a AS (SELECT book_id, chapter, verse, CAST(count(DISTINCT witness) AS BIGINT) AS n_witnesses FROM tok GROUP BY ALL)
    SELECT s.*, coalesce(n_read, 0) AS n_read, CASE WHEN n_read IS NULL THEN 'unavailable' ELSE 'available' END AS status, n_witnesses FROM s LEFT JOIN l USING (witness, book_id, chapter, verse) LEFT JOIN a USING (book_id, chapter, verse)""")
def layer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface, reading and alignment layers of each verse, a missing layer as such."""
    t, v = tokens(spark, sf_dir), ["witness", "book_id", "chapter", "verse"]
    s = t.groupBy(*v).agg(F.count("*").alias("n_surface"))
    lay = t.where("transliteration is not null").groupBy(*v).agg(F.count("*").alias("n_read"))
    a = t.groupBy(*v[1:]).agg(F.countDistinct("witness").alias("n_witnesses"))
    return s.join(lay, v, "left").join(a, v[1:], "left").withColumn("status", F.when(F.col("n_read").isNull(), "unavailable").otherwise("available")).withColumn("n_read", F.coalesce("n_read", F.lit(0)))


_PAIRS = f"""{TOK}, t AS (SELECT *, CAST(verse AS INTEGER) AS n FROM tok),
    p AS (SELECT x.book_id, x.surface AS a, y.surface AS b FROM t x JOIN t y ON x.witness = y.witness AND x.book_id = y.book_id AND x.chapter = y.chapter AND x.position = y.position AND y.n = x.n + 1),
    c AS (SELECT *, CASE WHEN a = b THEN 'exact' WHEN lower(regexp_replace(a, '[.,;·’⸀⸁⸂]', '', 'g')) = lower(regexp_replace(b, '[.,;·’⸀⸁⸂]', '', 'g')) THEN 'normalized' ELSE 'gap' END AS mode FROM p)"""

def neighbours(t: DataFrame, *cols: str) -> DataFrame:
    """Tokens at the same place of a verse and the next: two sequences to compare. ``b_*`` are the next verse's."""
    x = t.withColumn("n", F.col("verse").cast("int") + 1)
    y = t.select(*_CHAPTER, F.col("verse").cast("int").alias("n"), "position", *[F.col(c).alias(f"b_{c}") for c in cols])
    return x.join(y, [*_CHAPTER, "n", "position"])


@C.plan(f"WITH {_PAIRS} SELECT coalesce(book_id, 'all') AS book_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (mode = 'exact') AS BIGINT) AS n_exact, CAST(count(*) FILTER (mode = 'normalized') AS BIGINT) AS n_normalized, CAST(count(*) FILTER (mode = 'gap') AS BIGINT) AS n_gap FROM c GROUP BY GROUPING SETS ((book_id), ())")
def token_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two token sequences place by place: equal, equal without marks, or different, by book and in all."""
    bare = lambda c: F.lower(F.translate(c, ".,;·’⸀⸁⸂", ""))
    c = neighbours(tokens(spark, sf_dir), "surface").withColumn("mode", F.when(F.col("surface") == F.col("b_surface"), "exact").when(bare("surface") == bare("b_surface"), "normalized").otherwise("gap"))
    n = lambda m: F.count_if(F.col("mode") == m)
    return c.groupingSets([["book_id"], []], "book_id").agg(F.count("*").alias("n"), n("exact").alias("n_exact"), n("normalized").alias("n_normalized"), n("gap").alias("n_gap")).withColumn("book_id", F.coalesce("book_id", F.lit("all")))


@C.plan()
def align_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each verse aligned to those of the next: same place first, then in order."""
    t = tokens(spark, sf_dir).withColumn("key", align_key_udf("surface")).withColumn("n", F.col("verse").cast("int"))
    left = t.select(*_CHAPTER, "n", "position", "id", "key")
    right = t.select(*_CHAPTER, (F.col("n") - 1).alias("n"), F.col("position").alias("base_position"), F.col("id").alias("base_id"), F.col("key").alias("base_key"))
    return align_tokens(left, right, [*_CHAPTER[1:], "n"], "witness")


@C.plan(f"WITH {TOK} SELECT surface, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT witness) AS BIGINT) AS n_witnesses, min(id) AS first_id FROM tok GROUP BY surface")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word -> occurrences, witnesses, first token."""
    return tokens(spark, sf_dir).groupBy("surface").agg(F.count("*").alias("n_tokens"), F.countDistinct("witness").alias("n_witnesses"), F.min("id").alias("first_id"))


_LEX = [(1, "logos", "logos", "word"), (2, "ho", "ho1", "the"), (3, "ho", "ho", "the (article)"), (4, "kai", "kai2", "and"), (5, "theos", "theos", "god"), (6, "en", "en", "in"), (7, "patēr", "patēr", "father")]


@C.plan(f"""
    WITH {TOK}, lex(idx, alias, strict_key, gloss) AS (VALUES {", ".join(str(x) for x in _LEX)}), t AS (SELECT DISTINCT transliteration AS k FROM tok WHERE transliteration IS NOT NULL),
    m AS (SELECT k, idx, gloss, 0 AS lvl, strict_key FROM t JOIN lex ON alias = k UNION ALL SELECT k, idx, gloss, 1, strict_key FROM t JOIN lex ON alias = regexp_replace(k, '(s|n)$', '') AND alias <> k),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lvl, CASE WHEN strict_key = k THEN 0 ELSE 1 END, idx) AS rn FROM m)
    SELECT t.k AS lemma, r.idx AS entry, r.gloss, r.lvl AS fallback_level FROM t LEFT JOIN r ON r.k = t.k AND rn = 1""")
def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias lookup with a fallback form, a strict key before the first entry (J07-J09). The lexicon is a small literal table."""
    lex = F.broadcast(spark.createDataFrame(_LEX, "idx int, alias string, strict_key string, gloss string"))
    t = load(spark, sf_dir, "grc_tokens").select(F.col("transliteration").alias("k")).where("k is not null").distinct()
    direct = t.join(lex, F.col("alias") == F.col("k")).withColumn("lvl", F.lit(0))
    loose = t.join(lex, (F.col("alias") == F.regexp_replace("k", "(s|n)$", "")) & (F.col("alias") != F.col("k"))).withColumn("lvl", F.lit(1))
    best = direct.unionByName(loose).groupBy("k").agg(F.min(F.struct("lvl", F.when(F.col("strict_key") == F.col("k"), 0).otherwise(1).alias("s"), "idx", "gloss")).alias("m"))
    return t.join(best, "k", "left").select(F.col("k").alias("lemma"), F.col("m.idx").alias("entry"), F.col("m.gloss").alias("gloss"), F.col("m.lvl").alias("fallback_level"))


@C.plan(f"""
    WITH {TOK}, lex AS (SELECT transliteration AS k FROM tok WHERE transliteration IS NOT NULL GROUP BY 1 HAVING count(*) >= 20), x AS (SELECT book_id, (transliteration IN (SELECT k FROM lex)) AS known FROM tok WHERE transliteration IS NOT NULL AND regexp_matches(transliteration, '^[a-zēō]'))
    SELECT coalesce(book_id, 'all') AS book_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (known) AS BIGINT) AS n_known, round(count(*) FILTER (known) * 1.0 / greatest(1, count(*)), 6) AS ratio FROM x GROUP BY GROUPING SETS ((book_id), ())""")
def lexicon_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tokens, names aside, whose form the lexicon holds, by book and in all."""
    t = tokens(spark, sf_dir).where("transliteration is not null")
    lex = t.groupBy(F.col("transliteration").alias("k")).agg(F.count("*").alias("c")).where("c >= 20").select("k", F.lit(True).alias("known"))
    x = t.where(F.col("transliteration").rlike("^[a-zēō]")).groupBy("book_id", "transliteration").agg(F.count("*").alias("c")).join(lex, F.col("transliteration") == F.col("k"), "left")
    g = x.groupingSets([["book_id"], []], "book_id").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("known"), F.col("c"))), F.lit(0)).alias("n_known"))
    return g.select(F.coalesce("book_id", F.lit("all")).alias("book_id"), "n", "n_known", F.round(F.col("n_known") / F.greatest(F.lit(1), "n"), 6).alias("ratio"))


_TWO = "a AS (SELECT DISTINCT book_id, chapter, verse FROM tok WHERE right(witness, 1) < '5'), b AS (SELECT DISTINCT book_id, chapter, verse FROM tok WHERE right(witness, 1) >= '5')"


@C.plan(f"WITH {TOK}, {_TWO} SELECT coalesce(a.book_id, b.book_id) AS book_id, CAST(count(*) FILTER (b.verse IS NULL) AS BIGINT) AS left_only, CAST(count(*) FILTER (a.verse IS NULL) AS BIGINT) AS right_only, CAST(count(*) FILTER (a.verse IS NOT NULL AND b.verse IS NOT NULL) AS BIGINT) AS both_sides FROM a FULL JOIN b ON a.book_id = b.book_id AND a.chapter = b.chapter AND a.verse = b.verse GROUP BY 1")
def verse_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses that only one of two groups of witnesses has, by book."""
    t = tokens(spark, sf_dir).withColumn("side", F.right("witness", F.lit(1)) < "5")
    v = t.groupBy("book_id", "chapter", "verse").agg(F.max("side").alias("l"), F.max(~F.col("side")).alias("r"))
    return v.groupBy("book_id").agg(F.count_if(F.col("l") & ~F.col("r")).alias("left_only"), F.count_if(F.col("r") & ~F.col("l")).alias("right_only"), F.count_if(F.col("l") & F.col("r")).alias("both_sides"))


@C.plan(f"""
    WITH {TOK}, {_TWO}, x AS (SELECT book_id, chapter, list_sort(list(verse)) AS vs FROM a GROUP BY ALL), y AS (SELECT book_id, chapter, list_sort(list(verse)) AS vs FROM b GROUP BY ALL)
    SELECT coalesce(x.book_id, y.book_id) AS book_id, coalesce(x.chapter, y.chapter) AS chapter, CASE WHEN x.vs = y.vs THEN 'exact' WHEN x.vs IS NULL OR y.vs IS NULL THEN 'one-sided' ELSE 'mapping-required' END AS gate FROM x FULL JOIN y ON x.book_id = y.book_id AND x.chapter = y.chapter""")
def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose verse sets agree between two groups of witnesses (J15). One aggregate, no sets are moved for comparison."""
    t = tokens(spark, sf_dir).withColumn("side", F.right("witness", F.lit(1)) < "5")
    v = t.groupBy("book_id", "chapter", "verse").agg(F.max("side").alias("l"), F.max(~F.col("side")).alias("r"))
    g = v.groupBy("book_id", "chapter").agg(F.count_if("l").alias("nl"), F.count_if("r").alias("nr"), F.count_if(F.col("l") & F.col("r")).alias("nb"))
    gate = F.when((F.col("nl") == 0) | (F.col("nr") == 0), "one-sided").when((F.col("nl") == F.col("nb")) & (F.col("nr") == F.col("nb")), "exact").otherwise("mapping-required")
    return g.select("book_id", "chapter", gate.alias("gate"))


#: segment, relationship, canonical verses, source verses
_MAP = [("s1", "identity", ["1", "2"], ["1", "2"]), ("s2", "offset", ["3", "4"], ["4", "5"]), ("s3", "merge", ["5"], ["6", "7"]), ("s4", "split", ["6", "7"], ["8"]), ("s5", "range", ["8", "9"], ["9", "10"]), ("s6", "canonical-only", ["10"], []), ("s7", "range", ["11", "12"], ["11"])]
_EDGES = [("s1", "1", "1"), ("s1", "2", "2"), ("s2", "3", "4"), ("s2", "4", "5"), ("s3", "5", "6"), ("s3", "5", "7"), ("s4", "6", "8"), ("s4", "7", "8"), ("s5", "8", "9"), ("s5", "9", "10"), ("s6", "10", None)]


@C.plan(f"""
    WITH {TOK}, e(segment, canon, src) AS (VALUES {", ".join("('%s', '%s', %s)" % (a, b, "NULL" if c is None else f"'{c}'") for a, b, c in _EDGES)} UNION ALL SELECT 's7', '11', NULL UNION ALL SELECT 's7', '12', NULL),
    c AS (SELECT DISTINCT book_id, chapter FROM tok), t AS (SELECT book_id, chapter, verse, CAST(count(*) AS BIGINT) AS n_tokens FROM tok GROUP BY ALL)
    SELECT c.book_id, c.chapter, segment, canon AS canonical_verse, src AS source_verse, CASE WHEN segment = 's7' THEN 'ambiguous' WHEN src IS NULL THEN 'canonical-only' WHEN n_tokens IS NULL THEN 'missing' ELSE 'ok' END AS status, n_tokens FROM e CROSS JOIN c LEFT JOIN t ON t.verse = src AND t.book_id = c.book_id AND t.chapter = c.chapter""")
def mapping_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical verses of every chapter brought to the source's numbering, and joined to it; unequal ranges are ambiguous.

    A registry of seven segments stands for each chapter's own; both are small, a canon has some thousand chapters.
    """
    segs = spark.createDataFrame(_MAP, "segment string, relationship string, canonical array<string>, source array<string>")
    t = tokens(spark, sf_dir).groupBy("book_id", "chapter", F.col("verse").alias("source_verse")).agg(F.count("*").alias("n_tokens"))
    c = t.select("book_id", "chapter").distinct()
    r = resolve(segs).crossJoin(F.broadcast(c)).join(t, ["book_id", "chapter", "source_verse"], "left")  # seven segments a chapter
    return r.select("book_id", "chapter", "segment", "canonical_verse", "source_verse", F.when(F.col("status") != "ok", F.col("status")).when(F.col("n_tokens").isNull(), "missing").otherwise("ok").alias("status"), "n_tokens")


_LANES = f"""{TOK}, spine AS (SELECT DISTINCT book_id, chapter, verse FROM tok),
    g AS (SELECT book_id, chapter, verse, CAST(count(*) FILTER (right(witness, 1) = '1') AS BIGINT) AS l1, CAST(count(*) FILTER (right(witness, 1) = '2') AS BIGINT) AS l2, CAST(count(*) FILTER (right(witness, 1) = '3') AS BIGINT) AS l3 FROM tok GROUP BY ALL),
    x AS (SELECT spine.*, CASE WHEN l1 > 0 THEN 'available' ELSE 'gap' END AS lane_a, CASE WHEN l2 > 0 THEN 'available' ELSE 'gap' END AS lane_b, CASE WHEN l3 > 0 THEN 'available' ELSE 'gap' END AS lane_c, CASE WHEN l1 > 0 THEN 'a' WHEN l2 > 0 THEN 'b' WHEN l3 > 0 THEN 'c' END AS preferred FROM spine JOIN g USING (book_id, chapter, verse))"""


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    g = t.withColumn("lane", F.right("witness", F.lit(1))).groupBy("book_id", "chapter", "verse").pivot("lane", ["1", "2", "3"]).count()
    has = lambda k: F.coalesce(k, F.lit(0)) > 0
    lane = lambda k: F.when(has(k), "available").otherwise("gap")
    return g.select("book_id", "chapter", "verse", lane("1").alias("lane_a"), lane("2").alias("lane_b"), lane("3").alias("lane_c"), F.when(has("1"), "a").when(has("2"), "b").when(has("3"), "c").alias("preferred"))


@C.plan(f"WITH {_LANES} SELECT * FROM x")
def lane_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lanes side by side on the spine of verses, each with its state, and the lane that takes precedence (J16, J17). One pivot instead of three joins."""
    return lanes(spark, sf_dir)


@C.plan(f"WITH {_LANES} SELECT book_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (lane_a = 'gap') AS BIGINT) AS gap_a, CAST(count(*) FILTER (lane_b = 'gap') AS BIGINT) AS gap_b, CAST(count(*) FILTER (lane_c = 'gap') AS BIGINT) AS gap_c, bool_or(preferred IS NULL) AS any_open, CAST(count(DISTINCT preferred) AS BIGINT) AS n_lanes FROM x GROUP BY book_id")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps by lane and book."""
    gap = lambda k: F.count_if(F.col(k) == "gap")
    return lanes(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("n"), gap("lane_a").alias("gap_a"), gap("lane_b").alias("gap_b"), gap("lane_c").alias("gap_c"), F.bool_or(F.col("preferred").isNull()).alias("any_open"), F.countDistinct("preferred").alias("n_lanes"))


C.statement("duplicate_keys", "SELECT id, CAST(count(*) AS BIGINT) AS deliveries FROM {grc_tokens} GROUP BY id HAVING count(*) > 1")
C.statement(
    "position_gaps",
    "SELECT witness, book_id, chapter, verse, CAST(count(DISTINCT position) AS BIGINT) AS n, max(position) - min(position) + 1 AS span FROM {grc_tokens} WHERE transliteration IS NOT NULL GROUP BY witness, book_id, chapter, verse HAVING count(DISTINCT position) <> max(position) - min(position) + 1",
)
C.statement("language_set", "SELECT source, array_join(array_sort(collect_set(lang)), ',') AS langs FROM {documents} WHERE lang IS NOT NULL GROUP BY source", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM {documents} WHERE lang IS NOT NULL GROUP BY source")
C.statement("missing_loci", "SELECT source_id, CAST(count(DISTINCT block_id) AS BIGINT) AS n, array_join(transform(array_sort(collect_set(block_id)), x -> cast(x AS string)), ',') AS loci FROM {text_blocks} WHERE text IS NULL GROUP BY source_id", "SELECT source_id, CAST(count(DISTINCT block_id) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(list(block_id))), ',') AS loci FROM {text_blocks} WHERE text IS NULL GROUP BY source_id")
C.statement("value_counts", "SELECT scope, needs_human_follow_up, CAST(count(DISTINCT exchange_id) AS BIGINT) AS n FROM {chat_exchanges} GROUP BY scope, needs_human_follow_up")
C.statement("component_route", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, r.component, l.l_quantity - r.offset_by AS shifted FROM {lineitem} l JOIN (SELECT * FROM VALUES (1, 10, 'A', 0), (11, 23, 'B', 10), (24, 40, 'C', 23) AS t(lo, hi, component, offset_by)) r ON l.l_quantity BETWEEN r.lo AND r.hi", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, r.component, l.l_quantity - r.offset_by AS shifted FROM {lineitem} l JOIN (VALUES (1, 10, 'A', 0), (11, 23, 'B', 10), (24, 40, 'C', 23)) AS r(lo, hi, component, offset_by) ON l.l_quantity BETWEEN r.lo AND r.hi")


@C.plan(f"""
    WITH {TOK}, r(rule_id, book, lo, hi, label) AS (VALUES (1, 'luke', 1, 2, 'infancy'), (2, 'luke', 2, 9, 'galilee'), (3, 'luke', NULL, NULL, 'luke'), (4, 'acts', 3, NULL, 'acts late')),
    p AS (SELECT DISTINCT book_id, chapter FROM tok)
    SELECT book_id, chapter, min_by(label, rule_id) AS label FROM p JOIN r ON book = book_id AND chapter BETWEEN coalesce(lo, 1) AND coalesce(hi, 999) GROUP BY book_id, chapter""")
def interval_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule whose interval holds the chapter, open ends allowed (J26). An equi-join on the book, then the interval."""
    r = spark.createDataFrame([(1, "luke", 1, 2, "infancy"), (2, "luke", 2, 9, "galilee"), (3, "luke", None, None, "luke"), (4, "acts", 3, None, "acts late")], "rule_id int, book_id string, lo int, hi int, label string")
    p = load(spark, sf_dir, "grc_tokens").select("book_id", "chapter").distinct()
    hit = p.join(F.broadcast(r), "book_id").where(F.col("chapter").between(F.coalesce("lo", F.lit(1)), F.coalesce("hi", F.lit(999))))
    return hit.groupBy("book_id", "chapter").agg(F.min(F.struct("rule_id", "label")).alias("x")).select("book_id", "chapter", "x.label")


@C.plan()
def greek_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded key, alignment key and transliteration of each distinct surface."""
    s = load(spark, sf_dir, "grc_tokens").select("surface").distinct()
    return s.select("surface", fold_udf("surface").alias("fold"), align_key_udf("surface").alias("align_key"), transliterate_udf("surface").alias("latin"))


@C.plan(f"WITH {TOK} SELECT book_id, id, surface FROM (SELECT *, row_number() OVER (PARTITION BY book_id, surface ORDER BY id) AS k FROM tok) WHERE k = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First token of each surface in a book (A15, W06) as an aggregate, without a window."""
    return tokens(spark, sf_dir).groupBy("book_id", "surface").agg(F.min("id").alias("id")).select("book_id", "id", "surface")


QUERIES, SQL = C.queries, C.sql
