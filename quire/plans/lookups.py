"""Passages, lexicon and form lookups, chains of references, coverage and layer checks, page and record filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.greek import align_key_udf, ascii_udf, build_key_udf, fold_udf, nfkc_udf
from quire.functions.text import all_strongs, capped, first_strong, markup_free, or_default, reference
from quire.operators import lookups as L
from quire.operators.changes import duplicate_as_draft, soft_delete
from quire.plans.ingest import PUB, publications
from quire.plans.kit import Catalogue
from quire.plans.passages import _VERSES, TOK, tokens, verse_texts
from quire.plans.reading import _LEX, _NO, _lexicon_lines
from quire.sources import readers
from quire.tables import load, lookup, once

C = Catalogue()

_ASKED = f"""WITH {_VERSES}, r AS (SELECT DISTINCT witness, book_id, chapter, n AS verse_from, n + CAST(length(book_id) % 3 AS INTEGER) AS verse_to FROM v),
    x AS (SELECT r.*, unnest(range(verse_from, verse_to + 1)) AS k FROM r), j AS (SELECT x.*, v.verse, v.text FROM x LEFT JOIN v ON v.witness = x.witness AND v.book_id = x.book_id AND v.chapter = x.chapter AND v.n = x.k)"""


def _ranges(v: DataFrame) -> DataFrame:
    n = F.col("verse").cast("int")
    r = v.select("witness", "book_id", "chapter", n.alias("verse_from"), (n + F.length("book_id") % 3).alias("verse_to")).distinct()
    return r.withColumn("ref", F.concat_ws("/", "witness", "book_id", "chapter", "verse_from"))


@C.plan(f"{_ASKED} SELECT witness, book_id, chapter, verse_from, CASE WHEN bool_or(verse IS NULL) THEN 'not found' ELSE 'ok' END AS status, CASE WHEN NOT bool_or(verse IS NULL) THEN CAST(count(*) AS INTEGER) END AS n_verses, CASE WHEN NOT bool_or(verse IS NULL) THEN CAST(sum(length(text)) AS INTEGER) END AS chars FROM j GROUP BY witness, book_id, chapter, verse_from")
def passage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each verse a range of up to three: its verses, or not found where one is missing."""
    v = verse_texts(spark, sf_dir)
    p = L.passage(_ranges(v), v, ["witness", "book_id", "chapter"])
    return p.select("witness", "book_id", "chapter", F.element_at(F.split("ref", "/"), -1).cast("int").alias("verse_from"), "status", F.when(F.col("verses").isNotNull(), F.size("verses")).alias("n_verses"), F.aggregate("verses", F.lit(0), lambda a, x: a + F.length(x["text"])).alias("chars"))


@C.plan(f"WITH {_VERSES} SELECT DISTINCT book_id, chapter, n AS verse_from, book_id || ' ' || chapter || ':' || n || CASE WHEN length(book_id) % 3 = 0 THEN '' ELSE '-' || (n + length(book_id) % 3) END AS reference FROM v")
def reference_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges as written references, single verses without a hyphen."""
    text = lambda c: F.col(c).cast("string")
    return _ranges(verse_texts(spark, sf_dir)).select("book_id", "chapter", "verse_from", reference(F.col("book_id"), text("chapter"), text("verse_from"), text("verse_to")).alias("reference")).distinct()


_QUERIES = ["luke 2", "john 3", "acts 1", "luke 99", "mark", "peace 7"]


@C.plan(f"""
    WITH {TOK}, q(query) AS (VALUES {", ".join(f"('{x}')" for x in _QUERIES)}), c AS (SELECT witness, book_id, chapter, verse FROM tok GROUP BY ALL),
    m AS (SELECT query, CAST(count(c.verse) AS BIGINT) AS n FROM q LEFT JOIN c ON c.book_id || ' ' || c.chapter = query GROUP BY query)
    SELECT query, CASE WHEN n > 0 AND regexp_matches(query, '[0-9]') THEN 'reference' ELSE 'text' END AS mode, n AS count, false AS has_more, least(n, 40) AS n_shown FROM m""")
def reference_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with a number that name a passage are answered by it: all its verses are counted, forty are shown, and there is never more."""
    q = spark.createDataFrame([(x,) for x in _QUERIES], "query string")
    v = tokens(spark, sf_dir).groupBy("witness", "book_id", "chapter", "verse").agg(F.lit(1).alias("one")).select(F.concat_ws(" ", "book_id", "chapter").alias("query"))
    n = q.join(v.groupBy("query").agg(F.count("*").alias("count")), "query", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return n.select("query", F.when((F.col("count") > 0) & F.col("query").rlike("[0-9]"), "reference").otherwise("text").alias("mode"), "count", F.lit(False).alias("has_more"), F.least("count", F.lit(40)).alias("n_shown"))


@C.plan(f"""{_LEX}, a AS (SELECT DISTINCT unnest([e_strong, d_strong, u_strong]) AS alias, k, d_strong FROM e), q AS (SELECT DISTINCT 'G' || {_NO} || CASE WHEN length(k) % 2 = 0 THEN 'A' ELSE '' END AS number FROM w UNION SELECT 'G0000'),
    r AS (SELECT number, a.k, row_number() OVER (PARTITION BY number ORDER BY CASE WHEN d_strong = number THEN 0 ELSE 1 END, a.k) AS rn FROM q LEFT JOIN a ON alias = number)
    SELECT number, k AS lemma FROM r WHERE rn = 1""")
def entry_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers looked up in the lexicon: the entry whose own number it is before the first that goes by it."""
    e = readers.lexicon_entries(spark, _lexicon_lines(spark, sf_dir))
    asked = e.select(F.when(F.length("lemma") % 2 == 0, F.col("d_strong")).otherwise(F.col("e_strong")).alias("number")).distinct().union(spark.createDataFrame([("G0000",)], "number string"))
    return L.by_number(asked, "number", readers.alias_index(e)).select("number", F.col("entry.lemma").alias("lemma"))


@C.plan("SELECT 'H' || CAST(n_nationkey AS VARCHAR) AS number, n_name AS lemma, CAST(1 AS INTEGER) AS level FROM nation UNION ALL SELECT 'H' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), n_name, CAST(0 AS INTEGER) FROM nation UNION ALL SELECT 'H999', NULL, NULL")
def entry_by_padded_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without their zeros find the entry padded to four digits."""
    n = load(spark, sf_dir, "nation").withColumn("no", F.concat(F.lit("H"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")))
    e = n.select(F.lit("f").alias("file"), F.col("n_nationkey").alias("line_no"), F.col("no").alias("e_strong"), F.lit(None).cast("string").alias("d_strong"), F.lit(None).cast("string").alias("u_strong"), F.col("n_name").alias("lemma"), F.lit("").alias("gloss"))
    asked = n.select(F.concat(F.lit("H"), F.col("n_nationkey").cast("string")).alias("number")).union(n.select("no")).union(spark.createDataFrame([("H999",)], "number string"))
    return L.by_number(asked, "number", readers.alias_index(e)).select("number", F.col("entry.lemma").alias("lemma"), "level")


@C.plan(f"WITH {TOK}, w AS (SELECT DISTINCT transliteration AS k FROM tok WHERE transliteration IS NOT NULL), n AS (SELECT k, regexp_replace(strip_accents(lower(k)), '[^a-z]', '', 'g') AS key FROM w) SELECT k AS lemma, min(k) OVER (PARTITION BY key) AS first_lemma FROM n WHERE key <> ''")
def entry_by_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas looked up under their letters alone: the first entry of the file."""
    e = readers.lexicon_entries(spark, _lexicon_lines(spark, sf_dir)).withColumn("key", fold_udf("lemma"))
    return L.first_under(e.select("lemma", "key").where("key <> ''"), "key", readers.lemma_index(e, F.col("key"))).select("lemma", F.col("entry.lemma").alias("first_lemma"))


_FORMS = [("grc", "N-NSM", "noun", "nominative"), ("grc", "V-AAI", "verb", "aorist"), ("he", "HNcmsa", "noun", "absolute")]


@C.plan(f"""
    WITH {TOK}, f(language, code, summary, features) AS (VALUES {", ".join(str(x) for x in _FORMS)}), t AS (SELECT id, CASE WHEN right(witness, 1) = '0' THEN 'he' ELSE 'grc' END AS language, CASE WHEN transliteration IS NULL THEN NULL WHEN position % 3 = 0 THEN 'N-NSM' WHEN position % 3 = 1 THEN 'V-AAI' ELSE 'HNcmsa' END AS code FROM tok)
    SELECT t.language, coalesce(t.code, '-') AS code, f.summary, f.features, CAST(count(*) AS BIGINT) AS n FROM t LEFT JOIN f ON f.language = t.language AND f.code = t.code GROUP BY ALL""")
def form_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of forms looked up by language; those of another language and missing ones stay without facts."""
    code = F.when(F.col("transliteration").isNull(), F.lit(None)).when(F.col("position") % 3 == 0, "N-NSM").when(F.col("position") % 3 == 1, "V-AAI").otherwise("HNcmsa")
    t = tokens(spark, sf_dir).select(F.when(F.right("witness", F.lit(1)) == "0", "he").otherwise("grc").alias("language"), code.alias("code"))
    d = L.form_facts(t, "code", "language", spark.createDataFrame(_FORMS, "language string, code string, summary string, features string"))
    return d.groupBy("language", F.coalesce("code", F.lit("-")).alias("code"), "summary", "features").agg(F.count("*").alias("n"))


_LENSES = ((("luke", "acts"), "two volumes"), (("john", "1john", "2john", "3john", "revelation"), "johannine"), (("romans", "galatians"), "pauline"))


@C.plan(f"WITH {TOK} SELECT DISTINCT book_id, CASE " + " ".join(f"WHEN book_id IN ({', '.join(repr(b) for b in bs)}) THEN '{n}'" for bs, n in _LENSES) + " ELSE CASE WHEN regexp_matches(book_id, '^[0-9]') THEN 'letters' ELSE 'others' END END AS lens FROM tok")
def book_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lens of each book, by the first rule that names it."""
    return load(spark, sf_dir, "grc_tokens").select("book_id").distinct().select("book_id", L.lens(F.col("book_id"), _LENSES, F.when(F.col("book_id").rlike("^[0-9]"), "letters").otherwise("others")).alias("lens"))


@C.plan(f"""
    WITH {TOK}, s AS (SELECT *, CASE WHEN right(witness, 1) = '0' THEN 'arc' ELSE 'grc' END AS language FROM tok), l AS (SELECT *, 'grc' AS language FROM tok WHERE transliteration IS NOT NULL)
    SELECT s.book_id, CAST(count(*) AS BIGINT) AS n, CAST(count(l.id) AS BIGINT) AS n_joined, CAST(count(*) FILTER (l.id IS NOT NULL AND l.language <> s.language) AS BIGINT) AS n_other_language FROM s LEFT JOIN l ON l.witness = s.witness AND l.book_id = s.book_id AND l.chapter = s.chapter AND l.verse = s.verse AND l.position = s.position AND l.id = s.id GROUP BY s.book_id""")
def token_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface and linguistic tokens joined by place and id, a missing one as none, and languages that differ."""
    t = tokens(spark, sf_dir)
    key = ["witness", "book_id", "chapter", "verse", "position", "id"]
    s = t.select(*key, F.when(F.right("witness", F.lit(1)) == "0", "arc").otherwise("grc").alias("language"))
    ling = t.where("transliteration is not null").select(*key, F.lit("grc").alias("other"))
    return s.join(ling, key, "left").groupBy("book_id").agg(F.count("*").alias("n"), F.count("other").alias("n_joined"), F.count_if(F.col("other") != F.col("language")).alias("n_other_language"))


_BLOCKS = "b AS (SELECT DISTINCT block_id, source_id, section_index, block_index, kind, heading, text FROM text_blocks)"


@C.plan(f"""
    WITH {_BLOCKS}, p AS (SELECT * FROM b WHERE kind = 'paragraph' AND text IS NOT NULL), t AS (SELECT DISTINCT source_id, section_index FROM b WHERE kind = 'heading' AND text IS NOT NULL), s AS (SELECT source_id FROM b WHERE kind = 'paragraph' GROUP BY source_id HAVING count(*) > 5),
    q AS (SELECT 'p' || block_id AS quote_id, source_id, section_index, block_index, coalesce(text, 'nothing') AS quote FROM b UNION ALL SELECT 'h' || block_id, source_id, section_index, block_index, coalesce(heading, 'nothing') FROM b WHERE kind = 'paragraph'),
    r AS (SELECT q.quote_id, CASE WHEN s.source_id IS NULL THEN 'unknown source' WHEN t.source_id IS NULL THEN 'missing section' WHEN p.block_id IS NULL THEN 'invalid paragraph' WHEN NOT coalesce(contains(trim(regexp_replace(p.text, '\\s+', ' ', 'g')), trim(regexp_replace(q.quote, '\\s+', ' ', 'g'))), false) THEN 'not a substring' END AS rule
      FROM q LEFT JOIN s ON s.source_id = q.source_id LEFT JOIN t ON t.source_id = q.source_id AND t.section_index = q.section_index LEFT JOIN p ON p.source_id = q.source_id AND p.section_index = q.section_index AND p.block_index = q.block_index)
    SELECT quote_id, rule FROM r WHERE rule IS NOT NULL""")
def check_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block quoted, and every paragraph by its heading: where the chain of source, section and paragraph breaks, and what is no substring."""
    b = once(load(spark, sf_dir, "text_blocks"), "loaded_at", "block_id", "source_id", "section_index", "block_index", "kind", "heading", "text")
    para = b.where("kind = 'paragraph'")
    place = ["source_id", "section_index", F.col("block_index").alias("paragraph_index")]
    quotes = b.select(F.concat(F.lit("p"), "block_id").alias("quote_id"), *place, F.coalesce("text", F.lit("nothing")).alias("quote")).unionByName(para.select(F.concat(F.lit("h"), "block_id").alias("quote_id"), *place, F.coalesce("heading", F.lit("nothing")).alias("quote")))
    sources = para.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 5")
    toc = b.where("kind = 'heading' and text is not null").select("source_id", "section_index").distinct()
    return L.quotation_violations(quotes, sources, toc, para.where("text is not null").select(*place, "text"))


@C.plan(f"""
    WITH {TOK}, x AS (SELECT DISTINCT book_id AS mapping, chapter, verse FROM tok), one AS (SELECT DISTINCT book_id AS mapping, chapter, verse FROM tok WHERE right(witness, 1) < '3'), a AS (SELECT DISTINCT book_id AS mapping, chapter FROM tok WHERE right(witness, 1) >= '8'), d AS (SELECT DISTINCT mapping, chapter FROM one),
    st AS (SELECT DISTINCT book_id AS mapping, chapter FROM tok WHERE transliteration IS NULL AND right(witness, 1) < '3'), u AS (SELECT DISTINCT book_id AS mapping, chapter, verse FROM tok WHERE right(witness, 1) = '1')
    SELECT mapping, 'declared, not audited' AS rule, CAST(chapter AS VARCHAR) AS what FROM (SELECT * FROM d EXCEPT SELECT * FROM a) UNION ALL SELECT mapping, 'audited, not declared', CAST(chapter AS VARCHAR) FROM (SELECT * FROM a EXCEPT SELECT * FROM d)
    UNION ALL SELECT mapping, 'no segment', CAST(chapter AS VARCHAR) FROM (SELECT * FROM d EXCEPT SELECT * FROM st EXCEPT SELECT DISTINCT mapping, chapter FROM u)
    UNION ALL SELECT x.mapping, 'not consumed', x.chapter || ':' || x.verse FROM x JOIN st ON st.mapping = x.mapping AND st.chapter = x.chapter WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.mapping = x.mapping AND u.chapter = x.chapter AND u.verse = x.verse)""")
def check_mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of witnesses as what a mapping declares, what an audit found and what segments map: chapters of which they differ, and verses that are left over."""
    t = load(spark, sf_dir, "grc_tokens").select(F.col("book_id").alias("mapping"), F.col("chapter").cast("string").alias("chapter"), "verse", F.right("witness", F.lit(1)).alias("w"), F.col("transliteration").isNull().alias("bare"))
    declared = t.where("w < '3'").groupBy("mapping", "chapter").agg(F.when(F.bool_or("bare"), "structural").otherwise("audited").alias("kind"))
    segments = t.where("w = '1'").select("mapping", "chapter", "verse").distinct().groupBy("mapping", "chapter").agg(F.collect_list(F.concat_ws(":", "chapter", "verse")).alias("source"))
    return L.coverage_violations(declared, t.where("w >= '8'").select("mapping", "chapter").distinct(), segments, t.select("mapping", "chapter", "verse").distinct())


@C.plan(f"""
    WITH {TOK}, s AS (SELECT witness, book_id, chapter, verse, list(id ORDER BY position, id) AS a, count(*) FILTER (transliteration IS NULL) > 1 AS gap FROM tok GROUP BY ALL), l AS (SELECT witness, book_id, chapter, verse, list(id ORDER BY position, id) AS b FROM tok WHERE transliteration IS NOT NULL GROUP BY ALL),
    j AS (SELECT s.*, b FROM s LEFT JOIN l USING (witness, book_id, chapter, verse))
    SELECT witness, book_id, chapter, verse, CASE WHEN gap AND b IS NOT NULL THEN 'gap carries tokens' WHEN gap THEN NULL WHEN b IS NULL THEN 'not aligned' WHEN len(a) <> len(b) THEN 'token counts differ' WHEN a <> b THEN 'token ids differ' END AS rule FROM j WHERE rule IS NOT NULL""")
def check_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses whose surface and linguistic layers do not agree token by token; those that lack several readings count as gaps, which must carry none."""
    t = tokens(spark, sf_dir)
    v = ["witness", "book_id", "chapter", "verse"]
    gaps = t.groupBy(*v).agg(F.count_if(F.col("transliteration").isNull()).alias("n")).where("n > 1")
    return L.layer_violations(t, t.where("transliteration is not null"), gaps, v)


@C.plan("""
    WITH s AS (SELECT DISTINCT n_nationkey AS k, n_regionkey AS r, n_name AS t FROM nation WHERE n_nationkey > 0 AND n_nationkey NOT IN (7, 8)), c AS (SELECT r_regionkey AS chapter, r_regionkey * 5 + 1 AS lo, r_regionkey * 5 + 5 AS hi FROM region)
    SELECT 'missing section' AS rule, CAST(k AS VARCHAR) AS what FROM (VALUES (7), (8)) AS m(k) UNION ALL SELECT 'wrong chapter', CAST(k AS VARCHAR) FROM s LEFT JOIN c ON k BETWEEN lo AND hi WHERE c.chapter IS DISTINCT FROM s.r
    UNION ALL SELECT 'anchor differs', CAST(k AS VARCHAR) FROM s WHERE k % 2 = 0 AND k % 3 = 0""")
def check_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sections of regions: numbers that are missing, sections in another chapter than its span says, anchors that do not begin with their number."""
    n = load(spark, sf_dir, "nation").where("n_nationkey > 0")
    k = F.col("n_nationkey").cast("int")
    sections = n.where(~k.isin(7, 8)).select(k.alias("section"), F.col("n_regionkey").cast("int").alias("chapter"), F.when(k % 2 == 0, k).alias("row_index"))
    chapters = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("chapter"), (F.col("r_regionkey") * 5 + 1).cast("int").alias("start_section"), (F.col("r_regionkey") * 5 + 5).cast("int").alias("end_section"))
    rows = n.select(k.alias("row_index"), F.concat(F.when(k % 3 == 0, k + 1).otherwise(k).cast("string"), F.lit(". "), "n_name").alias("text"))
    return L.concordance_violations(sections, chapters, rows)


@C.plan(f"WITH {PUB} SELECT 'type' AS asked, id FROM pub WHERE content_type IN ('prayer', 'reflection') UNION ALL SELECT 'type and flag', id FROM pub WHERE content_type IN ('prayer', 'reflection') AND NOT featured UNION ALL SELECT 'nothing', id FROM pub UNION ALL SELECT 'any and text', id FROM pub WHERE (pinned OR status = 'draft' OR regexp_matches(lower(coalesce(title_en, '')), 'hope|mercy')) AND contains(lower(concat_ws(' ', title_en, slug)), 'on')")
def stacked_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same listing under filters that are there only if asked for, an OR of categories among them."""
    p = publications(spark, sf_dir)
    hay = ("title_en", "slug")
    asked = {
        "type": L.filtered(p, {"content_type": ["prayer", "reflection"], "featured": None}),
        "type and flag": L.filtered(p, {"content_type": ["prayer", "reflection"], "featured": [False]}),
        "nothing": L.filtered(p, {"content_type": None}, None, hay),
        "any and text": L.filtered(p, None, "ON", hay, (F.col("pinned"), F.col("status") == "draft", F.lower(F.coalesce("title_en", F.lit(""))).rlike("hope|mercy"))),
    }
    out = None
    for name, d in asked.items():
        d = d.select(F.lit(name).alias("asked"), "id")
        out = d if out is None else out.unionByName(d)
    return out


C.statement("kind_filter", "SELECT id, kind FROM {cms_publications} WHERE kind = 'page' GROUP BY id, kind")
C.statement("allowed_range", "SELECT DISTINCT book_id, chapter, CASE WHEN chapter BETWEEN 2 AND 6 THEN 'within' ELSE 'outside' END AS scope FROM {grc_tokens} WHERE book_id IN ('luke', 'john') AND (chapter BETWEEN 2 AND 6 OR chapter > 6)")


@C.plan(f"WITH {PUB}, x AS (SELECT id, list_filter(['en', 'kha'], lambda k: (k = 'en' AND coalesce(trim(body_en), '') <> '') OR (k = 'kha' AND coalesce(trim(body_kha), '') <> '')) AS codes FROM pub) SELECT id, array_to_string(codes, ',') AS codes FROM x")
def filled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the languages in which a publication has a body."""
    m = F.map_filter(F.create_map(F.lit("en"), F.col("body_en"), F.lit("kha"), F.col("body_kha")), lambda _, v: F.coalesce(F.trim(v), F.lit("")) != "")
    return publications(spark, sf_dir).select("id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("codes"))


_PRIVATE = ("full_name", "email", "verification_contact", "bishop_or_superior")


@C.plan("SELECT DISTINCT id, CAST(9 AS INTEGER) AS n_fields, status FROM priest_registrations")
def public_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations without their private fields."""
    p = once(load(spark, sf_dir, "priest_registrations"), "ingested_at").drop(*_PRIVATE)
    return p.select("id", F.lit(len(p.columns)).alias("n_fields"), "status")


@C.plan("SELECT o_orderkey, strftime(o_orderdate, '%B') || ' ' || CAST(day(o_orderdate) AS VARCHAR) AS feast FROM orders WHERE month(o_orderdate) = 2 AND day(o_orderdate) = 2")
def feasts_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feasts written as a month's name and a day, those of one day picked out."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Feast: "), F.date_format("o_orderdate", "MMMM d")).alias("feast"))
    p = r"^Feast:\s+([A-Za-z]+)\s+(\d{1,2})$"
    months = "January February March April May June July August September October November December".split()
    month = F.array_position(F.array(*map(F.lit, months)), F.regexp_extract("feast", p, 1))
    return o.where((month == 2) & (F.regexp_extract("feast", p, 2).cast("int") == 2)).select("o_orderkey", F.regexp_extract("feast", r"^Feast:\s+(.*)$", 1).alias("feast"))


@C.plan(f"WITH {TOK}, g AS (SELECT surface, count(DISTINCT book_id) AS n, min(book_id) AS book FROM tok GROUP BY surface) SELECT surface, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN book END AS book FROM g UNION ALL SELECT surface, CASE WHEN bool_or(book_id = 'luke') THEN 'found' ELSE 'missing' END || ' in luke', CASE WHEN bool_or(book_id = 'luke') THEN 'luke' END FROM tok GROUP BY surface")
def component_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words looked up with and without a component: without one, several matches are ambiguous."""
    w = load(spark, sf_dir, "grc_tokens").groupBy("surface").agg(F.count_distinct("book_id").alias("n"), F.min("book_id").alias("book"), F.bool_or(F.col("book_id") == "luke").alias("luke"))
    free = w.select("surface", F.when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"), F.when(F.col("n") == 1, F.col("book")).alias("book"))
    return free.unionByName(w.select("surface", F.when(F.col("luke"), "found in luke").otherwise("missing in luke").alias("status"), F.when(F.col("luke"), "luke").alias("book")))


_PARTS = [("luke", 1, 1, 20, "proem"), ("luke", 2, 1, 99, "birth"), ("acts", 1, 1, 11, "ascension"), ("john", 1, 1, 18, "prologue")]


@C.plan(f"""
    WITH {TOK}, p(book, ch, lo, hi, component) AS (VALUES {", ".join(str(x) for x in _PARTS)}), v AS (SELECT witness, book_id, chapter, CAST(verse AS INTEGER) AS n, CAST(count(*) AS BIGINT) AS toks FROM tok GROUP BY ALL)
    SELECT v.witness, component, CAST(count(*) AS BIGINT) AS n_verses, CAST(sum(toks) AS BIGINT) AS n_tokens FROM v JOIN p ON book = book_id AND ch = chapter AND n BETWEEN lo AND hi GROUP BY ALL""")
def component_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses routed to components by book, chapter and span, then joined to their witnesses."""
    p = spark.createDataFrame(_PARTS, "book_id string, chapter int, lo int, hi int, component string")
    v = tokens(spark, sf_dir).groupBy("witness", "book_id", "chapter", F.col("verse").cast("int").alias("n")).agg(F.count("*").alias("toks"))
    return v.join(F.broadcast(p), ["book_id", "chapter"]).where("n between lo and hi").groupBy("witness", "component").agg(F.count("*").alias("n_verses"), F.sum("toks").alias("n_tokens"))  # a rule table of four rows


@C.plan("WITH a AS (SELECT source_id, heading AS theme, min(block_id) AS id, 0 AS origin FROM text_blocks WHERE heading IS NOT NULL AND kind = 'heading' GROUP BY ALL UNION ALL SELECT source_id, heading, min(block_id), 1 FROM text_blocks WHERE heading IS NOT NULL AND kind = 'paragraph' GROUP BY ALL) SELECT source_id, theme, min_by(id, origin * 1000000000 + id) AS id FROM a GROUP BY source_id, theme")
def merged_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of two lists in one, the first list's id kept."""
    b = load(spark, sf_dir, "text_blocks").where("heading is not null").select("source_id", F.col("heading").alias("theme"), F.when(F.col("kind") == "heading", 0).otherwise(1).alias("origin"), F.col("block_id").alias("id"))
    return b.groupBy("source_id", "theme").agg(F.min(F.struct("origin", "id")).alias("x")).select("source_id", "theme", "x.id")


@C.plan(f"WITH {TOK} SELECT book_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(list(DISTINCT chapter) FILTER (chapter % 3 = 1), []), coalesce(list(DISTINCT chapter) FILTER (chapter % 2 = 0), [])))), ',') AS covered, coalesce(bool_or(chapter = 4), false) AS has_four FROM tok GROUP BY book_id")
def covered_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited chapters and overrides as one set."""
    some = lambda c: F.coalesce(F.collect_set(F.when(c, F.col("chapter"))), F.array().cast("array<int>"))
    g = load(spark, sf_dir, "grc_tokens").groupBy("book_id").agg(some(F.col("chapter") % 3 == 1).alias("a"), some(F.col("chapter") % 2 == 0).alias("o"))
    u = F.array_sort(F.array_union("a", "o"))
    return g.select("book_id", F.array_join(F.transform(u, lambda x: x.cast("string")), ",").alias("covered"), F.array_contains(u, 4).alias("has_four"))


_TAGS = "'H' || lpad(CAST(o_orderkey % 9000 AS VARCHAR), 4, '0')"


@C.plan(f"SELECT o_orderkey, {_TAGS} AS first_number, CAST(2 AS INTEGER) AS n_numbers, 'a <' || o_orderstatus || '> of & it' AS clean FROM orders")
def number_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and all lexicon numbers of a field, and its markup cleaned."""
    no = F.concat(F.lit("H"), F.lpad((F.col("o_orderkey") % 9000).cast("string"), 4, "0"))
    f = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("{"), no, F.lit("}/H9001/"), no).alias("tags"), F.concat(F.lit("<i>a</i> &lt;"), "o_orderstatus", F.lit("&gt;__of &amp;¶it")).alias("raw"))
    clean = F.replace(F.replace(markup_free(F.replace(F.replace(F.col("raw"), F.lit("&lt;"), F.lit("\x02")), F.lit("&gt;"), F.lit("\x03"))), F.lit("\x02"), F.lit("<")), F.lit("\x03"), F.lit(">"))
    return f.select("o_orderkey", first_strong(F.col("tags")).alias("first_number"), F.size(all_strongs(F.col("tags"))).alias("n_numbers"), clean.alias("clean"))


@C.plan("SELECT DISTINCT id, CASE WHEN trim(subject) = '' THEN NULL ELSE left(trim(subject), 40) END AS subject, coalesce(nullif(trim(subject), ''), 'no subject') AS shown FROM contact_messages")
def capped_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects without outer spaces, at most forty characters, null where nothing is left."""
    return load(spark, sf_dir, "contact_messages").select("id", capped(F.col("subject"), 40).alias("subject"), or_default(F.trim("subject"), F.lit("no subject")).alias("shown")).distinct()


@C.plan("SELECT id, coalesce(nullif(left(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '-'), 160), ''), 'content') AS name FROM (SELECT DISTINCT id, coalesce(title_kha, title_en, slug) AS title FROM cms_publications)")
def ascii_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in plain letters: accents taken off before other signs become hyphens."""
    p = publications(spark, sf_dir).select("id", F.coalesce("title_kha", "title_en", "slug").alias("title")).distinct()
    s = F.regexp_replace(F.regexp_replace(F.lower(ascii_udf("title")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return p.select("id", or_default(F.left(s, F.lit(160)), F.lit("content")).alias("name"))


@C.plan("SELECT book_id, CASE WHEN starts_with(book_id, '1') OR starts_with(book_id, '2') OR starts_with(book_id, '3') THEN 'numbered' ELSE 'error' END AS language FROM (SELECT DISTINCT book_id FROM grc_tokens)")
def prefix_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prefix says, and an error where it says nothing, raised only where a caller asks."""
    b = load(spark, sf_dir, "grc_tokens").select("book_id").distinct()
    return b.select("book_id", F.when(F.col("book_id").rlike("^[123]"), "numbered").otherwise("error").alias("language"))


@C.plan("""
    SELECT exchange_id, CASE WHEN regexp_matches(m, '\\b(harm|kill|vanish)') THEN 'urgent' WHEN regexp_matches(m, '\\b(hits|afraid|alone)\\b') THEN 'human' ELSE 'none' END AS route
    FROM (SELECT DISTINCT exchange_id, lower(regexp_replace(nfc_normalize(coalesce(message, '')), '\\p{Cf}', '', 'g')) AS m FROM chat_exchanges)""")
def safety_route_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms made plain, invisible characters out, then two pattern routes."""
    m = F.lower(F.regexp_replace(nfkc_udf(F.coalesce("message", F.lit(""))), r"\p{Cf}", ""))
    return load(spark, sf_dir, "chat_exchanges").select("exchange_id", F.when(m.rlike(r"\b(harm|kill|vanish)"), "urgent").when(m.rlike(r"\b(hits|afraid|alone)\b"), "human").otherwise("none").alias("route")).distinct()


@C.plan(f"WITH {TOK} SELECT book_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT regexp_replace(surface, '[\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}ʼ]', '', 'g')) > 0 AS BOOLEAN) AS any_key FROM tok GROUP BY book_id")
def build_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build keys of surfaces: letters alone, and whether they agree with the lookup key on every word."""
    s = load(spark, sf_dir, "grc_tokens").select("surface").distinct().withColumn("k", build_key_udf("surface")).withColumn("a", align_key_udf("surface"))
    t = lookup(tokens(spark, sf_dir).select("book_id", "surface"), s, ["surface"])
    return t.groupBy("book_id").agg(F.count("*").alias("n"), F.bool_or(F.col("k").isNotNull() & F.col("a").isNotNull()).alias("any_key"))


@C.plan(f"WITH {PUB} SELECT id AS copy_of, CASE WHEN title_en <> '' THEN title_en || ' (Copy)' END AS title_en, 'draft' AS status, false AS pinned, slug || '-copy' AS slug FROM pub WHERE status = 'published' AND featured")
def drafts_of_featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Featured publications duplicated as drafts."""
    d = duplicate_as_draft(publications(spark, sf_dir).select("id", "slug", "title_en", "title_kha", "status", "featured", "pinned"), "id", (F.col("status") == "published") & F.col("featured"), titles=("title_en", "title_kha"), off=("featured", "pinned"))
    return d.select("copy_of", "title_en", "status", "pinned", "slug")


@C.plan(f"WITH {PUB} SELECT CASE WHEN status = 'draft' AND NOT featured THEN 'archived' ELSE status END AS status, CAST(count(*) AS BIGINT) AS n FROM pub GROUP BY 1")
def soft_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that are not featured archived, not removed."""
    return soft_delete(publications(spark, sf_dir), (F.col("status") == "draft") & ~F.col("featured")).groupBy("status").agg(F.count("*").alias("n"))


@C.plan("""
    WITH u AS (SELECT o_orderpriority AS unit, o_orderstatus AS part, count(*) AS n, sum(length(o_clerk)) AS w FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS o_clerk FROM orders) GROUP BY ALL), g AS (SELECT unit, count(*) AS parts, sum(n) AS credits, sum(w) AS words FROM u GROUP BY unit)
    SELECT unit, CASE WHEN parts < 3 THEN 'too few parts' WHEN credits <> 2 * parts THEN 'credits' WHEN words < 90 THEN 'too short' END AS rule FROM g WHERE parts < 3 OR credits <> 2 * parts OR words < 90""")
def check_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with too few parts, credits that are not twice the parts, or too few words; the first rule that breaks."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("unit"), "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.length(F.col("o_custkey").cast("string"))).alias("w"))
    g = o.groupBy("unit").agg(F.count("*").alias("parts"), F.sum("n").alias("credits"), F.sum("w").alias("words"))
    return g.select("unit", F.when(F.col("parts") < 3, "too few parts").when(F.col("credits") != 2 * F.col("parts"), "credits").when(F.col("words") < 90, "too short").alias("rule")).where("rule is not null")


@C.plan("SELECT DISTINCT id, CASE WHEN length(message) > 240 THEN 'too long' WHEN subject IS NULL OR subject NOT IN ('Mass times', 'Prayer request', 'Question') THEN 'unknown subject' WHEN contains(lower(message), 'www.') THEN 'dropped' ELSE 'accepted' END AS verdict FROM contact_messages WHERE message IS NOT NULL")
def payload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads over their limit, with a value outside its list, or with the field filled that only machines fill."""
    m = load(spark, sf_dir, "contact_messages").where("message is not null")
    v = F.when(F.length("message") > 240, "too long").when(F.col("subject").isNull() | ~F.col("subject").isin("Mass times", "Prayer request", "Question"), "unknown subject").when(F.contains(F.lower("message"), F.lit("www.")), "dropped").otherwise("accepted")
    return m.select("id", v.alias("verdict")).distinct()


@C.plan("WITH t AS (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'mix_targets', count(*) FROM mix_targets), p(name, pinned) AS (VALUES ('region', 5), ('nation', 24), ('size_limits', 3)) SELECT coalesce(t.name, p.name) AS name, CASE WHEN p.name IS NULL THEN 'not pinned' WHEN t.name IS NULL THEN 'missing' WHEN n = pinned THEN 'ok' ELSE 'differs' END AS status FROM t FULL JOIN p ON p.name = t.name")
def pinned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables against the row counts that a manifest pins."""
    t = None
    for name in ("region", "nation", "mix_targets"):
        d = load(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        t = d if t is None else t.unionByName(d)
    p = spark.createDataFrame([("region", 5), ("nation", 24), ("size_limits", 3)], "name string, pinned long")
    j = t.join(p, "name", "full")
    return j.select("name", F.when(F.col("pinned").isNull(), "not pinned").when(F.col("n").isNull(), "missing").when(F.col("n") == F.col("pinned"), "ok").otherwise("differs").alias("status"))


@C.plan("SELECT path, CASE WHEN starts_with(path, '/en/a') OR starts_with(path, '/en/m') THEN 'kept' ELSE 'left out' END AS manifest FROM (SELECT DISTINCT '/en/' || slug || '.html' AS path FROM cms_publications) WHERE NOT contains(path, 'hope')")
def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages without templates, and those a manifest of prefixes keeps."""
    p = load(spark, sf_dir, "cms_publications").select(F.concat(F.lit("/en/"), "slug", F.lit(".html")).alias("path")).distinct().where(~F.contains("path", F.lit("hope")))
    return p.select("path", F.when(F.col("path").startswith("/en/a") | F.col("path").startswith("/en/m"), "kept").otherwise("left out").alias("manifest"))


QUERIES, SQL = C.queries, C.sql
