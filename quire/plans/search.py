"""Text search, retrieval and rule-based routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import collapse, terms
from quire.plans.kit import Catalogue
from quire.tables import load, once

C = Catalogue()


def all_terms(column: str, words: list[str]) -> Column:
    """Conjunctive, case-folded substring search: every word occurs in ``column``."""
    low = F.lower(F.col(column))
    return reduce(lambda a, b: a & b, [low.contains(t.lower()) for t in words])


@C.plan("""
    SELECT doc_id, source, text FROM documents
    WHERE contains(lower(text), 'than') AND contains(lower(text), 'the') ORDER BY doc_id LIMIT 40""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 40 documents in canon order that hold all terms."""
    return load(spark, sf_dir, "documents").select("doc_id", "source", "text").where(all_terms("text", ["than", "the"])).orderBy("doc_id").limit(40)


@C.plan("""
    WITH q(terms) AS (VALUES ('lamp'), ('ka jingieit'), ('zzz nothing'), ('the patience')),
    hit AS (SELECT q.terms, d.doc_id, row_number() OVER (PARTITION BY q.terms ORDER BY d.doc_id) AS rn
            FROM q JOIN documents d ON contains(lower(d.text), split_part(q.terms, ' ', 1)) AND (split_part(q.terms, ' ', 2) = '' OR contains(lower(d.text), split_part(q.terms, ' ', 2))))
    SELECT q.terms, CAST(count(h.doc_id) FILTER (WHERE rn <= 20) AS BIGINT) AS n_shown, CAST(count(h.doc_id) > 20 AS BOOLEAN) AS has_more
    FROM q LEFT JOIN (SELECT * FROM hit WHERE rn <= 21) h ON h.terms = q.terms GROUP BY q.terms""")
def search_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown count capped at 20 and whether there is more; one scan counts all the queries' matches."""
    asked = ["lamp", "ka jingieit", "zzz nothing", "the patience"]
    low = load(spark, sf_dir, "documents").select(F.lower("text").alias("text"))
    counts = low.agg(*[F.count_if(all_terms("text", q.split(" "))).alias(f"q{k}") for k, q in enumerate(asked)])
    n = counts.select(F.explode(F.array(*[F.struct(F.lit(q).alias("terms"), F.col(f"q{k}").alias("n")) for k, q in enumerate(asked)])).alias("x")).select("x.*")
    return n.select("terms", F.least("n", F.lit(20)).alias("n_shown"), (F.col("n") > 20).alias("has_more"))


@C.plan("""
    SELECT p_partkey, p_name, p_size FROM part
    WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND p_size BETWEEN 10 AND 20""")
def faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haystack of several fields, and a facet that reaches the scan."""
    p = load(spark, sf_dir, "part")
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return p.where(F.col("p_size").between(10, 20) & hay.contains("ring")).select("p_partkey", "p_name", "p_size")


C.statement("facet_values", "SELECT DISTINCT content_type, source FROM {documents} WHERE source IS NOT NULL")


@C.plan("""
    WITH q(needle) AS (VALUES ('land'), ('tland'), ('no such place')),
    m AS (SELECT q.needle, p.entry_id, p.entry_name, contains(lower(p.entry_name), q.needle) OR list_has_any(list_transform(p.other_names, lambda x: lower(x)), [q.needle]) AS hit FROM q, place_list p WHERE p.list_name = 'country'),
    f AS (SELECT *, bool_or(hit) OVER (PARTITION BY needle) AS any_hit FROM m)
    SELECT needle, entry_id, entry_name FROM f WHERE hit OR NOT any_hit""")
def places_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that match a needle, or all places where none does (P07). Needles are three, places a fixed list."""
    q = spark.createDataFrame([("land",), ("tland",), ("no such place",)], "needle string")
    p = load(spark, sf_dir, "place_list").where("list_name = 'country'")
    m = p.crossJoin(F.broadcast(q)).withColumn("hit", F.lower("entry_name").contains(F.col("needle")) | F.exists("other_names", lambda x: F.lower(x) == F.col("needle")))
    return m.withColumn("any_hit", F.max("hit").over(Window.partitionBy("needle"))).where(F.col("hit") | ~F.col("any_hit")).select("needle", "entry_id", "entry_name")


_ITEMS = [
    (1, "patience in trials", "patience,endurance"), (2, "the bread of the harvest", "harvest,bread"), (3, "fasting and prayer in lent", "fasting,lent"),
    (4, "mercy for the prisoner", "mercy,prisoner"), (5, "how to speak about hope", "hope"), (6, "the lamp before the altar", "lamp,altar"), (7, "confession and sin", "confession,sin,repentance"),
]
_ITEMS_SQL = ", ".join(f"({i}, '{t}', '{g}')" for i, t, g in _ITEMS)


def overlap_score(words: Column, low: Column, item_words: Column, tags: Column, bonus: int) -> Column:
    """Common words of query and item, plus ``bonus`` for each tag that the query (in lower case) holds. The words of both are found before they meet."""
    return F.size(F.array_intersect(words, item_words)) + F.aggregate(tags, F.lit(0), lambda a, t: a + F.when(low.contains(t), bonus).otherwise(0))


def _retrieve(spark: SparkSession, sf_dir: str, bonus: int, k: int) -> DataFrame:
    q = once(load(spark, sf_dir, "chat_exchanges"), "ingested_at", "exchange_id", "message").where("message is not null").select("exchange_id", terms(F.col("message")).alias("words"), F.lower("message").alias("low"))
    items = spark.createDataFrame(_ITEMS, "item_id int, title string, tags string").select("item_id", terms(F.col("title")).alias("item_words"), F.split("tags", ",").alias("tags"))
    # the items are a small fixed dimension, nested into one row: each query keeps its k best, without a join or a group
    held = items.agg(F.collect_list(F.struct("item_id", "item_words", "tags")).alias("items"))
    scored = F.transform("items", lambda i: F.struct((-overlap_score(F.col("words"), F.col("low"), i["item_words"], i["tags"], bonus).cast("long")).alias("neg"), i["item_id"].alias("item_id")))
    best = q.crossJoin(F.broadcast(held)).select("exchange_id", F.slice(F.array_sort(F.filter(scored, lambda s: s["neg"] < 0)), 1, k).alias("b"))
    return best.select("exchange_id", F.posexplode("b").alias("pos", "x")).select("exchange_id", (F.col("pos") + 1).alias("rank"), "x.item_id", (-F.col("x.neg")).alias("score"))


def _retrieve_sql(bonus: int, k: int) -> str:
    words = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) >= 3))"
    return f"""
    WITH items(item_id, title, tags) AS (VALUES {_ITEMS_SQL}), q AS (SELECT DISTINCT exchange_id, message FROM chat_exchanges WHERE message IS NOT NULL),
    s AS (SELECT exchange_id, item_id, CAST(len(list_intersect({words.format('message')}, {words.format('title')})) + {bonus} * len(list_filter(string_split(tags, ','), lambda t: contains(lower(message), t))) AS BIGINT) AS score FROM q, items),
    r AS (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY score DESC, item_id) AS rank FROM s WHERE score > 0)
    SELECT exchange_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM r WHERE rank <= {k}"""


@C.plan(_retrieve_sql(4, 5))
def keyword_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap plus 4 for each tag, five best a query."""
    return _retrieve(spark, sf_dir, 4, 5)


@C.plan(_retrieve_sql(5, 4))
def bonus_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a bonus of 5 and four best."""
    return _retrieve(spark, sf_dir, 5, 4)


@C.plan("""
    SELECT content_type, string_agg('[' || doc_id || '] ' || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 40), chr(10) ORDER BY doc_id) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY content_type""")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled excerpts of the first three documents of each type, joined in order."""
    w = Window.partitionBy("content_type").orderBy("doc_id")
    d = load(spark, sf_dir, "documents").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    part = F.concat(F.lit("["), F.col("doc_id"), F.lit("] "), F.left(collapse(F.col("text")), F.lit(40)))
    return d.groupBy("content_type").agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p")))).alias("x")).select("content_type", F.array_join("x.p", "\n").alias("context"))


_ROUTES = (("injection", ("ignore previous", "system prompt")), ("safety", ("harming myself", "hits me", "afraid")), ("off_topic", ("football", "lawyers", "tyre", "rental", "rain tomorrow")), ("on_topic", ("church", "pray", "sin", "confession", "jing", "iglesia", "glise", "mass", "communion")))


@C.plan("""
    SELECT exchange_id, CASE """ + " ".join(f"WHEN {' OR '.join(f'contains(m, {chr(39)}{t}{chr(39)})' for t in ts)} THEN '{n}'" for n, ts in _ROUTES) + """ ELSE 'out' END AS route
    FROM (SELECT DISTINCT exchange_id, lower(message) AS m FROM chat_exchanges WHERE message IS NOT NULL)""")
def scope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules, the first that holds decides."""
    m = F.lower("message")
    case = F.when(F.lit(False), "")
    for name, words in _ROUTES:
        case = case.when(reduce(lambda a, b: a | b, [m.contains(t) for t in words]), name)
    return load(spark, sf_dir, "chat_exchanges").where("message is not null").select("exchange_id", case.otherwise("out").alias("route")).distinct()


@C.plan("""
    SELECT exchange_id, CASE WHEN regexp_matches(m, '\\b(harm|kill|vanish)') THEN 'urgent' WHEN regexp_matches(m, '\\b(hits|afraid|alone)\\b') THEN 'human' ELSE 'none' END AS route
    FROM (SELECT DISTINCT exchange_id, lower(regexp_replace(coalesce(message, ''), '\\p{Cf}', '', 'g')) AS m FROM chat_exchanges)""")
def safety_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible characters out, then two pattern routes."""
    m = F.lower(F.regexp_replace(F.coalesce("message", F.lit("")), r"\p{Cf}", ""))
    return load(spark, sf_dir, "chat_exchanges").select("exchange_id", F.when(m.rlike(r"\b(harm|kill|vanish)"), "urgent").when(m.rlike(r"\b(hits|afraid|alone)\b"), "human").otherwise("none").alias("route")).distinct()


@C.plan("""
    WITH o AS (SELECT doc_id, source, coalesce(lang, '') AS lang, content_type, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, lang, content_type ORDER BY ordinal) AS dup FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ordinal) AS shown FROM k WHERE dup = 1)
    SELECT source, 'c' || ordinal AS citation_id, lang, content_type FROM r WHERE shown <= 10""")
def citation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each (language, type) within a source, named by its original place, ten at most."""
    o = load(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"), "content_type").withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    first = o.groupBy("source", "lang", "content_type").agg(F.min("ordinal").alias("ordinal"))
    top = first.withColumn("shown", F.row_number().over(Window.partitionBy("source").orderBy("ordinal"))).where("shown <= 10")
    return top.select("source", F.concat(F.lit("c"), F.col("ordinal")).alias("citation_id"), "lang", "content_type")


@C.plan("""
    WITH x AS (SELECT DISTINCT exchange_id, regexp_extract_all(message, '[0-9]+') AS need, regexp_extract_all(coalesce(reply, ''), '[0-9]+') AS have FROM chat_exchanges WHERE message IS NOT NULL)
    SELECT exchange_id, CAST(len(list_distinct(need)) AS INTEGER) AS n_needed, list_has_all(have, need) AS all_kept FROM x""")
def refs_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the message returns in the reply."""
    x = load(spark, sf_dir, "chat_exchanges").where("message is not null").select("exchange_id", F.array_distinct(F.regexp_extract_all("message", F.lit("([0-9]+)"))).alias("need"), F.regexp_extract_all(F.coalesce("reply", F.lit("")), F.lit("([0-9]+)")).alias("have")).distinct()
    return x.select("exchange_id", F.size("need").alias("n_needed"), (F.size(F.array_except("need", "have")) == 0).alias("all_kept"))


_RULES = [(1, "confession", "a"), (2, "pray", "b"), (3, "hope", "c"), (4, "the", "d")]


@C.plan(f"""
    WITH r(rule_id, needle, answer) AS (VALUES {", ".join(str(x) for x in _RULES)}), m AS (SELECT DISTINCT exchange_id, lower(message) AS m FROM chat_exchanges WHERE message IS NOT NULL)
    SELECT exchange_id, min(rule_id) AS rule_id, min_by(answer, rule_id) AS answer FROM m JOIN r ON contains(m, needle) GROUP BY exchange_id""")
def first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer of the first rule whose key the message holds."""
    r = spark.createDataFrame(_RULES, "rule_id int, needle string, answer string")
    m = load(spark, sf_dir, "chat_exchanges").where("message is not null").select("exchange_id", F.lower("message").alias("m"))
    hit = m.join(F.broadcast(r), F.col("m").contains(F.col("needle")))
    return hit.groupBy("exchange_id").agg(F.min(F.struct("rule_id", "answer")).alias("x")).select("exchange_id", "x.rule_id", "x.answer")


@C.plan("""
    WITH q AS (SELECT block_id AS quote_id, source_id, trim(regexp_replace(heading, '\\s+', ' ', 'g')) AS quote FROM (SELECT DISTINCT block_id, source_id, heading FROM text_blocks WHERE kind = 'paragraph' AND heading IS NOT NULL)),
    t AS (SELECT DISTINCT block_id, source_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM text_blocks WHERE kind = 'heading' AND text IS NOT NULL)
    SELECT quote_id, CAST(count(DISTINCT block_id) AS BIGINT) AS n_found FROM q LEFT JOIN t ON q.source_id = t.source_id AND contains(body, quote) GROUP BY quote_id""")
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many headings of a paragraph's source hold its section heading once white space is collapsed."""
    b = load(spark, sf_dir, "text_blocks")
    q = b.where("kind = 'paragraph' and heading is not null").select(F.col("block_id").alias("quote_id"), "source_id", collapse(F.col("heading")).alias("quote")).distinct()
    t = b.where("kind = 'heading' and text is not null").select("block_id", "source_id", collapse(F.col("text")).alias("body")).distinct()
    hit = q.join(t, (q.source_id == t.source_id) & F.col("body").contains(F.col("quote")), "left")
    return hit.groupBy("quote_id").agg(F.countDistinct("block_id").alias("n_found"))


QUERIES, SQL = C.queries, C.sql
