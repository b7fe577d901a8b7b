"""Queries pN_ of the text problems, with the DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import canonical, langid, lookalike, mixing, packing, pairs, pii, quality, scans
from quire.llm.lang_seeds import BOTH, NAMES
from quire.llm.splitting import split_long
from quire.session import materialise
from quire.tables import load, lookup, once, spread

Query = Callable[[SparkSession, str], DataFrame]


def _paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "text_blocks").where("kind = 'paragraph'").select("block_id", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of scan noise in each paragraph block."""
    blocks = _paragraph_blocks(spark, sf_dir).where(F.col("text").isNotNull())
    shared = spark.sparkContext.broadcast(scans.lexicon(blocks))
    return blocks.mapInPandas(lambda it: scans.find(it, shared), "block_id long, noise_type string").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph block once, as the continuous text that the page printed."""
    blocks = _paragraph_blocks(spark, sf_dir)
    shared = spark.sparkContext.broadcast(scans.lexicon(blocks.where(F.col("text").isNotNull())))
    return blocks.mapInPandas(lambda it: scans.repair(it, shared), "block_id long, repaired string, noise string").dropDuplicates(["block_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens whose surface is not in the one form."""
    t = load(spark, sf_dir, "grc_tokens").select("id", "surface")
    return lookalike.not_canonical(t).select("id").distinct()


def p2_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token once, with its surface in the one form."""
    t = once(load(spark, sf_dir, "grc_tokens"), "loaded_at", "id", "witness", "book_id", "chapter", "verse", "position", "surface")
    return lookalike.canonical_column(t)


#: Key of the tables whose fields are split.
SPLIT_KEYS = {"cms_publications": "id", "text_blocks": "block_id"}


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    # size_limits is a fixed table of three rows
    limits = [r for r in load(spark, sf_dir, "size_limits").collect() if r["task"] == "split"]
    parts = []
    for r in sorted(limits, key=lambda r: (r["record_table"], r["field_name"])):
        t = load(spark, sf_dir, r["record_table"]).select(F.lit(r["record_table"]).alias("record_table"), F.lit(r["field_name"]).alias("field_name"), F.col(SPLIT_KEYS[r["record_table"]]).alias("record_id"), F.col(r["field_name"]))
        parts.append(split_long(spread(t), r["field_name"], r["max_size"], r["overlap_size"], ["record_table", "field_name", "record_id"]))
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that the operator had to cut."""
    return _pieces(spark, sf_dir).where(F.col("n_pieces") > 1).select("record_table", "record_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces in order, each record once however often it was delivered."""
    return _pieces(spark, sf_dir).dropDuplicates(["record_table", "field_name", "record_id", "piece_no"])


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record with pieces: whether they put together give the text back, and the longest piece and least and greatest overlap."""
    p = p4_pieces(spark, sf_dir).select("record_table", "record_id", "field_name", "piece_no", "start", "end", "piece")
    g = p.groupBy("record_table", "field_name", "record_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("ps"))
    limits = load(spark, sf_dir, "size_limits").where("task = 'split'").select("record_table", "field_name", "max_size", "overlap_size")
    x = g.join(F.broadcast(limits), ["record_table", "field_name"])  # a fixed table of three rows
    shared = F.transform(F.slice("ps", 1, F.size("ps") - 1), lambda r, i: r["end"] - F.get(F.col("ps"), i + 1)["start"])
    whole = F.aggregate("ps", F.lit(""), lambda a, r: F.concat(a, F.substring(r["piece"], F.length(a) - r["start"] + 1, F.length(r["piece"]))))
    return x.select("record_table", "record_id", F.sha2(whole, 256).alias("text_hash"), (F.array_max(F.transform("ps", lambda r: F.length(r["piece"]))) <= F.col("max_size")).alias("within_limit"), F.forall(shared, lambda d: d == F.col("overlap_size")).alias("overlap_kept"))


#: record table, field, list of place_list
TYPED = (("prayer_network_requests", "country", "country"), ("priest_registrations", "country", "country"), ("priest_registrations", "diocese_or_institute", "diocese"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = [load(spark, sf_dir, t).select(F.lit(t).alias("record_table"), F.col("id").alias("record_id"), F.lit(f).alias("field_name"), F.lit(ln).alias("list_name"), F.col(f).alias("value")) for t, f, ln in TYPED]
    return reduce(DataFrame.unionByName, one)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are not literally an entry's name, with the entry meant or 0."""
    typed = _typed(spark, sf_dir).where(F.col("value").isNotNull())
    got = materialise(canonical.assign(typed, load(spark, sf_dir, "place_list")).where(~F.col("is_literal")).select("list_name", "value", "entry_id"))
    return lookup(typed, got, ["list_name", "value"], "inner").select("record_table", "record_id", "field_name", "entry_id").distinct()


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct value of each list with its entry, score and number of rows; entry 0 reports a miss."""
    return canonical.assign(_typed(spark, sf_dir), load(spark, sf_dir, "place_list"))


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and type of text of every document."""
    return quality.classify(spread(load(spark, sf_dir, "documents").select("doc_id", "text")))


def p10_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What expectation-maximisation learned: for each labelling function and type how likely its votes are, at the start and in the end."""
    return quality.trust(spread(load(spark, sf_dir, "documents").select("doc_id", "text")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly a list, a table or junk."""
    return p10_quality(spark, sf_dir).where(F.col("text_class") != "prose").select("doc_id", "text_class").distinct()


def _label_languages(label):
    """Sorted codes of the languages that a label names: null for none, region and script subtags dropped."""
    table = {n: (code,) for code, names in NAMES.items() for n in names} | BOTH
    known = F.create_map(*[x for n, codes in sorted(table.items()) for x in (F.lit(n), F.array(*map(F.lit, codes)))])
    parts = F.split(F.lower(F.trim(label)), r"\s*(?:[/,;+&|]|\band\b)\s*")
    base = F.transform(parts, lambda p: known[F.regexp_replace(p, r"[-_].*$", "")])
    return F.array_sort(F.array_distinct(F.flatten(F.filter(base, lambda x: x.isNotNull()))))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_table, record_id, label, text of the four tables with language labels."""
    one = [("documents", "doc_id", "lang", F.col("text")), ("prayer_network_requests", "id", "language", F.col("intention")), ("chat_exchanges", "exchange_id", "language", F.col("message")), ("cms_publications", "id", "language_mode", F.concat_ws("\n\n", "body_en", "body_kha"))]
    return spread(reduce(DataFrame.unionByName, [load(spark, sf_dir, t).select(F.lit(t).alias("record_table"), F.col(k).alias("record_id"), F.col(lab).alias("label"), x.alias("text")) for t, k, lab, x in one]))


FREE_TEXT = (("prayer_network_requests", "intention"), ("contact_messages", "message"), ("mass_intention_requests", "intention_text"))


def _free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(reduce(DataFrame.unionByName, [load(spark, sf_dir, t).select(F.lit(t).alias("record_table"), F.col("id").alias("record_id"), F.col(f).alias("text")) for t, f in FREE_TEXT]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of personal data in the free text of each record."""
    texts = _free_text(spark, sf_dir).where(F.col("text").isNotNull())
    parts = pii.parameters(texts)
    return texts.mapInPandas(lambda it: pii.find(it, parts), "record_table string, record_id long, pii_type string").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's free text with personal data replaced by placeholders that name its type."""
    texts = _free_text(spark, sf_dir)
    parts = pii.parameters(texts)
    return texts.mapInPandas(lambda it: pii.redacted(it, parts), "record_table string, record_id long, redacted string").dropDuplicates(["record_table", "record_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose label is missing or does not name exactly the languages of the text, one row per language."""
    params = langid.model()
    told = _spoken(spark, sf_dir).mapInArrow(lambda it: langid.languages(it, params), "record_table string, record_id long, label string, langs array<string>, confidence double")
    off = told.where(F.size("langs") > 0).withColumn("named", F.coalesce(_label_languages(F.col("label")), F.array().cast("array<string>"))).where(F.array_sort("langs") != F.col("named"))
    # tables and junk have no language worth a label
    void = p10_found(spark, sf_dir).where(F.col("text_class").isin("table", "junk")).select(F.lit("documents").alias("record_table"), F.col("doc_id").alias("record_id"))
    return off.join(void, ["record_table", "record_id"], "left_anti").select("record_table", "record_id", F.explode("langs").alias("lang_found")).distinct()


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language of every record, with its confidence."""
    params = langid.model()
    got = _spoken(spark, sf_dir).drop("label").mapInArrow(lambda it: langid.stretches(it, params), "record_table string, record_id long, stretch_no int, lang_found string, confidence double, n_words int, stretch string")
    return got.dropDuplicates(["record_table", "record_id", "stretch_no"])


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair once, with its defect (null if sound) and the words of its reply under each tag."""
    return pairs.judge(spread(load(spark, sf_dir, "chat_exchanges").select("exchange_id", "message", "reply", "scope"))).dropDuplicates(["exchange_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a defect."""
    return pairs.judge(spread(load(spark, sf_dir, "chat_exchanges").select("exchange_id", "message", "reply", "scope"))).where(F.col("defect_type").isNotNull()).select("exchange_id", "defect_type").distinct()


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return int(load(spark, sf_dir, "size_limits").where("task = 'pack'").agg(F.max("max_size")).first()[0])


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every text of documents goes."""
    return packing.pack(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), _capacity(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room used by the containers, against the fewest that could hold all tokens."""
    cap = _capacity(spark, sf_dir)
    c = p8_containers(spark, sf_dir)
    per = c.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return per.agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), F.min("t").alias("emptiest"), F.sum("k").alias("n_pieces"), F.round(F.sum("t") / (F.count("*") * cap), 4).alias("used_share"), F.ceil(F.sum("t") / cap).alias("least_containers"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: which texts, how often, and how many of their tokens."""
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source of the mixture."""
    return mixing.shares(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p2_surfaces": p2_surfaces, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover, "p5_found": p5_found, "p5_stretches": p5_stretches, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_found": p7_found, "p7_values": p7_values, "p8_containers": p8_containers, "p8_report": p8_report, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_quality": p10_quality, "p10_trust": p10_trust}

SQL: dict[str, str] = {
    "p4_found": """
        SELECT DISTINCT 'cms_publications' AS record_table, id AS record_id FROM cms_publications
        WHERE length(body_en) > (SELECT max_size FROM size_limits WHERE task = 'split' AND record_table = 'cms_publications')
        UNION ALL
        SELECT DISTINCT 'text_blocks' AS record_table, block_id AS record_id FROM text_blocks
        WHERE length(text) > (SELECT max_size FROM size_limits WHERE task = 'split' AND record_table = 'text_blocks')""",
    # what must hold of the pieces of every text: they give it back, keep to the limit and share the overlap
    "p4_cover": """
        SELECT 'cms_publications' AS record_table, id AS record_id, sha256(body_en) AS text_hash, true AS within_limit, true AS overlap_kept FROM (SELECT DISTINCT id, body_en FROM cms_publications WHERE body_en <> '')
        UNION ALL
        SELECT 'text_blocks', block_id, sha256(text), true, true FROM (SELECT DISTINCT block_id, text FROM text_blocks WHERE text <> '')""",
}
