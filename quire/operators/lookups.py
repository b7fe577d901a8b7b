"""Lookups against dimensions: passages of verse ranges, lexicon entries, forms, lenses, and chains of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.references import lookup
from quire.functions.text import collapse


def passage(wanted: DataFrame, verses: DataFrame, keys: list[str]) -> DataFrame:
    """Verses of ranges (``ref``, keys, ``verse_from``, ``verse_to``): each row that covers a number once, in order.

    ``status`` is ``ok``, or ``not found`` where any number of the range is missing; then there are no verses.
    """
    n = wanted.select("ref", *keys, F.explode(F.sequence("verse_from", F.coalesce("verse_to", "verse_from"))).alias("verse_no"))
    got = lookup(n, verses, keys).withColumn("missing", F.col("verse").isNull())
    g = got.groupBy("ref", *keys).agg(F.bool_or("missing").alias("gap"), F.array_sort(F.collect_list(F.struct("verse_no", "verse", "text"))).alias("vs"))
    first = F.transform("vs", lambda v, i: F.struct(v["verse"].alias("verse"), v["text"].alias("text"), ((i == 0) | (v["verse"] != F.get(F.col("vs"), i - 1)["verse"])).alias("new")))  # a bridge covers neighbours
    kept = F.filter(first, lambda v: v["new"])
    return g.select("ref", *keys, F.when(F.col("gap"), "not found").otherwise("ok").alias("status"), F.when(~F.col("gap"), F.transform(kept, lambda v: F.struct(v["verse"].alias("verse"), v["text"].alias("text")))).alias("verses"))


def by_number(asked: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """The lexicon entry of each number (J07, J09): as it stands, else padded to four digits where it is ``H`` and digits; of several
    entries the one whose own number it is, else the first."""
    key = F.col(column)
    padded = F.when(key.rlike(r"^H\d+$"), F.concat(F.lit("H"), F.lpad(F.regexp_extract(key, r"^H0*(\d+)$", 1), 4, "0")))
    ways = asked.select(column).distinct().select(column, F.posexplode(F.array_distinct(F.array_compact(F.array(key, padded)))).alias("level", "alias"))
    hit = ways.join(index, "alias").select(column, "level", "alias", F.posexplode("entries").alias("place", "e"))
    best = hit.groupBy(column).agg(F.min(F.struct("level", F.when(F.col("e.d_strong").eqNullSafe(F.col(column)), 0).otherwise(1).alias("other"), "place", "e")).alias("b"))
    return asked.join(best.select(column, F.col("b.level").alias("level"), F.col("b.e").alias("entry")), column, "left")


def first_under(asked: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """The first entry under a normalised lemma."""
    return asked.join(index.select(F.col("key").alias(key), F.col("entries")[0].alias("entry")), key, "left")


def form_facts(asked: DataFrame, code: str, language: str, forms: DataFrame) -> DataFrame:
    """Summary and features of a form's code in its language (J10); without a code or an entry they are null. The table of forms is small and Spark broadcasts it by its size."""
    return asked.join(forms.select(F.col("language").alias(language), F.col("code").alias(code), "summary", "features"), [language, code], "left")


def lens(book: Column, rules: tuple[tuple[tuple[str, ...], str], ...], otherwise: Column) -> Column:
    """The first rule whose books hold the book."""
    out = None
    for books, name in rules:
        out = F.when(book.isin(*books), name) if out is None else out.when(book.isin(*books), name)
    return otherwise if out is None else out.otherwise(otherwise)


def quotation_violations(quotes: DataFrame, sources: DataFrame, toc: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``quote_id, rule`` of quotations that do not hold.

    The chain: a quotation names a source, a section of its table of contents, and a paragraph by its place in the
    section; the quotation must stand in that paragraph once white space is collapsed.
    """
    q = quotes.join(sources.select("source_id", F.lit(True).alias("s")), "source_id", "left").join(toc.select("source_id", "section_index", F.lit(True).alias("t")), ["source_id", "section_index"], "left")
    q = q.join(paragraphs.select("source_id", "section_index", "paragraph_index", F.col("text").alias("body"), F.lit(True).alias("p")), ["source_id", "section_index", "paragraph_index"], "left")
    rule = F.when(F.col("s").isNull(), "unknown source").when(F.col("t").isNull(), "missing section").when(F.col("p").isNull(), "invalid paragraph").when(~F.coalesce(F.contains(collapse(F.col("body")), collapse(F.col("quote"))), F.lit(False)), "not a substring")
    return q.select("quote_id", rule.alias("rule")).where("rule is not null")


def coverage_violations(declared: DataFrame, audited: DataFrame, segments: DataFrame, source_refs: DataFrame) -> DataFrame:
    """``mapping, rule, what`` (V03): chapters declared but not audited, or audited but not declared; chapters declared without a segment; source verses of a structural chapter that no segment consumes.

    ``declared``: mapping, chapter, kind (audited, override, structural). ``audited``: mapping, chapter.
    ``segments``: mapping, chapter, source (array of ``chapter:verse``). ``source_refs``: mapping, chapter, verse.
    """
    d = declared.where("kind <> 'override'").select("mapping", "chapter").distinct()
    extra = d.join(audited, ["mapping", "chapter"], "left_anti").select("mapping", F.lit("declared, not audited").alias("rule"), F.col("chapter").alias("what"))
    lacking = audited.join(d, ["mapping", "chapter"], "left_anti").select("mapping", F.lit("audited, not declared").alias("rule"), F.col("chapter").alias("what"))
    bare = declared.where("kind <> 'structural'").join(segments.select("mapping", "chapter").distinct(), ["mapping", "chapter"], "left_anti").select("mapping", F.lit("no segment").alias("rule"), F.col("chapter").alias("what")).distinct()
    used = segments.select("mapping", F.explode("source").alias("what")).distinct()
    structural = declared.where("kind = 'structural'").select("mapping", "chapter").distinct()
    left = source_refs.join(structural, ["mapping", "chapter"]).select("mapping", F.concat_ws(":", "chapter", "verse").alias("what")).join(used, ["mapping", "what"], "left_anti").select("mapping", F.lit("not consumed").alias("rule"), "what")
    return extra.unionByName(lacking).unionByName(bare).unionByName(left)


def layer_violations(surface: DataFrame, aligned: DataFrame, gaps: DataFrame, verse: list[str]) -> DataFrame:
    """Verse keys and ``rule`` (V05): the surface and the alignment of a verse must have as many tokens with the same ids in the same order; a verse of ``gaps`` must have no aligned tokens, every other one must.

    ``surface`` and ``aligned`` have verse keys, position and id.
    """
    nest = lambda d, name: d.groupBy(*verse).agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias(name)).select(*verse, F.col(f"{name}.id").alias(name))
    j = nest(surface, "a").join(nest(aligned, "b"), verse, "full").join(gaps.select(*verse, F.lit(True).alias("gap")).distinct(), verse, "left")
    rule = F.when(F.col("gap") & F.col("b").isNotNull(), "gap carries tokens").when(F.col("gap"), F.lit(None)).when(F.col("b").isNull(), "not aligned").when(F.col("a").isNull(), "no surface").when(F.size("a") != F.size("b"), "token counts differ").when(F.col("a") != F.col("b"), "token ids differ")
    return j.select(*verse, rule.alias("rule")).where("rule is not null")


def concordance_violations(sections: DataFrame, chapters: DataFrame, rows: DataFrame) -> DataFrame:
    """``rule, what`` (V09): sections must be numbered without gaps from 1, lie in the chapter whose span holds them, and begin, where they have an anchor, with their own number at it.

    ``sections``: section, chapter, row_index. ``chapters``: chapter, start_section, end_section. ``rows``: row_index, text.
    """
    top = sections.agg(F.max("section").alias("n"))
    gaps = top.select(F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))).alias("section")).join(sections.select("section"), "section", "left_anti").select(F.lit("missing section").alias("rule"), F.col("section").cast("string").alias("what"))
    spans = chapters.select(F.col("chapter").alias("own"), F.explode(F.sequence("start_section", "end_section")).alias("section"))
    moved = sections.join(spans, "section", "left").where(~F.col("own").eqNullSafe(F.col("chapter"))).select(F.lit("wrong chapter").alias("rule"), F.col("section").cast("string").alias("what"))
    at = sections.where("row_index is not null").join(rows, "row_index", "left")
    off = at.where(~F.coalesce(F.ltrim("text").startswith(F.concat(F.col("section").cast("string"), F.lit("."))), F.lit(False))).select(F.lit("anchor differs").alias("rule"), F.col("section").cast("string").alias("what"))
    return gaps.unionByName(moved).unionByName(off)


def filtered(df: DataFrame, among: dict[str, list | None] | None = None, matching: str | None = None, haystack: tuple[str, ...] = (), any_of: tuple[Column, ...] = ()) -> DataFrame:
    """Filters that are there only if asked for (P04, P06): values of columns (``None`` asks nothing), any of several conditions, and a text in any of the haystack's columns."""
    for column, values in (among or {}).items():
        if values is not None:
            df = df.where(F.col(column).isin(values))
    if any_of:
        either = any_of[0]
        for c in any_of[1:]:
            either = either | c
        df = df.where(either)
    if matching:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *haystack)), F.lit(matching.lower())))
    return df
