"""Readers for the corpus formats. Line formats are DataFrame plans; nested markup goes through Arrow batches.

Every reader takes paths (or an existing DataFrame of texts) and gives plain rows; a line or element that does not fit
gives no row here and one in the matching ``*_rejects`` plan, never an error in the middle of a job.
"""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import all_strongs, context_gloss, first_strong, markup_free

# --- line formats --------------------------------------------------------------------------------------------------

#: How the formats write a verse, a locus and a lexicon number.
VERSE_LINE = r"^(\S.*?)\s+(\d+):(\d+(?:[-,]\d+)?)\t(.*\S.*)$"
LOCUS = r"^(\w+)\.(\d+)\.(\d+)#(\d+)(?:=(\w+))?$"
STRONG = r"[GH]\d{4,5}[A-Z]?"


def lines_of(spark: SparkSession, src: str | DataFrame) -> DataFrame:
    """``file, line_no, value`` of the files at a path, or of a DataFrame that has ``value`` (and the others, where known)."""
    if isinstance(src, DataFrame):
        for name, c in (("file", F.lit("")), ("line_no", F.monotonically_increasing_id())):
            src = src if name in src.columns else src.withColumn(name, c)
        return src.select("file", "line_no", "value")
    return spark.read.text(src).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def verse_tsv(spark: SparkSession, src: str | DataFrame) -> DataFrame:
    """``book chapter:verse <tab> text`` lines -> book, chapter, verse, text; other lines give none."""
    part = lambda k: F.regexp_extract("value", VERSE_LINE, k)
    return lines_of(spark, src).where(F.col("value").rlike(VERSE_LINE)).select(part(1).alias("book"), part(2).cast("int").alias("chapter"), part(3).alias("verse"), F.trim(part(4)).alias("text"))


def verse_tsv_rejects(spark: SparkSession, src: str | DataFrame) -> DataFrame:
    """Lines without a reference, with an empty text, or whose reference comes again."""
    v = verse_tsv(spark, src)
    twice = v.groupBy("book", "chapter", "verse").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("reason"), F.concat_ws(" ", "book", F.concat_ws(":", "chapter", "verse")).alias("what"))
    return lines_of(spark, src).where((F.trim("value") != "") & ~F.col("value").rlike(VERSE_LINE)).select(F.lit("malformed").alias("reason"), F.col("value").alias("what")).unionByName(twice)


def positional_records(spark: SparkSession, src: str | DataFrame) -> DataFrame:
    """Seven fields a line, the first ``BBCCVV``; the place within the verse is the order of the lines of its file."""
    raw = lines_of(spark, src).withColumn("f", F.split(F.trim("value"), r"\s+", 7)).where(F.size("f") == 7)
    key = F.col("f")[0]
    rows = raw.where(key.rlike(r"^\d{6}$")).select("file", "line_no", F.substring(key, 1, 2).cast("int").alias("book_no"), F.substring(key, 3, 2).cast("int").alias("chapter"), F.substring(key, 5, 2).cast("int").alias("verse"), *[F.col("f")[i].alias(n) for i, n in enumerate(("part_of_speech", "parsing", "surface", "word", "normalized", "lemma"), 1)])
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("file", "book_no", "chapter", "verse").orderBy("line_no"))).drop("line_no")


def lexicon_tsv(spark: SparkSession, path: str, columns: tuple[str, ...], key_pattern: str = rf"^{STRONG}$", drop: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated entries whose first field is a lexicon number; restricted columns are dropped in the scan."""
    d = spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in columns), quote="", mode="PERMISSIVE")
    return d.where(F.col(columns[0]).rlike(key_pattern)).drop(*drop)


def lexicon_entries(spark: SparkSession, src: str | DataFrame) -> DataFrame:
    """Eight fields a line: own, disambiguated and unified number, lemma, transliteration, form, gloss, meaning."""
    f = lines_of(spark, src).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 8)
    first = lambda k: F.nullif(F.regexp_extract(F.col("f")[k], f"({STRONG})", 1), F.lit(""))
    d = f.select("file", "line_no", F.trim(F.col("f")[0]).alias("e_strong"), first(1).alias("d_strong"), first(2).alias("u_strong"), *[F.trim(F.col("f")[k]).alias(n) for k, n in ((3, "lemma"), (4, "transliteration"), (5, "lexical_morphology"))], markup_free(F.col("f")[6]).alias("gloss"), markup_free(F.col("f")[7]).alias("meaning"))
    return d.where(F.col("e_strong").rlike(f"^{STRONG}$"))


def alias_index(entries: DataFrame) -> DataFrame:
    """``alias, entries``: each number an entry goes by, and its entries in the order of the file."""
    aliases = F.array_distinct(F.filter(F.array("e_strong", "d_strong", "u_strong"), lambda x: x.isNotNull()))
    e = entries.select(F.explode(aliases).alias("alias"), F.struct("file", "line_no", "d_strong", "lemma", "gloss").alias("e"))
    return e.groupBy("alias").agg(F.array_sort(F.collect_list("e")).alias("entries"))


def lemma_index(entries: DataFrame, key: Column) -> DataFrame:
    """``key, entries``: the entries under one normalised lemma, in the order of the file."""
    e = entries.select(key.alias("key"), F.struct("file", "line_no", "e_strong", "lemma", "gloss").alias("e")).where("key <> ''")
    return e.groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("entries"))


def record_blocks(spark: SparkSession, src: str | DataFrame, mark: str = "$") -> DataFrame:
    """Records that start at a line beginning with ``mark``: code, and all lines up to the next.

    A DataFrame holds whole texts in ``value``.
    """
    whole = src if isinstance(src, DataFrame) else spark.read.text(src, wholetext=True).withColumn("file", F.input_file_name())
    d = whole.select("file", F.posexplode(F.split("value", rf"(?m)^{re.escape(mark)}")).alias("record_no", "body")).where("record_no > 0")
    parts = F.split("body", "\n")
    return d.select("file", "record_no", F.trim(parts[0]).alias("code"), F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))


def tagged_tokens(spark: SparkSession, src: str | DataFrame, edition: str | None = None) -> DataFrame:
    """``locus#n=type <tab> surface (translit) <tab> gloss <tab> strong=morph <tab> lemma=gloss <tab> editions`` lines."""
    f = lines_of(spark, src).withColumn("f", F.split("value", "\t")).where(F.col("f")[0].rlike(LOCUS) & (F.size("f") >= 5))
    loc = lambda k: F.regexp_extract(F.col("f")[0], LOCUS, k)
    d = f.select(loc(1).alias("book"), loc(2).cast("int").alias("chapter"), loc(3).cast("int").alias("verse"), loc(4).cast("int").alias("source_position"), loc(5).alias("text_type"), F.trim(F.regexp_extract(F.col("f")[1], r"^([^(]*)", 1)).alias("surface"), F.regexp_extract(F.col("f")[1], r"\(([^)]*)\)", 1).alias("transliteration"), context_gloss(F.col("f")[2]).alias("contextual_gloss"), F.regexp_extract(F.col("f")[3], f"({STRONG})", 1).alias("strong"), F.regexp_extract(F.col("f")[3], r"=(.*)$", 1).alias("morphology_code"), F.split(F.col("f")[4], "=")[0].alias("lemma"), F.get(F.col("f"), F.lit(5)).alias("editions"))
    return d.where(F.col("editions").contains(edition)) if edition else d


def rooted_tokens(spark: SparkSession, src: str | DataFrame, types: tuple[str, ...] = ("L", "Q", "R", "X")) -> DataFrame:
    """``locus#n=type <tab> surface <tab> translit <tab> gloss <tab> strong{root} <tab> form`` lines of the wanted text types.

    The root is the number in braces, else the first number; all numbers are kept in order, each once.
    """
    f = lines_of(spark, src).withColumn("f", F.split("value", "\t")).where(~F.col("value").startswith("#") & (F.size("f") >= 6) & F.trim(F.col("f")[0]).rlike(LOCUS))
    loc = lambda k: F.regexp_extract(F.trim(F.col("f")[0]), LOCUS, k)
    tags = F.trim(F.col("f")[4])
    root = F.coalesce(F.nullif(F.regexp_extract(tags, r"\{(H\d{4,5}[A-Z]?)\}", 1), F.lit("")), first_strong(tags))
    d = f.select(loc(1).alias("book"), loc(2).cast("int").alias("chapter"), loc(3).cast("int").alias("verse"), loc(4).cast("int").alias("source_position"), loc(5).alias("text_type"), F.trim(F.col("f")[1]).alias("surface"), F.trim(F.col("f")[2]).alias("transliteration"), context_gloss(F.col("f")[3]).alias("contextual_gloss"), root.alias("root_strong"), all_strongs(tags).alias("strong_tags"), F.trim(F.col("f")[5]).alias("morphology_code"))
    return d.where(F.substring("text_type", 1, 1).isin(*types))


def supplement_tokens(spark: SparkSession, src: str | DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Up to thirteen columns a token: locus, surface, translation, grammar, dictionary, editions, variants and further numbers.

    ``parts_of_speech``: the heads of the grammar codes, each once; ``dictionary_forms``: what stands before ``=`` in
    each part of the dictionary field. ``wanted`` (``reference``) keeps some verses only. Rows without surface, grammar
    or dictionary entry have ``problem``, as have repeated places.
    """
    f = lines_of(spark, src).withColumn("f", F.split("value", "\t")).where((F.size("f") >= 6) & F.col("f")[0].rlike(LOCUS))
    loc = lambda k: F.regexp_extract(F.col("f")[0], LOCUS, k)
    col = lambda k: F.trim(F.coalesce(F.get(F.col("f"), F.lit(k)), F.lit("")))
    pos = F.array_distinct(F.transform(F.regexp_extract_all(col(3), F.lit(r"=([A-Z][A-Za-z0-9-]*)")), lambda x: F.split(x, "-")[0]))
    forms = F.array_distinct(F.filter(F.transform(F.split(col(4), r"\s\+\s"), lambda x: F.trim(F.split(x, "=")[0])), lambda x: x != ""))
    d = f.select(F.concat_ws(":", loc(1), loc(2), loc(3)).alias("reference"), loc(4).cast("int").alias("position"), loc(5).alias("word_type"), F.trim(F.regexp_extract(col(1), r"^([^(]*)", 1)).alias("surface"), col(2).alias("translation"), col(3).alias("grammar"), pos.alias("parts_of_speech"), col(4).alias("dictionary_raw"), forms.alias("dictionary_forms"), col(5).alias("editions"), col(6).alias("meaning_variants"), col(7).alias("spelling_variants"), col(11).alias("instance"), col(12).alias("alternative_strongs"))
    d = d.join(F.broadcast(wanted.select("reference").distinct()), "reference", "left_semi") if wanted is not None else d
    twice = F.count("*").over(Window.partitionBy("reference", "position")) > 1
    return d.withColumn("problem", F.when((F.col("surface") == "") | (F.col("grammar") == "") | (F.col("dictionary_raw") == ""), "empty field").when(twice, "repeated place"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that do not parse are null rows and left out."""
    return spark.read.schema(schema).json(path).dropna(how="all")


def identified_jsonl(spark: SparkSession, src: str | DataFrame, identity: dict[str, str], locus: str = r"^(\d+)\.(\d+)$") -> DataFrame:
    """``chapter, verse, surface, problem`` of JSON lines whose other fields must have the values of ``identity``.

    ``problem`` is null for a sound line, else ``invalid``, ``identity``, ``locus``, ``empty`` or ``repeated``.
    """
    d = lines_of(spark, src).where(F.trim("value") != "").withColumn("j", F.try_parse_json("value").cast("string"))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    same = [F.coalesce(get(k) == v, F.lit(False)) for k, v in identity.items()]
    known = same[0]
    for c in same[1:]:
        known = known & c
    at = F.coalesce(get("locus"), F.lit(""))
    d = d.select("file", "line_no", F.col("j").isNotNull().alias("ok"), known.alias("known"), at.alias("locus"), F.regexp_extract(at, locus, 1).alias("chapter"), F.regexp_extract(at, locus, 2).alias("verse"), F.trim(F.regexp_replace(F.coalesce(get("text"), F.lit("")), r"\s+", " ")).alias("surface"))
    again = F.row_number().over(Window.partitionBy("chapter", "verse").orderBy("file", "line_no")) > 1
    problem = F.when(~F.col("ok"), "invalid").when(~F.col("known"), "identity").when(~F.col("locus").rlike(locus), "locus").when(F.col("surface") == "", "empty").when(again, "repeated")
    return d.select("chapter", "verse", "surface", problem.alias("problem"))


WORD_FIELDS = ("surface", "lemma", "pos", "source", "reasoning")


def component_tokens(members: DataFrame) -> DataFrame:
    """Members (``member``, ``content``) that are JSON arrays of ``{ref, words}`` as one row a word, with ``problem``."""
    schema = "array<struct<ref:string,words:array<struct<surface:string,lemma:string,pos:string,source:string,reasoning:string,parsing:string,confidence:double>>>>"
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    m = members.select("member", F.from_json(text, schema).alias("rows"))
    broken = m.where(F.col("rows").isNull() | (F.size("rows") == 0)).select("member", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("position"), *[F.lit(None).cast("string").alias(x) for x in ("surface", "lemma", "part_of_speech", "morphology")], F.lit("no rows").alias("problem"))
    r = m.select("member", F.posexplode("rows").alias("row_no", "r")).select("member", "row_no", F.trim(F.coalesce("r.ref", F.lit(""))).alias("ref"), "r.words")
    twice = F.row_number().over(Window.partitionBy("member", "ref").orderBy("row_no")) > 1
    r = r.withColumn("bad", F.when((F.col("ref") == "") | twice, "missing or repeated ref").when(F.coalesce(F.size("words"), F.lit(0)) < 1, "no words"))
    w = r.select("member", "ref", "bad", F.posexplode_outer("words").alias("at", "w"))
    empty = None
    for x in WORD_FIELDS:
        c = F.trim(F.coalesce(F.col(f"w.{x}"), F.lit(""))) == ""
        empty = c if empty is None else empty | c
    return w.select("member", "ref", (F.col("at") + 1).alias("position"), "w.surface", "w.lemma", F.col("w.pos").alias("part_of_speech"), F.coalesce("w.parsing", F.lit("")).alias("morphology"), F.coalesce("bad", F.when(empty, "empty field")).alias("problem")).unionByName(broken)


def contained(root: str, name: str) -> str:
    """The path of ``name`` under ``root``; a name that leads out of it is an error."""
    full = posixpath.normpath(posixpath.join(root, name))
    if name.startswith("/") or not (full + "/").startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{name!r} leads out of {root!r}")
    return full


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def corpus_verses(books: DataFrame) -> DataFrame:
    """Books with ``chapters: map<chapter, map<verse, text>>`` as one row a verse."""
    return books.select("id", F.explode("chapters").alias("chapter", "vs")).select(F.col("id").alias("book_id"), F.col("chapter").cast("int").alias("chapter"), F.explode("vs").alias("verse", "text"))


def identity_violations(df: DataFrame, **wanted: str) -> DataFrame:
    """``field, found, n``: values of the fields that are not the one they must have, as licence and identity."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("found"), F.lit(v).alias("must")) for k, v in wanted.items()])
    return df.select(F.explode(pairs).alias("p")).where(~F.col("p.found").eqNullSafe(F.col("p.must"))).groupBy("p.field", "p.found").agg(F.count("*").alias("n"))


def layer(spark: SparkSession, root: str, layer_name: str, book_id: str | None = None) -> DataFrame:
    """A table partitioned by layer and book; both filters prune folders."""
    if not re.fullmatch(r"[a-z0-9_-]+", layer_name) or book_id and not re.fullmatch(r"[a-z0-9_-]+", book_id):
        raise ValueError("layer and book names hold lower case letters, digits, - and _ only")
    d = spark.read.parquet(root).where(F.col("layer") == layer_name)
    return d.where(F.col("book_id") == book_id) if book_id else d


# --- marked-up texts -----------------------------------------------------------------------------------------------


def usfm(texts: DataFrame, text: str = "value") -> DataFrame:
    r"""``\id``, ``\c`` and ``\v`` carried forward over the lines, continuation lines joined."""
    lines = texts.withColumn("doc", F.monotonically_increasing_id()).select("doc", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda p: F.last(F.nullif(F.regexp_extract("line", p, 1), F.lit("")), ignorenulls=True).over(w)
    c = lines.withColumn("book", carry(r"^\\id\s+(\S+)")).withColumn("chapter", carry(r"^\\c\s+(\d+)")).withColumn("verse", F.when(F.col("line").rlike(r"^\\c\s"), F.lit("")).otherwise(F.nullif(F.regexp_extract("line", r"^\\v\s+(\d+(?:[-,]\d+)?)", 1), F.lit(""))))
    c = c.withColumn("verse", F.last("verse", ignorenulls=True).over(w))
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"(?s)\\f\s.*?\\f\*|\\x\s.*?\\x\*", ""), r"^\\v\s+\S+\s*|\\[a-z]+\d*\*?\s?", ""), "~", " "))
    b = c.where((F.coalesce("verse", F.lit("")) != "") & ~F.col("line").rlike(r"^\\(?:id|c|s\d?|r|h|toc\d?|mt\d?)\b")).withColumn("body", body).where("body <> ''")
    return b.groupBy("doc", "book", "chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("x")).select("book", F.col("chapter").cast("int").alias("chapter"), "verse", F.array_join("x.body", " ").alias("text"))


def _rows(fn, schema: str, df: DataFrame, columns: list[str]) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for args in b.itertuples(index=False, name=None) for r in fn(*args)], columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def _usfx(source: str, content) -> list[tuple]:
    """Milestones ``c``, ``v`` and ``ve`` among running text."""
    out, chapter, verse, buf = [], None, None, []
    for ev, el in ET.iterparse(io.BytesIO(bytes(content)), events=("start", "end")):
        if ev == "start":
            if el.tag == "c":
                chapter = el.get("id")
            elif el.tag == "v":
                verse, buf = el.get("id"), []
            elif el.tag == "ve" and verse:
                out.append((source, chapter, verse, re.sub(r"\s+", " ", "".join(buf)).strip()))
                verse = None
            elif verse and el.text and el.tag not in ("f", "x"):
                buf.append(el.text)
        elif verse and el.tail:
            buf.append(el.tail)
    return out


def _osis(source: str, content) -> list[tuple]:
    """Verse elements and their own words; words nested in notes are another reading and left out."""
    out = []
    for _, el in ET.iterparse(io.BytesIO(bytes(content))):
        if el.tag.rpartition("}")[2] == "verse":
            for k, w in enumerate((x for x in el if x.tag.rpartition("}")[2] == "w"), 1):
                out.append((source, el.get("osisID"), k, "".join(w.itertext()), w.get("lemma"), w.get("morph")))
            el.clear()
    return out


_SKIP = {"note", "pb", "milestone", "head"}


def _tei(source: str, content) -> list[tuple]:
    """Chapter and verse divisions of the edition; text after a left-out element is kept."""

    def text(el) -> str:
        s = el.text or ""
        for x in el:
            if x.tag.rpartition("}")[2] not in _SKIP:
                s += text(x)
            s += x.tail or ""
        return s

    out = []
    for div in ET.fromstring(bytes(content)).iter():
        if div.tag.rpartition("}")[2] == "div" and div.get("subtype") == "chapter":
            for v in div.iter():
                if v.tag.rpartition("}")[2] in ("div", "ab", "seg") and v.get("subtype") == "verse":
                    out.append((source, div.get("n"), v.get("n"), re.sub(r"\s+", " ", text(v)).strip()))
    return out


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, length and content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def usfx(f: DataFrame) -> DataFrame:
    return _rows(_usfx, "source string, chapter string, verse string, text string", f, ["path", "content"])


def osis(f: DataFrame) -> DataFrame:
    return _rows(_osis, "source string, ref string, position int, surface string, lemma string, morphology string", f, ["path", "content"])


def tei(f: DataFrame) -> DataFrame:
    return _rows(_tei, "source string, chapter string, verse string, text string", f, ["path", "content"])


def _members(path: str, content) -> list[tuple]:
    raw = io.BytesIO(bytes(content))
    if zipfile.is_zipfile(raw):
        with zipfile.ZipFile(raw) as z:
            return [(path, i.filename, i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir()]
    raw.seek(0)
    with tarfile.open(fileobj=raw) as t:
        return [(path, m.name, m.size, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]


def archive_members(f: DataFrame) -> DataFrame:
    """Members of ZIP and tar archives."""
    return _rows(_members, "archive string, member string, size long, content binary", f, ["path", "content"])


def archive_previews(members: DataFrame, interesting: str = r"(?i)readme|licen|\.(?:txt|tsv|csv|json)$", lines: int = 12) -> DataFrame:
    """First lines of the members of interest."""
    return members.where(F.col("member").rlike(interesting)).select("archive", "member", "size", F.slice(F.split(F.decode("content", "UTF-8"), "\n"), 1, lines).alias("preview"))


# --- HTML and plain text -------------------------------------------------------------------------------------------


def html_blocks(df: DataFrame, key: str, markup: str) -> DataFrame:
    """Headings and paragraphs of pages in order, without script, style and navigation."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style|nav|head)\b.*?</\1>|<!--.*?-->", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)(<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)>)"), F.lit(1))
    b = df.select(key, F.posexplode(found).alias("block_no", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace("b", r"(?is)<[^>]*>", " "), r"\s+", " "))
    return b.select(key, "block_no", F.when(F.lower("b").rlike(r"^<h[1-6]"), "heading").otherwise("paragraph").alias("kind"), text.alias("text")).where("text <> ''")


def sections(df: DataFrame, key: str, text: str, heading: str = r"^(?:(?:CHAP(?:TER)?|BOOK|HOMILY)\b.*|[IVXLC]+\.)$") -> DataFrame:
    """Plain text as sections: a heading line opens one, blank lines part paragraphs."""
    p = df.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\s*\n|\n(?=(?i:chap|book|homily)\b)|(?<=\.)\n(?=[IVXLC]+\.\n)")).alias("n", "p")).withColumn("p", F.trim(F.regexp_replace("p", r"\s+", " "))).where("p <> ''")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    s = p.withColumn("is_heading", F.col("p").rlike(heading)).withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(w))
    return s.select(key, "section_no", "n", F.when(F.col("is_heading"), "heading").otherwise("paragraph").alias("kind"), F.col("p").alias("text"))
