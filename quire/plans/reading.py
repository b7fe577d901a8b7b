"""The readers and writers at work on whole tables: each query renders a table in a format, reads it back, and gives what the statement gives on the table."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.greek import fold_hebrew_udf
from quire.plans.kit import Catalogue
from quire.plans.passages import _VERSES, TOK, tokens, verse_texts
from quire.session import checkpoint_dir, forgotten
from quire.sources import pages, readers, writers
from quire.tables import load, once

C = Catalogue()

_V = ["witness", "book_id", "chapter", "verse"]


def _verse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verse_texts(spark, sf_dir)
    return v.select(F.concat(F.col("witness"), F.lit("/"), F.col("book_id"), F.lit(" "), F.col("chapter"), F.lit(":"), F.col("verse"), F.lit("\t"), F.col("text")).alias("value"))


@C.plan(f"WITH {_VERSES} SELECT witness || '/' || book_id AS book, chapter, verse, trim(text, ' ') AS text FROM v")
def read_verse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verses as tab-separated lines, and read back."""
    return readers.verse_tsv(spark, _verse_lines(spark, sf_dir))


@C.plan(f"""
    WITH {_VERSES}, h AS (SELECT DISTINCT text FROM text_blocks WHERE kind = 'heading' AND trim(text) <> '')
    SELECT * FROM (SELECT 'malformed' AS reason, CAST(count(*) AS BIGINT) AS n FROM h UNION ALL SELECT 'repeated', CAST(count(*) AS BIGINT) FROM (SELECT book_id, chapter, verse FROM v GROUP BY ALL HAVING count(*) > 1)) WHERE n > 0""")
def read_verse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all witnesses under one name, with headings among them: which are no verses, and which references come again."""
    lines = verse_texts(spark, sf_dir).select(F.concat(F.col("book_id"), F.lit(" "), F.col("chapter"), F.lit(":"), F.col("verse"), F.lit("\t"), F.col("text")).alias("value"))
    heads = load(spark, sf_dir, "text_blocks").where("kind = 'heading' and trim(text) <> ''").select(F.col("text").alias("value")).distinct()
    return readers.verse_tsv_rejects(spark, lines.unionByName(heads)).groupBy("reason").agg(F.count("*").alias("n"))


@C.plan(f"""
    WITH {TOK}, b AS (SELECT book_id, dense_rank() OVER (ORDER BY book_id) AS no FROM (SELECT DISTINCT book_id FROM tok))
    SELECT witness AS file, CAST(no AS INTEGER) AS book_no, chapter, CAST(verse AS INTEGER) AS verse, CAST(row_number() OVER (PARTITION BY witness, tok.book_id, chapter, verse ORDER BY position, id) AS INTEGER) AS position, id AS lemma FROM tok JOIN b ON b.book_id = tok.book_id""")
def read_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as seven fields a line under a key of book, chapter and verse; the place is the order of the lines."""
    t = tokens(spark, sf_dir)
    books = sorted(r[0] for r in t.select("book_id").distinct().collect())  # a canon has few books
    no = F.element_at(F.create_map(*[x for k, b in enumerate(books, 1) for x in (F.lit(b), F.lit(k))]), F.col("book_id"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    line = F.concat_ws(" ", F.concat(two(no), two(F.col("chapter")), two(F.col("verse"))), F.lit("N- ----NSF-"), F.lit("s w n"), "id")
    return readers.positional_records(spark, t.select(F.col("witness").alias("file"), F.struct("position", "id").alias("line_no"), line.alias("value"))).select("file", "book_no", "chapter", "verse", "position", "lemma")


#: A lexicon number of a word: not one of its own, so that words share numbers as entries share aliases.
_NO = "lpad(CAST((ascii(k) * 31 + length(k) * 7) % 900 + 1 AS VARCHAR), 4, '0')"


def _lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "grc_tokens").select(F.col("transliteration").alias("k")).where("k is not null").distinct()
    no = F.lpad(((F.ascii("k") * 31 + F.length("k") * 7) % 900 + 1).cast("string"), 4, "0")
    line = F.concat_ws("\t", F.concat(F.lit("G"), no), F.concat(F.lit("G"), no, F.lit("A = see")), F.concat(F.lit("G9"), F.substring(no, 2, 3), F.lit(" =")), "k", "k", F.lit("N:M"), F.concat(F.lit("a <b>"), "k", F.lit("</b>&amp;__word¶")), F.lit("x  y"))
    return w.select(F.lit("lexicon").alias("file"), F.col("k").alias("line_no"), line.alias("value"))


_LEX = f"WITH {TOK}, w AS (SELECT DISTINCT transliteration AS k FROM tok WHERE transliteration IS NOT NULL), e AS (SELECT k, 'G' || {_NO} AS e_strong, 'G' || {_NO} || 'A' AS d_strong, 'G9' || substr({_NO}, 2, 3) AS u_strong FROM w)"


@C.plan(f"{_LEX} SELECT e_strong, d_strong, u_strong, k AS lemma, trim('a ' || k || ' & word') AS gloss, 'x y' AS meaning FROM e")
def read_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words as lexicon entries, with markup and entities in the gloss, and read back."""
    return readers.lexicon_entries(spark, _lexicon_lines(spark, sf_dir)).select("e_strong", "d_strong", "u_strong", "lemma", "gloss", "meaning")


@C.plan(f"{_LEX}, a AS (SELECT DISTINCT unnest([e_strong, d_strong, u_strong]) AS alias, k FROM e) SELECT alias, CAST(count(*) AS INTEGER) AS n_entries, min(k) AS first_lemma FROM a GROUP BY alias")
def lexicon_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and the entries they lead to, in the order of the file."""
    i = readers.alias_index(readers.lexicon_entries(spark, _lexicon_lines(spark, sf_dir)))
    return i.select("alias", F.size("entries").alias("n_entries"), F.col("entries")[0]["lemma"].alias("first_lemma"))


@C.plan("SELECT source_id AS file, block_id AS record_no, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM (SELECT DISTINCT block_id, source_id, text FROM text_blocks WHERE kind = 'heading' AND text IS NOT NULL)")
def read_record_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings as records marked by ``$``, one text a source, and read back with all their lines."""
    b = once(load(spark, sf_dir, "text_blocks").where("kind = 'heading' and text is not null"), "loaded_at", "block_id", "source_id", "text")
    body = F.concat(F.lit("$"), F.col("block_id").cast("string"), F.lit("\n"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(". "), x)), "\n"), F.lit("\n"))
    texts = b.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(body)), "").alias("value")).select(F.col("source_id").alias("file"), F.concat(F.lit("head\n"), "value").alias("value"))
    return readers.record_blocks(spark, texts).select("file", F.col("code").cast("long").alias("record_no"), F.size("lines").alias("n_lines"))


def _locus() -> Column:
    return F.concat(F.regexp_replace("book_id", "^([0-9])", "n$1"), F.lit("."), F.col("chapter"), F.lit("."), F.col("verse"), F.lit("#"), F.lpad(F.col("position").cast("string"), 2, "0"))


_BOOK = "regexp_replace(book_id, '^([0-9])', 'n\\1')"


@C.plan(f"WITH {TOK} SELECT {_BOOK} AS book, chapter, CAST(verse AS INTEGER) AS verse, position AS source_position, id AS surface, transliteration, 'G' || lpad(CAST(position AS VARCHAR), 4, '0') AS strong, 'N-NSM' AS morphology_code, id AS lemma FROM tok WHERE right(witness, 1) IN ('1', '2')")
def read_tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as tagged lines with their editions; those of one edition are read."""
    t = tokens(spark, sf_dir)
    edition = F.when(F.right("witness", F.lit(1)).isin("1", "2"), "NA28+SBL").otherwise("TR+Byz")
    line = F.concat_ws("\t", F.concat(_locus(), F.lit("=NKO")), F.concat(F.col("id"), F.lit(" ("), F.coalesce("transliteration", F.lit("\x01")), F.lit(")")), F.lit("[the] <word>"), F.concat(F.lit("G"), F.lpad(F.col("position").cast("string"), 4, "0"), F.lit("=N-NSM")), F.concat(F.col("id"), F.lit("=word")), edition)
    d = readers.tagged_tokens(spark, t.select(line.alias("value")), "SBL")
    return d.select("book", "chapter", "verse", "source_position", "surface", F.nullif("transliteration", F.lit("\x01")).alias("transliteration"), "strong", "morphology_code", "lemma")


@C.plan(f"WITH {TOK} SELECT {_BOOK} AS book, chapter, CAST(verse AS INTEGER) AS verse, position AS source_position, id AS surface, 'H' || lpad(CAST(position AS VARCHAR), 4, '0') AS root_strong, CAST(2 AS INTEGER) AS n_tags, 'the / word of' AS contextual_gloss FROM tok WHERE right(witness, 1) IN ('1', '3', '5', '7')")
def read_rooted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as lines with text types and roots in braces; only four types are read."""
    t = tokens(spark, sf_dir)
    kind = F.element_at(F.create_map(*[x for k, v in {"1": "L", "3": "Q(k)", "5": "R", "7": "X"}.items() for x in (F.lit(k), F.lit(v))]), F.right("witness", F.lit(1)))
    kind = F.regexp_replace(F.coalesce(kind, F.lit("K")), r"\W", "")
    no = F.lpad(F.col("position").cast("string"), 4, "0")
    line = F.concat_ws("\t", F.concat(_locus(), F.lit("="), kind), "id", F.lit("t"), F.lit("¶<the>/[word] of"), F.concat(F.lit("H9001/{H"), no, F.lit("}/H9001")), F.lit("HR/Ncfsa"))
    return readers.rooted_tokens(spark, t.select(line.alias("value"))).select("book", "chapter", "verse", "source_position", "surface", "root_strong", F.size("strong_tags").alias("n_tags"), "contextual_gloss")


@C.plan(f"""
    WITH {TOK} SELECT {_BOOK} || ':' || chapter || ':' || verse AS reference, position, id AS surface, CASE WHEN transliteration IS NULL THEN 'empty field' WHEN count(*) OVER (PARTITION BY book_id, chapter, verse, position) > 1 THEN 'repeated place' END AS problem, 'N,V' AS parts, CASE WHEN transliteration IS NULL THEN '' ELSE 'x,y' END AS forms, 'alt' AS alternative_strongs FROM tok WHERE book_id = 'john'""")
def read_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as lines of thirteen columns, of which the verses of one book are wanted."""
    t = tokens(spark, sf_dir)
    line = F.concat_ws("\t", F.concat(_locus(), F.lit("=N")), F.concat(F.col("id"), F.lit(" (t)")), F.lit("word"), F.lit("G0001=N-NSM + G0002=V-AAI + G0003=N-GSM"), F.when(F.col("transliteration").isNull(), " ").otherwise(F.lit("x=one + y=two + x=three")), F.lit("NA28"), F.lit("m"), F.lit("s"), F.lit(""), F.lit(""), F.lit(""), F.lit("i"), F.lit("alt"))
    wanted = t.where("book_id = 'john'").select(F.concat_ws(":", F.regexp_replace("book_id", "^([0-9])", "n$1"), "chapter", "verse").alias("reference"))
    d = readers.supplement_tokens(spark, t.select(line.alias("value")), wanted)
    return d.select("reference", "position", "surface", "problem", F.array_join("parts_of_speech", ",").alias("parts"), F.array_join("dictionary_forms", ",").alias("forms"), "alternative_strongs")


def _documents_of(spark: SparkSession, sf_dir: str, verse, chapter, book) -> DataFrame:
    """One text a witness and book, put together from its chapters and verses in order; a book is a bounded group."""
    v = verse_texts(spark, sf_dir).withColumn("n", F.col("verse").cast("int")).where("n is not null")
    ch = v.groupBy("witness", "book_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("n", verse.alias("x")))).alias("vs")).select("witness", "book_id", "chapter", chapter(F.array_join("vs.x", "")).alias("x"))
    return ch.groupBy("witness", "book_id").agg(F.array_sort(F.collect_list(F.struct("chapter", "x"))).alias("cs")).select("witness", "book_id", book(F.array_join("cs.x", "")).alias("value"))


_SURFACES = f"WITH {_VERSES}"
_XML = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
#: White space as the readers of markup collapse it.
_ONE = "trim(regexp_replace(text, '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{001C}-\\x{001F}]+', ' ', 'g'))"


@C.plan(f"{_SURFACES} SELECT book_id AS book, chapter, verse, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(trim(replace(text, '~', ' '), ' '))) AS BIGINT) AS chars FROM v GROUP BY ALL")
def read_usfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as marked-up text with notes and continuation lines, read back by carrying the marks forward."""
    d = _documents_of(spark, sf_dir, F.concat(F.lit("\\v "), F.col("verse"), F.lit(" "), F.col("text"), F.lit("\\f + \\ft a note\\f*\n")), lambda x: F.concat(F.lit("\\c "), F.col("chapter"), F.lit("\n\\p\n"), x), lambda x: F.concat(F.lit("\\id "), F.col("book_id"), F.lit("\n"), x))
    return readers.usfm(d).groupBy("book", "chapter", "verse").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _file(d: DataFrame) -> DataFrame:
    return d.select(F.concat_ws("/", "witness", "book_id").alias("path"), F.encode("value", "UTF-8").alias("content"))


@C.plan(f"{_SURFACES} SELECT witness || '/' || book_id AS source, CAST(chapter AS VARCHAR) AS chapter, verse, {_ONE} AS text FROM v")
def read_usfx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as milestones among running text, with a note left out."""
    d = _documents_of(spark, sf_dir, F.concat(F.lit('<v id="'), F.col("verse"), F.lit('"/>'), _XML(F.col("text")), F.lit("<f>note</f><ve/>")), lambda x: F.concat(F.lit('<c id="'), F.col("chapter"), F.lit('"/>'), x), lambda x: F.concat(F.lit("<usfx><book>"), x, F.lit("</book></usfx>")))
    return readers.usfx(_file(d))


@C.plan(f"WITH {TOK} SELECT witness || '/' || book_id AS source, book_id || '.' || chapter || '.' || verse AS ref, CAST(row_number() OVER (PARTITION BY witness, book_id, chapter, verse ORDER BY position, id) AS INTEGER) AS position, id AS surface, transliteration AS lemma FROM tok")
def read_osis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as words of verse elements, beside words in notes that are another reading."""
    t = tokens(spark, sf_dir)
    word = F.concat(F.lit("<w"), F.coalesce(F.concat(F.lit(' lemma="'), _XML(F.col("transliteration")), F.lit('"')), F.lit("")), F.lit(">"), F.col("id"), F.lit("</w><note><w>other</w></note>"))
    v = t.groupBy(*_V).agg(F.array_sort(F.collect_list(F.struct("position", "id", word.alias("x")))).alias("ws"))
    v = v.select(*_V, F.concat(F.lit('<verse osisID="'), F.concat_ws(".", "book_id", "chapter", "verse"), F.lit('">'), F.array_join("ws.x", ""), F.lit("</verse>")).alias("x"))
    d = v.groupBy("witness", "book_id").agg(F.concat(F.lit("<osis>"), F.array_join(F.collect_list("x"), ""), F.lit("</osis>")).alias("value"))
    return readers.osis(_file(d)).select("source", "ref", "position", "surface", "lemma")


@C.plan(f"{_SURFACES} SELECT witness || '/' || book_id AS source, CAST(chapter AS VARCHAR) AS chapter, verse, {_ONE} AS text FROM v")
def read_tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as divisions of chapters and verses; notes are left out, what follows them is kept."""
    d = _documents_of(spark, sf_dir, F.concat(F.lit('<div subtype="verse" n="'), F.col("verse"), F.lit('"><note>x</note>'), _XML(F.col("text")), F.lit("</div>")), lambda x: F.concat(F.lit('<div subtype="chapter" n="'), F.col("chapter"), F.lit('">'), x, F.lit("</div>")), lambda x: F.concat(F.lit("<TEI>"), x, F.lit("</TEI>")))
    return readers.tei(_file(d))


@C.plan("""
    WITH d AS (SELECT DISTINCT block_id, source_id, section_index, block_index, kind, text FROM text_blocks),
    x AS (SELECT *, CASE WHEN kind = 'heading' THEN 'identity' WHEN block_index = 0 THEN 'locus' WHEN coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY section_index, block_index ORDER BY source_id, block_id) > 1 THEN 'repeated' END AS problem FROM d)
    SELECT coalesce(problem, 'sound') AS problem, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN problem = 'repeated' OR problem IS NULL THEN NULL ELSE problem END AS problem FROM x) GROUP BY 1""")
def read_identified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as JSON lines: whose source is another, whose place is none, and which are empty (S19). Places that come again count as sound here, as which of them is first depends on the file."""
    b = once(load(spark, sf_dir, "text_blocks"), "loaded_at", "block_id", "source_id", "section_index", "block_index", "kind", "text")
    locus = F.when(F.col("block_index") == 0, F.col("section_index").cast("string")).otherwise(F.concat_ws(".", "section_index", "block_index"))
    line = F.to_json(F.struct(F.lit("u").alias("urn"), F.when(F.col("kind") == "heading", "other").otherwise("scan").alias("source"), locus.alias("locus"), "text"))
    d = readers.identified_jsonl(spark, b.select(F.col("source_id").alias("file"), F.col("block_id").alias("line_no"), line.alias("value")), {"urn": "u", "source": "scan"})
    return d.groupBy(F.when(F.col("problem") == "repeated", "sound").otherwise(F.coalesce("problem", F.lit("sound"))).alias("problem")).agg(F.count("*").alias("n"))


@C.plan(f"WITH {TOK} SELECT witness || '.json' AS member, book_id || '.' || chapter || '.' || verse AS ref, CAST(row_number() OVER (PARTITION BY witness, book_id, chapter, verse ORDER BY position, id) AS INTEGER) AS position, id AS surface, CASE WHEN transliteration IS NULL THEN 'empty field' END AS problem FROM tok")
def read_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses as JSON arrays in archives, their members read and their words checked."""
    t = tokens(spark, sf_dir)
    word = F.struct(F.col("id").alias("surface"), F.coalesce("transliteration", F.lit("")).alias("lemma"), F.lit("N").alias("pos"), F.lit("s").alias("source"), F.lit("r").alias("reasoning"))
    v = t.groupBy(*_V).agg(F.array_sort(F.collect_list(F.struct("position", "id", word.alias("w")))).alias("ws")).select("witness", F.concat_ws(".", "book_id", "chapter", "verse").alias("ref"), F.col("ws.w").alias("words"))
    j = v.groupBy("witness").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ref", "words")))).alias("text"))
    d = readers.component_tokens(readers.archive_members(j.mapInPandas(_tarred, "path string, content binary")))
    return d.select("member", "ref", "position", "surface", "problem")


def _tarred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for w, text in zip(b["witness"], b["text"]):
            raw, data = io.BytesIO(), text.encode()
            with tarfile.open(fileobj=raw, mode="w:gz") as t:
                i = tarfile.TarInfo(f"{w}.json")
                i.size = len(data)
                t.addfile(i, io.BytesIO(data))
            out.append((f"{w}.tar.gz", raw.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for k, text in zip(b["doc_id"], b["text"]):
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                z.writestr("d/readme.txt", text)
                z.writestr("d/image.png", "x")
            out.append((str(k), raw.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@C.plan("SELECT CAST(doc_id AS VARCHAR) AS archive, 'd/readme.txt' AS member, CAST(strlen(text) AS BIGINT) AS size, CAST(least(12, length(text) - length(replace(text, chr(10), '')) + 1) AS INTEGER) AS n_preview FROM documents WHERE text IS NOT NULL")
def read_archive_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in an archive of its own: members of interest, their sizes and first lines."""
    z = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").mapInPandas(_zipped, "path string, content binary")
    return readers.archive_previews(readers.archive_members(z)).select("archive", "member", "size", F.size("preview").alias("n_preview"))


@C.plan(f"WITH {TOK} SELECT book_id, chapter, CAST(count(*) AS BIGINT) AS n FROM tok WHERE book_id = 'luke' GROUP BY ALL")
def read_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens written as a layer in folders by book, and one book read back from its own folder."""
    root = forgotten(spark, f"{checkpoint_dir(spark).rstrip('/')}/layers")
    writers.by_book(tokens(spark, sf_dir).select("book_id", "chapter", "id"), root, "surface")
    return readers.layer(spark, root, "surface", "luke").groupBy("book_id", "chapter").agg(F.count("*").alias("n"))


@C.plan("SELECT 'status' AS field, status AS found, CAST(count(*) AS BIGINT) AS n FROM cms_publications WHERE status <> 'published' GROUP BY status UNION ALL SELECT 'kind', kind, CAST(count(*) AS BIGINT) FROM cms_publications WHERE kind <> 'post' GROUP BY kind")
def read_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that must have one value, and the others that are found in them."""
    return readers.identity_violations(load(spark, sf_dir, "cms_publications"), status="published", kind="post")


@C.plan(f"WITH {_VERSES} SELECT book_id, chapter, verse, CAST(sum(length(text)) AS BIGINT) AS chars FROM v GROUP BY book_id, chapter, verse")
def read_json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as nested JSON documents, flattened to verses."""
    v = verse_texts(spark, sf_dir)
    ch = v.groupBy("witness", "book_id", F.col("chapter").cast("string").alias("chapter")).agg(F.map_from_entries(F.collect_list(F.struct("verse", "text"))).alias("vs"))
    b = ch.groupBy("witness", "book_id").agg(F.to_json(F.struct(F.col("book_id").alias("id"), F.map_from_entries(F.collect_list(F.struct("chapter", "vs"))).alias("chapters"))).alias("doc"))
    books = b.select(F.from_json("doc", "id string, chapters map<string,map<string,string>>").alias("d")).select("d.*")
    return readers.corpus_verses(books).groupBy("book_id", "chapter", "verse").agg(F.sum(F.length("text")).alias("chars"))


@C.plan("SELECT source_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(name)) AS BIGINT) AS chars FROM (SELECT DISTINCT block_id, source_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS name FROM text_blocks WHERE kind = 'heading' AND text IS NOT NULL) GROUP BY source_id")
def read_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings as a directory page, one a source, read back as records of id, name and feast."""
    b = once(load(spark, sf_dir, "text_blocks").where("kind = 'heading' and text is not null"), "loaded_at", "block_id", "source_id", "text")
    item = F.concat(F.lit('<article class="card saint-item" id="'), F.col("block_id"), F.lit('"><h3>'), _XML(F.col("text")), F.lit('</h3><span class="badge">Feast: March 3</span></article>'))
    page = b.groupBy("source_id").agg(F.concat(F.lit("<nav><h3>no</h3></nav>"), F.array_join(F.collect_list(item), "")).alias("html"))
    return pages.directory(page, "source_id", "html").where("feast = 'Feast: March 3'").groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("chars"))


_PARAS = "FROM (SELECT DISTINCT ON (id) id, body_en FROM cms_publications WHERE body_en LIKE '%<p>%'), (SELECT unnest(range(1, 2000)) AS k) WHERE k <= len(regexp_extract_all(body_en, '<p>'))"


@C.plan(f"SELECT id, CAST(k AS INTEGER) AS nth, 'main > p:nth-of-type(' || k || ')' AS selector, id % 2 = 0 AND k = 1 AS overridden {_PARAS}")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editable fields of the pages with markup: selector, place among its like, and whether an override replaces it."""
    p = once(load(spark, sf_dir, "cms_publications").where("body_en like '%<p>%'"), "ingested_at", "id", "body_en")
    found = pages.elements(p.select("id", F.concat(F.lit("<nav><p>menu</p></nav><main>"), "body_en", F.lit("</main>")).alias("html")), "id", "html")
    over = p.where("id % 2 = 0").select("id", F.lit("main > p:nth-of-type(1)").alias("selector"), F.lit("html").alias("field"), F.lit("new").alias("value"))
    return pages.with_overrides(pages.fields(found, "id"), over, "id").where("tag = 'p'").select("id", "nth", "selector", "overridden")


@C.plan("SELECT '20' || lpad(CAST(CASE WHEN month(d) = 2 AND day(d) = 29 THEN 28 ELSE 26 END AS VARCHAR), 2, '0') || strftime(d, '%m%d') AS starts, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey, o_orderdate AS d FROM orders) GROUP BY 1")
def calendar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as yearly calendar entries, those of 29 February from a leap year on."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("a; b, c "), "o_orderstatus").alias("title"))
    e = writers.calendar_events(o, "o_orderkey", "o_orderdate", "title")
    return e.select(F.regexp_extract("entry", "DTSTART;VALUE=DATE:([0-9]{8})", 1).alias("starts")).groupBy("starts").agg(F.count("*").alias("n"))


@C.plan("SELECT id, CASE WHEN language_mode IS NULL THEN CAST(2 AS INTEGER) ELSE CAST(3 AS INTEGER) END AS n_fields FROM (SELECT DISTINCT ON (id) * FROM cms_publications)")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications as JSON text; fields without a value are left out."""
    p = once(load(spark, sf_dir, "cms_publications"), "ingested_at", "id", "slug", "language_mode")
    j = writers.as_json(p)
    return j.select(F.get_json_object("json", "$.id").cast("long").alias("id"), F.size(F.json_object_keys("json")).alias("n_fields"))


@C.plan("SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT regexp_replace(x, '[^\\x{0590}-\\x{05FF}]', '', 'g') AS word FROM (SELECT 'א' || CAST(n_regionkey AS VARCHAR) || 'ב' || n_name AS x FROM nation)) GROUP BY word")
def hebrew_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hebrew letters alone, without points."""
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("אָ"), F.col("n_regionkey").cast("string"), F.lit("בּ"), "n_name").alias("x"))
    return n.select(fold_hebrew_udf("x").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


QUERIES, SQL = C.queries, C.sql
