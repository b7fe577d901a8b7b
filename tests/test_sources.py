import io
import tarfile
import zipfile

import pytest

from quire.sources import readers as r
from quire.sources import writers as w


def test_line_formats(spark, tmp_path):
    p = tmp_path / "v.tsv"
    p.write_text("Mark 1:2\tin the beginning\n# no verse\nMark 1:3-4\tvoice\nMark 1:5\t \nMark 1:2\tagain\n")
    assert {(x["verse"], x["text"]) for x in r.verse_tsv(spark, str(p)).collect()} == {("2", "in the beginning"), ("3-4", "voice"), ("2", "again")}
    assert {x["reason"] for x in r.verse_tsv_rejects(spark, str(p)).collect()} == {"malformed", "repeated"}
    q = tmp_path / "pos.txt"
    q.write_text("010101 N- ----NSF- Βίβλος Βίβλος βίβλος βίβλος\n010101 N- ----GSF- γενέσεως γενέσεως γενέσεως γένεσις\nbad\n010102 N- ----NSM- Ἀβραὰμ Ἀβραὰμ Ἀβραάμ Ἀβραάμ\n")
    assert [(x["verse"], x["position"], x["lemma"]) for x in r.positional_records(spark, str(q)).orderBy("verse", "position").collect()] == [(1, 1, "βίβλος"), (1, 2, "γένεσις"), (2, 1, "Ἀβραάμ")]


def test_lexicon_and_blocks(spark, tmp_path):
    p = tmp_path / "lex.tsv"
    p.write_text("G0001\talpha\ta\tsecret\nnote\tx\ty\tz\nG12345A\tbeta\tb\tsecret\n")
    d = r.lexicon_tsv(spark, str(p), ("strong", "lemma", "gloss", "meaning"), drop=("meaning",))
    assert d.columns == ["strong", "lemma", "gloss"] and d.count() == 2
    q = tmp_path / "codes.txt"
    q.write_text("header\n$V-AAI\n first\n second\n$N-NSM\n only\n")
    assert {x["code"]: x["lines"] for x in r.record_blocks(spark, str(q)).collect()} == {"V-AAI": ["first", "second"], "N-NSM": ["only"]}
    t = tmp_path / "tag.txt"
    t.write_text("Mat.1.1#01=NKO\tΒίβλος (Biblos)\t[The] book\tG0976=N-NSF\tβίβλος=book\tNA28+SBL\nMat.1.1#02\tx (x)\ty\tG1\tz=w\tTR\n")
    got = r.tagged_tokens(spark, str(t), "SBL").collect()
    assert len(got) == 1 and got[0]["surface"] == "Βίβλος" and got[0]["transliteration"] == "Biblos" and got[0]["strong"] == "G0976" and got[0]["lemma"] == "βίβλος"


def test_usfm(spark):
    t = "\\id GEN\n\\c 1\n\\p\n\\v 1 In the beginning\\f + \\ft note\\f*\nGod made\n\\v 2-3 And~the earth\n\\c 2\n\\s Heading\n\\v 1 Thus\n"
    got = {(x["chapter"], x["verse"]): x["text"] for x in r.usfm(spark.createDataFrame([(t,)], "value string")).collect()}
    assert got == {(1, "1"): "In the beginning God made", (1, "2-3"): "And the earth", (2, "1"): "Thus"}


def test_markup(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<usfx><book id="GEN"><c id="1"/><p><v id="1"/>In <add>the</add> start<f>no</f>.<ve/><v id="2"/>Next<ve/></p></book></usfx>')
    assert [(x["verse"], x["text"]) for x in r.usfx(r.files(spark, str(tmp_path), "a.xml")).collect()] == [("1", "In the start."), ("2", "Next")]
    (tmp_path / "b.xml").write_text('<osis><verse osisID="Gen.1.1"><w lemma="b" morph="HR">ב</w><note><w>x</w></note><w lemma="r">ר</w></verse></osis>')
    assert [(x["position"], x["surface"]) for x in r.osis(r.files(spark, str(tmp_path), "b.xml")).collect()] == [(1, "ב"), (2, "ר")]
    (tmp_path / "c.xml").write_text('<TEI><div subtype="chapter" n="1"><div subtype="verse" n="1">a <note>zz</note>b</div></div></TEI>')
    assert r.tei(r.files(spark, str(tmp_path), "c.xml")).first()["text"] == "a b"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/readme.txt", "one\ntwo\n")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        i = tarfile.TarInfo("x.json")
        i.size = 2
        t.addfile(i, io.BytesIO(b"{}"))
    m = r.archive_members(r.files(spark, str(tmp_path)))
    assert {x["member"] for x in m.collect()} == {"d/readme.txt", "x.json"}
    assert r.archive_previews(m).where("member like '%readme%'").first()["preview"][:2] == ["one", "two"]


def test_html_and_sections(spark):
    d = spark.createDataFrame([(1, "<nav><p>menu</p></nav><h2>Head</h2><script>p()</script><p>One <b>two</b></p><p> </p>")], "id int, h string")
    assert [(x["kind"], x["text"]) for x in r.html_blocks(d, "id", "h").orderBy("block_no").collect()] == [("heading", "Head"), ("paragraph", "One two")]
    s = spark.createDataFrame([(1, "Preface text.\n\nCHAP. I\n\nFirst\nparagraph.\n\nSecond.\n\nII.\n\nThird.")], "id int, t string")
    got = [(x["section_no"], x["kind"], x["text"]) for x in r.sections(s, "id", "t").orderBy("n").collect()]
    assert got == [(0, "paragraph", "Preface text."), (1, "heading", "CHAP. I"), (1, "paragraph", "First paragraph."), (1, "paragraph", "Second."), (2, "heading", "II."), (2, "paragraph", "Third.")]


def test_json_and_layers(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"id": "gen",\n "chapters": {"1": {"1": "a", "2-3": "b"}}}')
    v = r.corpus_verses(r.json_documents(spark, str(tmp_path / "b.json"), "id string, chapters map<string,map<string,string>>"))
    assert {(x["chapter"], x["verse"], x["text"]) for x in v.collect()} == {(1, "1", "a"), (1, "2-3", "b")}
    w.by_book(v, str(tmp_path / "out"), "surface")
    got = r.layer(spark, str(tmp_path / "out"), "surface", "gen")
    assert got.count() == 2 and "PartitionFilters: [isnotnull(layer" in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        r.layer(spark, str(tmp_path / "out"), "../x")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert r.jsonl(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2


def test_sinks(spark):
    d = spark.createDataFrame([(1, "a & b", "2024-02-03")], "id int, t string, d string")
    assert w.sitemap_entries(d, "t", "d").first()[0] == "<url><loc>a &amp; b</loc><lastmod>2024-02-03</lastmod></url>"
    assert "DTSTART;VALUE=DATE:20260203" in w.calendar_events(d, "id", "d", "t").first()[0]
    assert w.markdown_rows(d, ["id", "t"]).first()[0] == "| 1 | a & b |"
    two = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert w.manifest(two, "x", ["id"]).first() == w.manifest(two.orderBy(two.id.desc()), "x", ["id"]).first()
    assert w.as_json(two).first()[0] == '{"id":1,"t":"a"}'
    with pytest.raises(AssertionError):
        w.fail_on_rows(two, "rows")
    w.fail_on_rows(two.limit(0), "no rows")


def test_manifest_of_every_table(spark, sf):
    import os

    from quire.plans.ingest import table_manifest

    got = {r["name"]: r for r in table_manifest(spark, sf).collect()}
    assert set(got) == {f.removesuffix(".parquet") for f in os.listdir(sf) if f.endswith(".parquet")}
    assert all(r["n_rows"] == spark.read.parquet(f"{sf}/{n}.parquet").count() and 0 < r["n_keys"] <= r["n_rows"] for n, r in got.items())
