"""Passages, lexicon lookups, chains, coverage and pages on small fixtures, with gaps, bridges, nulls and repeated rows."""

import pytest
from pyspark.sql import functions as F

from quire.operators import lookups as L
from quire.sources import pages, readers


def test_passage_over_bridges_and_gaps(spark):
    v = spark.createDataFrame([("b", 1, "1", "a"), ("b", 1, "2-3", "bc"), ("b", 1, "5", "e")], "book string, chapter int, verse string, text string")
    w = spark.createDataFrame([("r1", "b", 1, 1, 3), ("r2", "b", 1, 3, 5), ("r3", "b", 1, 3, None), ("r4", "x", 1, 1, 1)], "ref string, book string, chapter int, verse_from int, verse_to int")
    got = {r["ref"]: (r["status"], None if r["verses"] is None else [x["verse"] for x in r["verses"]]) for r in L.passage(w, v, ["book", "chapter"]).collect()}
    assert got == {"r1": ("ok", ["1", "2-3"]), "r2": ("not found", None), "r3": ("ok", ["2-3"]), "r4": ("not found", None)}


def test_numbers_prefer_their_own_entry(spark):
    lines = spark.createDataFrame([("f", 1, "H0007\tH0007A\tx\tlemma1\tt\tN\tg1\tm"), ("f", 2, "H0007\tH0007\tx\tlemma2\tt\tN\tg2\tm"), ("f", 3, "bad\tline")], "file string, line_no int, value string")
    e = readers.lexicon_entries(spark, lines)
    assert e.count() == 2
    asked = spark.createDataFrame([("H7",), ("H0007",), ("H0007A",), ("H9",), (None,)], "n string")
    got = {r["n"]: (r["level"], r["entry"] and r["entry"]["lemma"]) for r in L.by_number(asked, "n", readers.alias_index(e)).collect()}
    assert got == {"H7": (1, "lemma1"), "H0007": (0, "lemma2"), "H0007A": (0, "lemma1"), "H9": (None, None), None: (None, None)}


def test_quotation_chain(spark):
    src = spark.createDataFrame([("s",)], "source_id string")
    toc = spark.createDataFrame([("s", 1)], "source_id string, section_index int")
    par = spark.createDataFrame([("s", 1, 0, "In the  beginning\nwas light."), ("s", 1, 1, None)], "source_id string, section_index int, paragraph_index int, text string")
    q = spark.createDataFrame([("ok", "s", 1, 0, "beginning was"), ("no", "s", 1, 0, "dark"), ("null", "s", 1, 1, "x"), ("far", "s", 1, 9, "x"), ("sec", "s", 2, 0, "x"), ("src", "t", 1, 0, "x")], "quote_id string, source_id string, section_index int, paragraph_index int, quote string")
    got = {r["quote_id"]: r["rule"] for r in L.quotation_violations(q, src, toc, par).collect()}
    assert got == {"no": "not a substring", "null": "not a substring", "far": "invalid paragraph", "sec": "missing section", "src": "unknown source"}


def test_layers(spark):
    s = spark.createDataFrame([("v1", 1, "a"), ("v1", 2, "b"), ("v2", 1, "c"), ("v3", 1, "d"), ("v4", 1, "e")], "v string, position int, id string")
    a = spark.createDataFrame([("v1", 1, "a"), ("v1", 2, "b"), ("v2", 1, "x"), ("v4", 1, "e")], "v string, position int, id string")
    gaps = spark.createDataFrame([("v4",)], "v string")
    assert {r["v"]: r["rule"] for r in L.layer_violations(s, a, gaps, ["v"]).collect()} == {"v2": "token ids differ", "v3": "not aligned", "v4": "gap carries tokens"}


def test_filters_are_optional(spark):
    d = spark.createDataFrame([(1, "a", True, "Big"), (2, "b", False, None), (3, None, True, "small")], "i int, k string, f boolean, t string")
    ids = lambda x: sorted(r["i"] for r in x.collect())
    assert ids(L.filtered(d, {"k": None, "f": None})) == [1, 2, 3] and ids(L.filtered(d, {"k": ["a", "b"], "f": [True]})) == [1]
    assert ids(L.filtered(d, None, "BIG", ("t", "k"))) == [1] and ids(L.filtered(d, any_of=(F.col("f"), F.col("k") == "b"))) == [1, 2, 3]


def test_pages(spark):
    html = '<nav><p>no</p></nav><main><p>one</p><div data-widget="x"><p>locked</p></div><p>two <b>bold</b></p><img src="i.png" alt="a"><a href="/x">go</a><br></main><p>after</p>'
    d = spark.createDataFrame([(1, html), (2, None), (3, "<main><p>unclosed")], "id int, h string")
    e = pages.elements(d, "id", "h")
    f = {(r["id"], r["selector"], r["field"]): r["value"] for r in pages.fields(e, "id").collect()}
    assert f == {
        (1, "main > p:nth-of-type(1)", "html"): "one", (1, "main > p:nth-of-type(2)", "html"): "two bold", (1, "main > p:nth-of-type(2) > b:nth-of-type(1)", "html"): "bold",
        (1, "main > img:nth-of-type(1)", "src"): "i.png", (1, "main > img:nth-of-type(1)", "alt"): "a", (1, "main > a:nth-of-type(1)", "html"): "go", (1, "main > a:nth-of-type(1)", "href"): "/x", (3, "main > p:nth-of-type(1)", "html"): "unclosed",
    }
    assert e.withColumn("again", pages.nth_of_type(e, "id")).where("again <> nth").count() == 0


def test_contained():
    assert readers.contained("/maps", "a/b.json") == "/maps/a/b.json"
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            readers.contained("/maps", bad)


def test_identified_lines(spark):
    lines = [('{"urn":"u","locus":"1.1","text":" a  b "}',), ('{"urn":"u","locus":"1.1","text":"again"}',), ('{"urn":"v","locus":"1.2","text":"x"}',), ("not json",), ('{"urn":"u","locus":"one","text":"x"}',), ('{"urn":"u","locus":"2.1","text":" "}',), ("",)]
    d = spark.createDataFrame([("f", i, x[0]) for i, x in enumerate(lines)], "file string, line_no int, value string")
    got = sorted((r["surface"], r["problem"]) for r in readers.identified_jsonl(spark, d, {"urn": "u"}).collect())
    assert sorted(x for _, x in got if x) == ["empty", "identity", "invalid", "locus", "repeated"] and ("a b", None) in got
