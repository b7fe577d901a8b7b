import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import greek
from quire.functions import text as t
from quire.operators.align import align_pair
from quire.operators.changes import insert_absent, numbered_slugs, upsert_latest
from quire.operators.references import lookup, parse_references, render
from quire.operators.versify import resolve, violations


def test_references(spark):
    al = spark.createDataFrame([("john", "john"), ("1 john", "1john"), ("song", "song"), ("song of songs", "song")], "alias string, book_id string")
    refs = spark.createDataFrame([("Song of Songs 2:3",), ("1 JOHN 4 : 7 – 9",), ("John",), ("John 3:9-4",), ("John 3:0",), (None,), ("Johnny 3",), ("Song x",), ("john 2",)], "ref string")
    got = {r["ref"]: (r["book_id"], r["chapter"], r["verse_from"], r["verse_to"], r["status"]) for r in parse_references(refs, "ref", al).collect()}
    assert got["Song of Songs 2:3"] == ("song", 2, 3, 3, "ok") and got["1 JOHN 4 : 7 – 9"] == ("1john", 4, 7, 9, "ok")
    assert got["John"][4] == "chapter required" and got["John 3:9-4"][4] == "inverted" and got["John 3:0"][4] == "zero"
    assert got[None][4] == "unknown" and got["Johnny 3"][4] == "unknown" and got["Song x"][4] == "malformed" and got["john 2"][:3] == ("john", 2, None)


def test_bridges(spark):
    v = spark.createDataFrame([("b", "3-4", "x"), ("b", "4", "y"), ("b", "7,8", "z"), ("b", "note", "n")], "book string, verse string, text string")
    w = spark.createDataFrame([("b", n) for n in (3, 4, 5, 8)], "book string, verse_no int")
    got = {r["verse_no"]: r["text"] for r in lookup(w, v, ["book"]).collect()}
    assert got == {3: "x", 4: "y", 5: None, 8: "z"}
    assert [r["passage"] for r in render(v.where("verse != 'note'"), ["book"]).collect()] == ["3-4 x 4 y 7,8 z"]
    assert render(v.limit(1), ["book"]).first()["passage"] == "x"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "", None]), max_size=7), st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=7))
def test_alignment(keys, base):
    m = align_pair(keys, base)
    hits = [j for j, _ in m if j >= 0]
    assert len(hits) == len(set(hits))
    assert all(keys[i] and keys[i] == base[j] for i, (j, _) in enumerate(m) if j >= 0)
    assert all(j == i for i, (j, how) in enumerate(m) if how == "place")
    in_order = [j for j, how in m if how == "order"]
    assert in_order == sorted(in_order)


def test_versification(spark):
    s = spark.createDataFrame([("m", "merge", ["5"], ["6", "7"]), ("s", "split", ["6", "7"], ["8"]), ("r", "range", ["1", "2"], ["3"]), ("c", "canonical-only", ["9"], None)], "segment string, relationship string, canonical array<string>, source array<string>")
    got = {(r["segment"], r["canonical_verse"], r["source_verse"], r["status"]) for r in resolve(s).collect()}
    assert ("m", "5", "7", "ok") in got and ("s", "7", "8", "ok") in got and ("r", "1", None, "ambiguous") in got and ("c", "9", None, "canonical-only") in got
    assert violations(s).count() == 0


def test_greek():
    assert greek.fold("Λόγος,") == greek.fold("λογοσ") and greek.fold(None) is None
    assert greek.transliterate("ὁ") == "ho" and greek.transliterate("Ῥόδη") == "Rhodē" and greek.transliterate("τοῦ") == "tou" and greek.transliterate("ἄγγελος") == "angelos"
    assert greek.fold_hebrew("בְּרֵאשִׁית") == "בראשית" and greek.align_key("⸀οὐδ’,") == "οὐδ"


def test_text_functions(spark):
    d = spark.createDataFrame([("  A  b\n", ""), (None, "x")], "a string, b string")
    got = d.select(t.collapse(F.col("a")).alias("c"), t.or_default(F.col("b"), F.lit("d")).alias("d"), t.slug(F.lit("Héllo, World!")).alias("s"), t.calendar_escape(F.lit("a,b;c\nd")).alias("e"), t.blob_sha1(F.lit("hi")).alias("h")).collect()
    assert [r["c"] for r in got] == ["A b", None] and [r["d"] for r in got] == ["d", "x"] and got[0]["s"] == "h-llo-world" and got[0]["e"] == r"a\,b\;c\nd"
    assert got[0]["h"] == hashlib.sha1(b"blob 2\0hi").hexdigest()


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "e", 3)], "k int, v string, at int")
    assert {(r["k"], r["v"]) for r in upsert_latest(old, new, ["k"], "at").collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert sorted(r["k"] for r in insert_absent(old, new, ["k"]).collect()) == [1, 2, 3]
    names = numbered_slugs(spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, "")], "k int, n string"), "k", F.col("n"))
    assert {r["k"]: r["slug"] for r in names.collect()} == {1: "a-b", 2: "a-b-2", 3: "section"}


def test_sanitised(spark):
    d = spark.createDataFrame([('<p onclick="x()">a<script>bad()</script><a href="javascript:x">b</a><br/>',), ("<img src=x onerror=y><b>c</b><!-- d -->",), (None,), ('<a class="x" href="https://a.example/?b=1" onclick="y">c</a><A HREF=\'/d#e\'>f</A><a href="JAVASCRIPT:g()">h</a><a href="data:x">i</a>',)], "h string")
    links = '<a href="https://a.example/?b=1">c</a><a href="/d#e">f</A><a>h</a><a>i</a>'
    assert [r[0] for r in d.select(t.sanitised(F.col("h"))).collect()] == ["<p>a<a>b</a><br>", "<b>c</b>", None, links]
