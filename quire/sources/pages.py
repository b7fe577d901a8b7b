"""HTML pages: directories of records, and the elements of a page with selectors for editing."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements without an end tag, and controls whose content is not for editing.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LOCKED = frozenset("script style form input select textarea button iframe svg".split())


class _Directory(HTMLParser):
    """Records: an element of a class holds a heading and a badge."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.now: dict | None = None
        self.into = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "article" and "saint-item" in classes:
            self.now = {"id": a.get("id") or "", "name": "", "feast": ""}
        elif self.now is not None and (tag == "h3" or tag == "span" and "badge" in classes):
            self.into = "name" if tag == "h3" else "feast"

    def handle_data(self, data):
        if self.now is not None and self.into:
            self.now[self.into] += data

    def handle_endtag(self, tag):
        if tag in ("h3", "span"):
            self.into = ""
        elif tag == "article" and self.now is not None:
            self.rows.append(self.now)
            self.now = None


def directory(df: DataFrame, key: str, markup: str) -> DataFrame:
    """``key, id, name, feast`` of each record of a directory page; white space in names is collapsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b[key], b[markup]):
                p = _Directory()
                p.feed(h or "")
                out += [(k, r["id"], " ".join(r["name"].split()), " ".join(r["feast"].split())) for r in p.rows]
            yield pd.DataFrame(out, columns=[key, "id", "name", "feast"])

    return df.select(key, markup).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, id string, name string, feast string")


class _Elements(HTMLParser):
    """Elements within ``main``: number, parent, tag, text, and what stands in href, src and alt."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list] = []
        self.open: list[tuple[str, int]] = []  # tag and number of the open elements; number 0 is main, -1 is outside it
        self.held: list[int] = []

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1][1] if self.open else -1
        if tag == "main":
            at = 0
        elif parent >= 0:
            a = dict(attrs)
            at = len(self.rows) + 1
            locked = tag in LOCKED or any(k.startswith("data-") for k in a) or parent > 0 and self.rows[parent - 1][4]
            self.rows.append([at, parent, tag, "", locked, a.get("href"), a.get("src"), a.get("alt")])
        else:
            at = -1
        if tag not in VOID:
            self.open.append((tag, at))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        for _, at in self.open:
            if at > 0:
                self.rows[at - 1][3] += data

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass


_ELEMENTS = "node int, parent int, tag string, text string, locked boolean, href string, src string, alt string"


def elements(df: DataFrame, key: str, markup: str) -> DataFrame:
    """``key, node, parent, tag, text, locked, href, src, alt, nth, selector`` of the elements within ``main``.

    ``nth`` is the place among the children of a parent that have the same tag; a selector names the path from main.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b[key], b[markup]):
                p = _Elements()
                p.feed(h or "")
                like: dict[tuple[int, str], int] = {}
                path: dict[int, str] = {0: "main"}
                for node, parent, tag, text, *rest in p.rows:
                    nth = like[parent, tag] = like.get((parent, tag), 0) + 1
                    path[node] = f"{path[parent]} > {tag}:nth-of-type({nth})"
                    out.append((k, node, parent, tag, " ".join(text.split()), *rest, nth, path[node]))
            yield pd.DataFrame(out, columns=[key, "node", "parent", "tag", "text", "locked", "href", "src", "alt", "nth", "selector"]).astype({"node": "int32", "parent": "int32", "nth": "int32"})

    return df.select(key, markup).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {_ELEMENTS}, nth int, selector string")


def nth_of_type(nodes: DataFrame, key: str) -> Column:
    """The place of an element among its siblings of the same tag, as a window."""
    return F.row_number().over(Window.partitionBy(key, "parent", "tag").orderBy("node"))


def fields(found: DataFrame, key: str) -> DataFrame:
    """``key, kind, tag, nth, selector, field, value``: one row for each field that may be edited."""
    e = found.where(~F.col("locked"))
    pick = F.when(F.col("tag") == "img", F.array(F.struct(F.lit("src").alias("field"), F.col("src").alias("value")), F.struct(F.lit("alt").alias("field"), F.col("alt").alias("value")))).when((F.col("tag") == "a") & F.col("href").isNotNull(), F.array(F.struct(F.lit("html").alias("field"), F.col("text").alias("value")), F.struct(F.lit("href").alias("field"), F.col("href").alias("value")))).when(F.col("text") != "", F.array(F.struct(F.lit("html").alias("field"), F.col("text").alias("value"))))
    kind = F.when(F.col("tag") == "img", "image").when((F.col("tag") == "a") & F.col("href").isNotNull(), "link").otherwise("text")
    return e.select(key, kind.alias("kind"), "tag", "nth", "selector", F.explode(pick).alias("p")).select(key, "kind", "tag", "nth", "selector", "p.field", "p.value")


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Fields with their override's value, where there is one, and ``overridden``."""
    o = overrides.select(key, "selector", "field", F.col("value").alias("_new"), F.lit(True).alias("_is"))
    return rows.join(o, [key, "selector", "field"], "left").withColumn("value", F.coalesce("_new", "value")).withColumn("overridden", F.coalesce("_is", F.lit(False))).drop("_new", "_is")
