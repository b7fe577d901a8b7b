"""Resolving typed references against a dimension of books with aliases, and verse lookup with bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import leading_int, reference_form

#: Fixed value: what may follow the name of a book.
PLACE = r"^(\d+)(?::(\d+)(?:-(\d+))?)?$"
#: At most so many verses beyond the first in one range.
MAX_SPAN = 100


def parse_references(refs: DataFrame, ref: str, aliases: DataFrame) -> DataFrame:
    """Adds ``book_id, chapter, verse_from, verse_to, status`` to ``refs``.

    ``aliases`` has ``alias`` (in reference form) and ``book_id``; of the aliases that start a reference the longest
    wins and is final: what follows it must be ``chapter[:verse[-verse]]``. The status tells why a reference does not
    resolve: ``unknown``, ``chapter required``, ``malformed``, ``zero``, ``inverted``, ``too long``. Null references
    are ``unknown``. The aliases are the small side; the join is a broadcast only if Spark finds it small.
    """
    r = refs.withColumn("_f", F.coalesce(reference_form(F.col(ref)), F.lit("")))
    forms = r.select("_f").distinct()
    # equi-join on the first word of the alias, then the prefix test
    a = aliases.select(F.col("alias").alias("_a"), F.col("book_id").alias("_b"), F.split("alias", " ")[0].alias("_w"))
    hit = forms.withColumn("_w", F.split("_f", " ")[0]).join(a, "_w").where((F.col("_f") == F.col("_a")) | F.col("_f").startswith(F.concat("_a", F.lit(" "))))
    best = hit.groupBy("_f").agg(F.max(F.struct(F.length("_a").alias("l"), "_b", "_a")).alias("m")).select("_f", F.col("m._b").alias("book_id"), F.col("m._a").alias("_a"))
    x = r.join(best, "_f", "left").withColumn("_rest", F.trim(F.expr("substring(_f, length(_a) + 1)")))
    part = lambda k: F.regexp_extract("_rest", PLACE, k).try_cast("int")
    x = x.withColumn("chapter", part(1)).withColumn("verse_from", part(2)).withColumn("verse_to", F.coalesce(part(3), part(2)))
    bad = (F.col("chapter") == 0) | (F.coalesce("verse_from", F.lit(1)) == 0) | (F.coalesce("verse_to", F.lit(1)) == 0)
    status = (
        F.when(F.col("book_id").isNull(), "unknown").when(F.col("_rest") == "", "chapter required").when(~F.col("_rest").rlike(PLACE), "malformed").when(bad, "zero")
        .when(F.col("verse_to") < F.col("verse_from"), "inverted").when(F.col("verse_to") - F.col("verse_from") > MAX_SPAN, "too long").otherwise("ok")
    )
    return x.withColumn("status", status).drop("_f", "_a", "_rest")


def verse_bounds(verse: Column) -> tuple[Column, Column]:
    """First and last verse of a label: ``7`` is 7 to 7, a bridge ``3-4`` or ``3,4`` is 3 to 4."""
    lo = F.regexp_extract(verse, r"^(\d+)", 1).try_cast("int")
    return lo, F.coalesce(F.regexp_extract(verse, r"^\d+\s*[-,]\s*(\d+)$", 1).try_cast("int"), lo)


def expand_bridges(verses: DataFrame, verse: str = "verse") -> DataFrame:
    """One row per number that a verse label covers (``verse_no``), so that lookups are equi-joins; exact labels come first (``bridge`` false)."""
    lo, hi = verse_bounds(F.col(verse))
    return verses.withColumn("verse_no", F.explode(F.sequence(lo, F.greatest(lo, hi)))).withColumn("bridge", hi > lo)


def lookup(wanted: DataFrame, verses: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (keys and ``verse_no``) with the row of ``verses`` that covers each number: an exact label before a bridge. Missing numbers keep nulls."""
    e = expand_bridges(verses)
    rest = [c for c in e.columns if c not in (*keys, "verse_no")]
    one = e.groupBy(*keys, "verse_no").agg(F.min(F.struct("bridge", *[c for c in rest if c != "bridge"])).alias("_v"))
    return wanted.join(one, [*keys, "verse_no"], "left").select(*wanted.columns, *[F.col(f"_v.{c}").alias(c) for c in rest])


def render(verses: DataFrame, keys: list[str], verse: str = "verse", text: str = "text") -> DataFrame:
    """One passage per key: a single verse bare, several as ``n text n text`` in canon order."""
    item = F.struct(leading_int(F.col(verse)).alias("o"), F.col(verse).alias("v"), F.col(text).alias("t"))
    g = verses.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return g.select(*keys, F.size("x").alias("n_verses"), F.when(F.size("x") == 1, F.col("x")[0]["t"]).otherwise(F.array_join(F.transform("x", lambda r: F.concat(r["v"], F.lit(" "), r["t"])), " ")).alias("passage"))
