"""Versification: canonical verses brought to the numbering of a source through mapping segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(segments: DataFrame) -> DataFrame:
    """``segment, canonical_verse, source_verse, status`` from ``segment, relationship, canonical[], source[]``.

    identity, renumber and offset pair by place; merge gives one canonical verse several source verses; split repeats
    the source verse for several canonical verses; range pairs by place if both sides have as many; a canonical-only
    verse has no source. Anything else is ambiguous. Null or empty arrays count as no verses.
    """
    s = segments.withColumn("c", F.coalesce("canonical", F.array().cast("array<string>"))).withColumn("s", F.coalesce("source", F.array().cast("array<string>")))
    by_place = F.col("relationship").isin("identity", "renumber", "offset", "range", "component-range") & (F.size("c") == F.size("s"))
    pairs = (
        F.when(by_place, F.transform(F.arrays_zip("c", "s"), lambda z: F.struct(z["c"].alias("c"), z["s"].alias("s"), F.lit("ok").alias("st"))))
        .when((F.col("relationship") == "merge") & (F.size("c") == 1), F.transform("s", lambda x: F.struct(F.col("c")[0].alias("c"), x.alias("s"), F.lit("ok").alias("st"))))
        .when((F.col("relationship") == "split") & (F.size("s") == 1), F.transform("c", lambda x: F.struct(x.alias("c"), F.col("s")[0].alias("s"), F.lit("ok").alias("st"))))
        .when((F.col("relationship") == "canonical-only") & (F.size("s") == 0), F.transform("c", lambda x: F.struct(x.alias("c"), F.lit(None).cast("string").alias("s"), F.lit("canonical-only").alias("st"))))
        .otherwise(F.transform("c", lambda x: F.struct(x.alias("c"), F.lit(None).cast("string").alias("s"), F.lit("ambiguous").alias("st"))))
    )
    return s.select("segment", F.explode(pairs).alias("p")).select("segment", F.col("p.c").alias("canonical_verse"), F.col("p.s").alias("source_verse"), F.col("p.st").alias("status"))


def violations(segments: DataFrame) -> DataFrame:
    """``rule, segment, detail``: segments that break their relationship, and verses used twice where that is not allowed."""
    sized = segments.withColumn("nc", F.size(F.coalesce("canonical", F.array()))).withColumn("ns", F.size(F.coalesce("source", F.array())))
    rule = (
        F.when(F.col("relationship").isin("identity", "renumber", "offset") & (F.col("nc") != F.col("ns")), "unequal sides")
        .when((F.col("relationship") == "merge") & ((F.col("nc") != 1) | (F.col("ns") < 2)), "merge is one to many")
        .when((F.col("relationship") == "split") & ((F.col("ns") != 1) | (F.col("nc") < 2)), "split is many to one")
        .when((F.col("relationship") == "canonical-only") & (F.col("ns") > 0), "canonical-only has a source")
        .when(~F.col("relationship").isin("identity", "renumber", "offset", "merge", "split", "range", "component-range", "canonical-only"), "unknown relationship")
    )
    shape = sized.withColumn("rule", rule).where("rule is not null").select("rule", "segment", F.concat_ws(":", "nc", "ns").alias("detail"))
    used = segments.where(~F.col("relationship").isin("split", "merge", "range", "component-range")).select("segment", F.explode("source").alias("v"))
    twice = used.groupBy("v").agg(F.count("*").alias("n"), F.min("segment").alias("segment")).where("n > 1").select(F.lit("verse used twice").alias("rule"), "segment", F.col("v").alias("detail"))
    return shape.unionByName(twice)
