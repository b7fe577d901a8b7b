"""Changes to tables as plans over whole tables: upsert, insert if absent, unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import slug
from quire.operators.ranges import numbered, running_sum


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of both by key, the latest ``at`` wins and, at the same time, the new row. One partial aggregate, no join."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct(at, "_o", *[c for c in rest if c != at])).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; repeated keys in ``new`` are added once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def numbered_slugs(df: DataFrame, key: str, name: Column, longest: int = 150) -> DataFrame:
    """Adds ``slug``, unique over the table.

    The first row (by ``key``) of a name gets it bare. The others, and those of names that agree in their first
    ``longest`` characters, get the lowest numbers from 2 on that no other name already spells: with the names ``a``,
    ``a`` and ``a 2`` the second row becomes ``a-3``. Rows are numbered by ranges, so a name may be that of any number.
    """
    d = numbered(df.withColumn("_base", slug(name, longest + 10)), ["_base"], [key], "_n")
    bare, again = d.where("_n = 1").withColumn("slug", F.col("_base")), d.where("_n > 1").withColumn("_stem", F.left("_base", F.lit(longest)))
    # numbers that bare names spell: one row for each name that ends in one
    spelt = F.regexp_extract("_base", "^(.+)-([1-9][0-9]{0,8})$", 2).try_cast("long")
    taken = bare.select(F.regexp_extract("_base", "^(.+)-([1-9][0-9]{0,8})$", 1).alias("_stem"), spelt.alias("_k")).where("_k >= 2").groupBy("_stem", "_k").agg(F.lit(1).alias("_t"))
    # the j-th number that is free is j + 1, and one more for each taken number with at most j free ones below it
    spans = taken.join(again.select("_stem").distinct(), "_stem", "left_semi")
    frees = numbered(spans, ["_stem"], ["_k"], "_i").select("_stem", (F.col("_k") - F.col("_i")).alias("_v"), F.lit(0).alias("_t"), F.col("_k").alias("_tie"), F.lit(None).alias("_row"))
    wanted = numbered(again, ["_stem"], ["_base", key], "_j")
    asked = wanted.select("_stem", F.col("_j").alias("_v"), F.lit(1).alias("_t"), F.col("_j").alias("_tie"), F.struct(*df.columns).alias("_row"))
    told = running_sum(asked.unionByName(frees.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))), ["_stem"], ["_v", "_t", "_tie"], (F.col("_t") == 0).cast("long"), "_skipped").where("_t = 1")
    named = told.select("_row.*", F.concat_ws("-", "_stem", F.col("_v") + 1 + F.col("_skipped")).alias("slug"))
    return bare.drop("_base", "_n").unionByName(named)


def duplicate_as_draft(df: DataFrame, key: str, copied: Column, suffix: str = " (Copy)", titles: tuple[str, ...] = ("title",), slugs: str = "slug", status: str = "status", off: tuple[str, ...] = ()) -> DataFrame:
    """Copies of the rows for which ``copied`` holds, as drafts: titles marked, slugs made free, flags off, no key."""
    c = df.where(copied).withColumn(status, F.lit("draft"))
    for t in titles:
        c = c.withColumn(t, F.when(F.coalesce(t, F.lit("")) != "", F.concat(t, F.lit(suffix))))
    for f in off:
        c = c.withColumn(f, F.lit(False))
    both = df.select(key, F.col(slugs).alias("_name"), F.lit(0).alias("_new")).unionByName(c.select(key, F.concat(slugs, F.lit("-copy")).alias("_name"), F.lit(1).alias("_new")))
    fresh = numbered_slugs(both.withColumn("_order", F.struct("_new", key)), "_order", F.col("_name")).where("_new = 1").select(key, F.col("slug").alias("_slug"))
    return c.join(fresh, key).withColumn(slugs, F.col("_slug")).drop("_slug").withColumnRenamed(key, "copy_of")


def soft_delete(df: DataFrame, gone: Column, status: str = "status", word: str = "archived") -> DataFrame:
    """Rows stay; those for which ``gone`` holds get the status ``word``."""
    return df.withColumn(status, F.when(gone, F.lit(word)).otherwise(F.col(status)))
