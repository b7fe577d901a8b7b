"""Problem 9: combine sources so that each has its target share of all tokens.

Method: hash-random keys, a range sort within each source, distributed prefix sums of token counts, and a cut at each
source's exact budget, with whole epochs before it where the budget exceeds the source.

Plan: one scan counts tokens (text stays behind); the narrow table (id, source, tokens, key) is written once to the
shared folder. Token totals per source (at most as many rows as ``mix_targets``) set the budgets. A source is cut into
ranges of its key by a number that follows its rows, so that a source of a third of all rows is as many tasks; the
prefix sum is a window within a range plus a window over the range totals.

Total: ``total_tokens`` where given; otherwise as many tokens as the sources with a target hold together, so that the
mixture is as large as the data: small sources are repeated up to their cap, large ones are cut. A source that its cap
keeps below its share is ``short``, one without text has ``no text``; the report gives the shares reached. With
``exact=True`` the total is the greatest at which no source that has text is short.

Defined results: documents of sources without a target, and null or empty texts, take no part; repeated rows of one
document count once; the text that a budget ends in is used up to the budget (``tokens_used``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tokens import VOCABULARY, encode, encoding
from quire.session import materialise

#: Rows of one range of a source.
RANGE_ROWS = 50_000


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document with text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            yield b[["doc_id", "source"]].assign(n_tokens=[len(encode(enc, t)) for t in b["text"]])

    return docs.select("doc_id", "source", "text").where(F.length("text") > 0).mapInPandas(run, "doc_id long, source string, n_tokens long")


def _budgets(rows: DataFrame, targets: DataFrame, total_tokens: int | None, exact: bool = False) -> list[dict]:
    """One row per target: what the source has and what it is to give. Bounded by ``targets``, so it may be collected."""
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_docs"))
    got = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left").collect()
    out = [r.asDict() | {"available": int(r["available"] or 0), "n_docs": int(r["n_docs"] or 0)} for r in got]
    if total_tokens is None and not exact:
        total_tokens = sum(r["available"] for r in out)
    elif total_tokens is None:
        total_tokens = int(min((r["available"] * r["max_repeats"] / r["target_share"] for r in out if r["available"] and r["target_share"] > 0), default=0))
    for r in out:
        wanted = round(total_tokens * r["target_share"])
        r["wanted"] = wanted
        r["budget"] = min(wanted, r["available"] * r["max_repeats"])
        r["status"] = "no text" if not r["available"] else "short" if r["budget"] < wanted else "met"
        r["epochs"], r["rest"] = divmod(r["budget"], r["available"]) if r["available"] else (0, 0)
        r["ranges"] = max(1, -(-r["n_docs"] // RANGE_ROWS))
    return sorted(out, key=lambda r: r["source"])


def _prepared(docs: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int, vocabulary: str, exact: bool = False) -> tuple[DataFrame, list[dict]]:
    wanted = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # a fixed table of sources
    rows = counted(wanted, vocabulary).groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens")).withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    rows = materialise(rows)
    return rows, _budgets(rows, targets, total_tokens, exact)


_PLAN = "source string, epochs long, rest long, ranges long"


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY, exact: bool = False) -> DataFrame:
    """``doc_id, source, epoch, tokens_used`` of the mixture; a document appears at most ``max_repeats`` times."""
    return _cut(*_prepared(docs, targets, total_tokens, seed, vocabulary, exact))


def _cut(rows: DataFrame, budgets: list[dict]) -> DataFrame:
    spark = rows.sparkSession
    plan = spark.createDataFrame([(r["source"], r["epochs"], r["rest"], r["ranges"]) for r in budgets], _PLAN)
    # the key's place in its range of 2^64, in 0..ranges-1
    placed = rows.join(F.broadcast(plan), "source").withColumn("range_no", F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("ranges")), F.col("ranges") - 1))
    within = Window.partitionBy("source", "range_no").orderBy("key", "doc_id")
    summed = placed.withColumn("before", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    totals = placed.groupBy("source", "range_no").agg(F.sum("n_tokens").alias("t"))
    over = Window.partitionBy("source").orderBy("range_no")
    offsets = totals.withColumn("offset", F.sum("t").over(over) - F.col("t")).drop("t")
    at = summed.join(offsets, ["source", "range_no"]).withColumn("start", F.col("before") + F.col("offset"))
    last = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))
    copies = at.withColumn("last", last).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs") + 1)))
    used = copies.withColumn("tokens_used", F.when(F.col("epoch") <= F.col("epochs"), F.col("n_tokens")).otherwise(F.col("last")))
    return used.where(F.col("tokens_used") > 0).select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "tokens_used")


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY, exact: bool = False) -> DataFrame:
    """One row per target: share aimed at and share reached in the mixture, with the reason for any difference.

    ``wanted_tokens`` is the target's part of the total, ``available_tokens`` one pass over the source's texts.
    """
    spark = docs.sparkSession
    rows, budgets = _prepared(docs, targets, total_tokens, seed, vocabulary, exact)
    mixed = _cut(rows, budgets)
    used = mixed.groupBy("source").agg(F.sum("tokens_used").alias("used_tokens"), F.countDistinct("doc_id").alias("n_docs"), F.max("epoch").alias("most_repeats"))
    told = spark.createDataFrame([(r["source"], float(r["target_share"]), int(r["max_repeats"]), r["available"], r["wanted"], r["status"]) for r in budgets], "source string, target_share double, max_repeats int, available_tokens long, wanted_tokens long, status string")
    all_tokens = F.sum(F.coalesce("used_tokens", F.lit(0))).over(Window.partitionBy(F.lit(0)))  # one row per target
    return told.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", "wanted_tokens",
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce("used_tokens", F.lit(0)) / F.greatest(all_tokens, F.lit(1)), 6).alias("actual_share"), "status",
    )
