"""Numbering, sums and carried values over ranges, and names that are unique, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.changes import duplicate_as_draft, numbered_slugs, soft_delete
from quire.operators.ranges import carried_forward, numbered, running_sum


@pytest.mark.parametrize("ranges", [1, 7])
def test_numbers_and_sums(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r["i"]: (r["n"], r["s"]) for r in running_sum(numbered(df, ["k"], ["i"], "n", ranges), ["k"], ["i"], F.col("v"), "s", ranges).collect()}
    seen: dict = {}
    for k, i, v in rows:
        n, s = seen.get(k, (0, 0))
        seen[k] = (n + 1, s + v)
        assert got[i] == seen[k]
    assert {r["i"]: r["n"] for r in numbered(df, [], ["i"], "n", ranges).collect()} == {i: i + 1 for i in range(400)}


@pytest.mark.parametrize("ranges", [1, 6])
def test_carried(spark, ranges):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "b"]), i, f"h{i}" if rng.random() < 0.03 else None) for i in range(500)]
    got = {r["i"]: r["c"] for r in carried_forward(spark.createDataFrame(rows, "k string, i int, h string"), ["k"], ["i"], F.col("h"), "c", ranges).collect()}
    last: dict = {}
    for k, i, h in rows:
        last[k] = h or last.get(k)
        assert got[i] == last[k]


def test_slugs_are_unique(spark):
    names = ["a", "a", "a 2", "a 4", "a", "a", "A!", "b", "b 2", "b-3", "", "", "x" * 155, "x" * 156, "x" * 155] + ["c"] * 5 + ["c 3"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = {r["k"]: r["slug"] for r in numbered_slugs(df, "k", F.col("n")).collect()}
    assert len(set(got.values())) == len(names) == len(got)
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6)] == ["a", "a-3", "a-2", "a-4", "a-5", "a-6", "a-7"]
    assert got[7] == "b" and got[8] == "b-2" and got[9] == "b-3" and got[10] == "section" and got[11] == "section-2"
    assert sorted(got[i] for i in range(15, 21)) == ["c", "c-2", "c-3", "c-4", "c-5", "c-6"] and got[20] == "c-3"


def test_drafts_and_soft_deletes(spark):
    df = spark.createDataFrame([(1, "one", "t", "published", True), (2, "one-copy", None, "published", False)], "id int, slug string, title string, status string, pinned boolean")
    got = {r["copy_of"]: r for r in duplicate_as_draft(df, "id", F.lit(True), off=("pinned",)).collect()}
    assert got[1]["slug"] == "one-copy-2" and got[1]["title"] == "t (Copy)" and got[1]["status"] == "draft" and not got[1]["pinned"]
    assert got[2]["slug"] == "one-copy-copy" and got[2]["title"] is None
    assert [r["status"] for r in soft_delete(df, F.col("id") == 2).orderBy("id").collect()] == ["published", "archived"]
