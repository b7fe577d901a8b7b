import random
from collections import deque

from pyspark.sql import functions as F

from quire.streaming import limits as L


def test_admit_edges():
    assert L.admit([0, 10, 20], 1, 10, deque()) == [True, False, True]
    assert L.admit([0, 10, 20], 1, 10, deque(), keep_edge=False) == [True, True, True]


def test_limit_table_against_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", i, rng.randrange(10_000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "who string, id long, at long")
    got = {r["tie"]: r["admitted"] for r in L.limit_table(df, "who", "at", "id", 3, 500).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r[2], r[1]) for r in rows if r[0] == k)
        want |= dict(zip([i for _, i in mine], L.admit([t for t, _ in mine], 3, 500, deque())))
    assert got == want


def test_replays_and_signatures(spark):
    d = spark.createDataFrame([("n", 1, 0), ("n", 2, 5), ("n", 3, 50), ("m", 4, 6)], "k string, id int, at long")
    assert {r["id"] for r in L.replays(d, ["k"], "at", "id", 10).where("replayed").collect()} == {2}
    a = {r["k"]: r["signature"] for r in L.signatures(d, ["k"]).collect()}
    b = {r["k"]: r["signature"] for r in L.signatures(d.withColumn("at", F.when(F.col("id") == 4, 7).otherwise(F.col("at"))), ["k"]).collect()}
    assert a["n"] == b["n"] and a["m"] != b["m"]


def test_tiers(spark):
    rows = [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 4, 3), ("c", 5, 4), ("a", 6, 10), ("b", 7, 20), ("b", 8, 86_400_000_000)]
    df = spark.createDataFrame(rows, "who string, id int, at long")
    got = {r["tie"]: r["refused_by"] for r in L.limit_tiers(df, "who", "at", "id", 2, 3, 10, 4).collect()}
    assert got == {1: None, 2: None, 3: "key", 4: None, 5: "all", 6: None, 7: "day", 8: None}


def _run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", "x") for s in (0, 1, 2, 30)] + [("b", "2024-01-01 00:00:05", "y")]
    spark.createDataFrame(rows, "who string, at string, kind string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("who string, at timestamp, kind string").parquet(str(tmp_path / "in"))
    got = _run(spark, L.limit_stream(s, "who", "at", 2, 10_000_000), "limited")
    assert sorted((r["k"], r["admitted"]) for r in got) == [("a", False), ("a", True), ("a", True), ("a", True), ("b", True)]
    assert len(_run(spark, L.first_seen_stream(s, ["who", "kind"], "at", "1 hour"), "firsts")) == 2
    _run(spark, L.hourly_counts_stream(s, "at", "kind"), "hours")
