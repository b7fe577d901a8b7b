"""The event operators as Structured Streaming, drained over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.ingest import HOUR
from quire.plans.kit import Catalogue
from quire.session import checkpoint_dir, forgotten
from quire.streaming.limits import first_seen_stream, hourly_counts_stream, limit_stream
from quire.tables import load

C = Catalogue()


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    return spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all input that is there now; a consumer that runs by the hour does just this.

    Progress and results are kept in the shared folder, so that a lost executor or driver goes on from the last batch.
    """
    spark = stream.sparkSession
    root = forgotten(spark, f"{checkpoint_dir(spark).rstrip('/')}/stream")

    def keep(batch: DataFrame, no: int) -> None:
        # a batch that is run again replaces what it wrote; in complete mode each batch replaces all
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else no}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


@C.plan("SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind, kept up to date by each run."""
    got = drained(hourly_counts_stream(events_stream(spark, sf_dir), "ts", "event_type"), "complete")
    return got.select(F.unix_micros("hour").alias("hour_us"), "event_type", "n")


@C.plan("SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose key was not seen within the bound on late data, replays dropped."""
    return drained(first_seen_stream(events_stream(spark, sf_dir), ["user_id", "event_type"], "ts", "40 days")).groupBy("event_type").agg(F.count("*").alias("n"))


@C.plan("""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
    r AS (SELECT user_id, n, t, [t] AS win, true AS ok FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.n, e.t, CASE WHEN len(list_filter(r.win, lambda x: x >= e.t - 86400000000)) < 2 THEN list_append(list_filter(r.win, lambda x: x >= e.t - 86400000000), e.t) ELSE list_filter(r.win, lambda x: x >= e.t - 86400000000) END,
                 len(list_filter(r.win, lambda x: x >= e.t - 86400000000)) < 2 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT CAST(user_id AS VARCHAR) AS k, t AS at_us, ok AS admitted FROM r""")
def stream_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events a day for each user as a stateful stream."""
    return drained(limit_stream(events_stream(spark, sf_dir), "user_id", "ts", 2, 24 * HOUR))


QUERIES, SQL = C.queries, C.sql
