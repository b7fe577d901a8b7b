"""Event control: admission limits, replay detection and change signatures, over whole tables and over streams.

A sliding-window limiter that only counts admitted events is sequential within its key. Over a table the events are
brought together by key and sorted within partitions, and a partition is read as a stream of batches that carries only
the window of the current key: no key's events are ever collected, however many it has.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.session import materialise
from quire.tables import lookup


def admit(times: list[int], limit: int, span: int, window: deque[int], keep_edge: bool = True) -> list[bool]:
    """Which events (microseconds, in order) are admitted; ``window`` holds the admitted ones still in the span.

    With ``keep_edge`` an event exactly ``span`` old still counts, otherwise it has left the window.
    """
    out = []
    for t in times:
        cut = t - span
        while window and (window[0] < cut if keep_edge else window[0] <= cut):
            window.popleft()
        ok = len(window) < limit
        if ok:
            window.append(t)
        out.append(ok)
    return out


def limit_table(events: DataFrame, key: str, at_us: str, tie: str, limit: int, span_us: int, keep_edge: bool = True) -> DataFrame:
    """``key, tie, at_us, admitted`` of every event. Null keys are one key."""
    e = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(tie).alias("tie"), F.col(at_us).alias("at_us"))
    ordered = e.repartition("k").sortWithinPartitions("k", "at_us", "tie")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, deque()
        for b in batches:
            got: list[bool] = []
            starts = [0, *((b["k"] != b["k"].shift()).to_numpy().nonzero()[0].tolist()), len(b)]
            for a, z in zip(sorted(set(starts)), sorted(set(starts))[1:]):
                k = b["k"].iloc[a]
                if k != current:
                    current, window = k, deque()
                got += admit(b["at_us"].iloc[a:z].tolist(), limit, span_us, window, keep_edge)
            yield b.assign(admitted=got)

    return ordered.mapInPandas(run, f"k string, tie {dict(e.dtypes)['tie']}, at_us long, admitted boolean")


def _pieces(e: DataFrame, span_us: int) -> DataFrame:
    """Events with ``piece``: stretches of time between which no state passes.

    A stretch ends where a whole span without events follows and the day changes. Found on the spans that hold events,
    whose number depends on the time covered, not on the events.
    """
    day = 86_400_000_000
    spans = e.groupBy(F.floor(F.col("at_us") / span_us).alias("q")).agg(F.min("at_us").alias("lo"), F.max("at_us").alias("hi"))
    w = Window.partitionBy(F.lit(0)).orderBy("q")
    before, last = F.lag("q").over(w), F.lag("hi").over(w)
    cut = (before < F.col("q") - 1) & (F.floor(last / day) != F.floor(F.col("lo") / day))
    pieces = materialise(spans.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("piece", F.sum("cut").over(w)).select("q", "piece"))
    return lookup(e.withColumn("q", F.floor(F.col("at_us") / span_us)), pieces, ["q"], "inner").drop("q")


def limit_tiers(events: DataFrame, key: str, at_us: str, tie: str, per_key: int, per_all: int, span_us: int, per_day: int) -> DataFrame:
    """``k, tie, at_us, refused_by``: limits by key, over all keys, and by day, of which an event must meet all.

    The limits over all keys make every decision depend on the one before, whatever the key, so a stretch of time
    without a gap is one stream by definition. Stretches between which no state passes are read in parallel. The state
    is the admitted events of the span, ``per_all`` at most. Use ``limit_table`` where a limit by key will do.
    """
    e = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(tie).alias("tie"), F.col(at_us).alias("at_us"))
    day = 86_400_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine: Counter = Counter()  # admitted events of the span by key
        every: deque[tuple[int, str]] = deque()
        today, used, piece = None, 0, None
        for b in batches:
            got: list[str | None] = []
            for p, k, t in zip(b["piece"], b["k"], b["at_us"]):
                if p != piece:
                    piece = p
                    mine.clear()
                    every.clear()
                if t // day != today:
                    today, used = t // day, 0
                while every and every[0][0] <= t - span_us:
                    gone = every.popleft()[1]
                    mine[gone] -= 1
                    if not mine[gone]:
                        del mine[gone]
                why = "key" if mine[k] >= per_key else "all" if len(every) >= per_all else "day" if used >= per_day else None
                if why is None:
                    mine[k] += 1
                    every.append((t, k))
                    used += 1
                got.append(why)
            yield b.drop(columns="piece").assign(refused_by=pd.Series(got, index=b.index, dtype=object))

    ordered = _pieces(e, span_us).repartition("piece").sortWithinPartitions("piece", "at_us", "tie").select("k", "tie", "at_us", "piece")
    return ordered.mapInPandas(run, f"k string, tie {dict(e.dtypes)['tie']}, at_us long, refused_by string")


def trailing_counts(events: DataFrame, key: str, at_us: str, span_us: int) -> DataFrame:
    """Events of the key in the span up to each: the upper bound of the limiter, as a range window."""
    w = Window.partitionBy(key).orderBy(at_us).rangeBetween(-span_us, 0)
    return events.withColumn("n_trailing", F.count("*").over(w))


def replays(events: DataFrame, keys: list[str], at_us: str, tie: str, skew_us: int) -> DataFrame:
    """Events whose keys came before within the allowed skew."""
    w = Window.partitionBy(*keys).orderBy(at_us, tie)
    return events.withColumn("_before", F.lag(at_us).over(w)).withColumn("replayed", F.coalesce(F.col(at_us) - F.col("_before") <= skew_us, F.lit(False))).drop("_before")


def signatures(df: DataFrame, keys: list[str]) -> DataFrame:
    """One signature per key over its rows in any order: what a poller compares to see a change.

    Rows are added up, so a repeated row counts as often as it is there; fields go in with their lengths, and nulls as
    such, so that values cannot run into each other.
    """
    field = lambda c: F.coalesce(F.concat_ws(":", F.length(F.col(c).cast("string")), F.col(c).cast("string")), F.lit("-"))
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.when(F.col(c).isNull(), "-").otherwise(field(c)) for c in df.columns]), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.sum(row).cast("string").alias("signature"), F.count("*").alias("n"))


# --- streams -------------------------------------------------------------------------------------------------------


def limit_stream(events: DataFrame, key: str, at: str, limit: int, span_us: int) -> DataFrame:
    """The limiter as a stateful stream operator: state is the window of admitted times of a key.

    Events may come late by the span; a key's state is dropped once the watermark has passed its window.
    """
    e = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", f"{max(1, span_us // 1_000_000)} seconds").withColumn("at_us", F.unix_micros("at"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = deque(state.get[0] if state.exists else [])
        times = sorted(t for b in batches for t in b["at_us"].tolist())
        ok = admit(times, limit, span_us, window)
        state.update((list(window),))
        state.setTimeoutTimestamp(max((times[-1] + span_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [k[0]] * len(times), "at_us": times, "admitted": ok})

    return e.groupBy("k").applyInPandasWithState(run, "k string, at_us long, admitted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen_stream(events: DataFrame, keys: list[str], at: str, skew: str) -> DataFrame:
    """Events whose keys were not seen within the skew: replays are dropped, state is dropped with the watermark."""
    return events.withWatermark(at, skew).dropDuplicatesWithinWatermark(keys)


def hourly_counts_stream(events: DataFrame, at: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Counts by hour and kind with a bound on late data."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour"), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), kind, "n")
