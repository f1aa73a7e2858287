"""Rate limiters: each event is admitted or rejected by how many of its key were admitted in the window before it.

A window is cut into segments. An event is admitted if fewer than limit of its key have been in its own segment and those
before it within a window; rejected ones don't count. One segment is a fixed window, several are a sliding one. The same
rule runs over tables, where partitions are sorted by key and time and walked with one key's counts in hand, and over
streams, where the counts are keyed state. Events of equal time go by id. In a stream, an event older than the newest
segment of its key is judged as of that segment. Null keys are one key; events without a time are rejected, and don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query

#: Events, seconds and segments of the limiter for all requests, and of that for downloads.
FIXED, DOWNLOADS = (120, 60, 1), (5, 60, 10)

Counts = dict[int, int]


def admitted(segments: list[int | None], held: Counts, limit: int, kept: int) -> list[bool]:
    """Whether each event, given by its segment in order of time, is admitted; held has the admitted ones by segment, and is brought up to date."""
    out = []
    for s in segments:
        if s is None:
            out.append(False)
            continue
        now = max(s, max(held, default=s))
        for old in [x for x in held if x <= now - kept]:
            del held[old]
        out.append(sum(held.values()) < limit)
        if out[-1]:
            held[now] = held.get(now, 0) + 1
    return out


def _segmented(events: DataFrame, key: str, seconds: int, kept: int) -> DataFrame:
    length = seconds * 1_000_000 // kept
    return events.select(F.col("event_id").cast("long").alias("event_id"), F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.expr(f"unix_micros(cast(ts as timestamp)) div {length}").alias("segment"))


def limited(events: DataFrame, key: str, limit: int, seconds: int, kept: int) -> DataFrame:
    """event_id, key, ts, admitted of a table of events(event_id, ts, key). One key's events are met in one task, one batch at a time."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, {}
        for batch in batches:
            said: list[bool] = []
            for name, rows in batch.groupby("key", sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if (name,) != last:
                    last, held = (name,), {}
                said += admitted([None if pd.isna(x) else int(x) for x in rows["segment"]], held, limit, kept)
            yield batch.assign(admitted=said)[["event_id", "key", "ts", "admitted"]]

    rows = _segmented(events, key, seconds, kept)
    ordered = rows.repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return ordered.mapInPandas(walk, "event_id long, key string, ts timestamp, admitted boolean")


def limited_stream(events: DataFrame, key: str, limit: int, seconds: int, kept: int, late: str = "10 minutes") -> DataFrame:
    """The same of a stream; the counts of a key's window are its state, which goes when time has passed it by a window. Events later than the watermark are dropped."""

    def walk(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: Counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        said = admitted([None if pd.isna(x) else int(x) for x in rows["segment"]], held, limit, kept)
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp((max(held) + kept + 1) * seconds * 1000 // kept)
        yield rows.assign(admitted=said, key=keys[0])[["event_id", "key", "ts", "admitted"]]

    rows = _segmented(events, key, seconds, kept).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(walk, "event_id long, key string, ts timestamp, admitted boolean", "segments array<long>, counts array<long>", "append", "EventTimeTimeout")


#: Events of the table are far apart, so the queries' windows are days.
DAY, FEW = 86_400, 2


def _sql(limit: int, seconds: int, kept: int) -> str:
    """A fold over a key's events: the segments of those admitted, and what was said of each."""
    length = seconds * 1_000_000 // kept
    near = f"len(list_filter(a.held, lambda x: x > e.held[1] - {kept})) < {limit}"
    return f"""WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, ts, epoch_us(ts) // {length} AS s FROM events),
g AS (SELECT key, list(event_id ORDER BY ts, event_id) AS ids, list(s ORDER BY ts, event_id) AS s FROM e GROUP BY key),
r AS (SELECT key, ids, list_reduce(list_concat([{{'held': CAST([] AS BIGINT[]), 'said': CAST([] AS BOOLEAN[])}}], list_transform(s, lambda x: {{'held': [CAST(x AS BIGINT)], 'said': CAST([] AS BOOLEAN[])}})),
  lambda a, e: {{'held': CASE WHEN {near} THEN list_append(list_filter(a.held, lambda x: x > e.held[1] - {kept}), e.held[1]) ELSE a.held END, 'said': list_append(a.said, {near})}}).said AS said FROM g)
SELECT unnest(ids) AS event_id, key, unnest(said) AS admitted FROM r"""


@query(_sql(FEW, DAY, 1))
def limited_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", FEW, DAY, 1).drop("ts")


@query(_sql(FEW, DAY, 10))
def limited_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", FEW, DAY, 10).drop("ts")
