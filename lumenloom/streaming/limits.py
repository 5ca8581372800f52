"""Keyed state over streams: the sliding limiter, recent results with expiry, latest job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_limit(hits: DataFrame, limit: int, window_s: float, delay: str = "1 hour") -> DataFrame:
    """k, id, allowed, wait_s for a stream of hits (k, id, t in seconds, ts the same as a timestamp).

    Only accepted hits count. The state of a key is at most `limit` times; it goes when the watermark has
    passed its last hit by a window (event time, so that a run over what is there ends). Hits that come
    later than `delay` are dropped by the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        out = []
        for t, i in zip(rows["t"], rows["id"]):
            times = [x for x in times if t - x < window_s]
            ok = len(times) < limit
            out.append((key[0], int(i), ok, 0.0 if ok else times[0] + window_s - t))
            if ok:
                times.append(float(t))
        state.update((times,))
        ends = int((float(rows["t"].max()) + window_s) * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["k", "id", "allowed", "wait_s"])

    keyed = hits.withWatermark("ts", delay).groupBy("k")
    return keyed.applyInPandasWithState(step, "k string, id long, allowed boolean, wait_s double", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def recent_results(made: DataFrame, hours: int = 24) -> DataFrame:
    """The newest result (made_id, made_at) of each key in a stream; late ones beyond the hours are dropped by watermark."""
    return made.withWatermark("made_at", f"{hours} hours").groupBy("key").agg(F.max_by("made_id", "made_at").alias("made_id"), F.max("made_at").alias("made_at"))


def distinct_events(events: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each event once, with state kept for the delay only."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
