"""Streams of the fetch log and of submissions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400


def daily_counts(log: DataFrame, ts: str = "ts", kind: str = "event_type", lateness: str = "2 days") -> DataFrame:
    """(day, kind, n) by event time; rows later than the watermark are dropped, so state is bounded by it."""
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def admit(times: list[float], recent: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which of the sorted times are admitted, and the admitted ones still in the window. Rejected ones don't count."""
    out = []
    for t in times:
        recent = [r for r in recent if r > t - window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, recent


def rate_limited(hits: DataFrame, key: str, ts: str, limit: int = 3, window: int = DAY, lateness: str = "1 hour") -> DataFrame:
    """(key, ts, admitted): at most `limit` admitted hits of a key in any window, by event time.

    State is `limit` times a key, and goes once the watermark has passed the window. Hits of a batch are taken in the
    order of their times.
    """
    rows = hits.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", lateness)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        found = pd.concat(list(parts)).sort_values("ts", kind="stable")
        seconds = found["ts"].astype("datetime64[us]").astype("int64") / 1e6
        found["admitted"], recent = admit(seconds.tolist(), recent, limit, window)
        state.update((recent,))
        ends = int((max([*recent, seconds.max()]) + window) * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield found[["key", "ts", "admitted"]]

    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, admitted boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def batch_admitted(hits: DataFrame, key: str, ts: str, order: str, limit: int = 3, window: int = DAY) -> DataFrame:
    """(key, order, admitted) of a finished log by the same rule.

    A fold over each key's times as they stream by in order: only the admitted times that still count are held, so a key
    of any length needs `limit` numbers.
    """
    rows = hits.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).cast("long").alias("place"))

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, []
        for part in parts:
            out = []
            for k, t in zip(part["key"], part["t"], strict=True):
                if k != last:
                    last, recent = k, []
                (ok,), recent = admit([t / 1e6], recent, limit, window)
                out.append(ok)
            yield pd.DataFrame({"key": part["key"], "place": part["place"], "admitted": out})

    return rows.repartition("key").sortWithinPartitions("key", "t", "place").mapInPandas(step, "key string, place long, admitted boolean")


def failure_runs(log: DataFrame, key: str, failed: str, order: str) -> DataFrame:
    """(key, failures) after each batch: failures since the last success; the state is one number a key."""
    rows = log.select(F.col(key).cast("long").alias("key"), F.col(failed).alias("failed"), F.col(order).alias("place"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        found = pd.concat(list(parts)).sort_values("place", kind="stable")
        for bad in found["failed"]:
            n = n + 1 if bad else 0
        state.update((int(n),))
        yield pd.DataFrame({"key": [k[0]], "failures": [int(n)]})

    return rows.groupBy("key").applyInPandasWithState(step, "key long, failures long", "n long", "update", GroupStateTimeout.NoTimeout)
