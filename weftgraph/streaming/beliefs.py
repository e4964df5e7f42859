"""Streams of observations: beliefs with a time to live, sessions, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BELIEFS = "key string, belief double, seen long, error double, anomaly boolean"
STATE = "belief double, seen long"


def beliefs(rows: DataFrame, key: str, value: str, time: str, rate: float = 0.1, start: float = 0.5, anomaly: float = 0.3, ttl_seconds: int = 600, delay: str = "1 minute") -> DataFrame:
    """For each key and micro-batch: belief <- belief + rate * (observation - belief), within 0 and 1, over its rows in the order of time; keys unseen for the time to live are forgotten.

    The state of a key is two numbers, whatever its number of rows; a micro-batch takes 16 bytes a row of a key while it is put in order.
    """

    def update(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        belief, seen = state.get if state.exists else (start, 0)
        worst = 0.0
        # parts are Arrow batches without an order among them, so all of a key's rows are put in order, as two numbers a row
        held = [(part["at"].to_numpy("datetime64[ns]").astype(np.int64), part["x"].to_numpy(np.float64)) for part in parts]
        at, xs = (np.concatenate(c) for c in zip(*held, strict=True))
        newest = int(at.max()) // 1_000_000
        for x in xs[np.lexsort((xs, at))].tolist():
            worst = max(worst, abs(x - belief))
            belief = min(1.0, max(0.0, belief + rate * (x - belief)))
        seen += len(xs)
        state.update((belief, seen))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ttl_seconds * 1000)
        yield pd.DataFrame({"key": [group[0]], "belief": [belief], "seen": [seen], "error": [worst], "anomaly": [worst > anomaly]})

    ready = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("x"), F.col(time).cast("timestamp").alias("at")).where("key IS NOT NULL AND x IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    return ready.groupBy("key").applyInPandasWithState(update, BELIEFS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def sessions(rows: DataFrame, key: str, time: str, gap: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """Conversations by a gap in time, closed once the watermark passes."""
    at = rows.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    return at.groupBy(F.session_window("_at", gap).alias("session"), key).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("first_seen"), F.col("session.end").alias("last_seen"), "n")


def windowed(rows: DataFrame, label: str, time: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Observations of a label by event-time windows."""
    at = rows.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    return at.groupBy(F.window("_at", width).alias("w"), label).agg(F.count("*").alias("n")).select(label, F.col("w.start").alias("start"), "n")


def after(rows: DataFrame, seq: str, offset: int) -> DataFrame:
    """Events behind an offset."""
    return rows.where(F.col(seq) > offset)
