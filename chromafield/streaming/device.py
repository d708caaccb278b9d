"""Device states: CONNECTED, DISCONNECTED (timed out), UNWIRED (registered, never seen)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chromafield.session import broadcast_if_small


def device_status(
    df: DataFrame,
    registry: DataFrame,
    timeout_us: int,
    now_us: int,
    sensor: str = "sensor_id",
    ts: str = "timestamp_us",
) -> DataFrame:
    """Batch form: the last row per device against ``now_us``, for every registered device."""
    last = df.groupBy(sensor).agg(F.max(ts).alias("last_seen_us"))
    state = (
        F.when(F.col("last_seen_us").isNull(), "UNWIRED")
        .when(F.col("last_seen_us") < now_us - timeout_us, "DISCONNECTED")
        .otherwise("CONNECTED")
    )
    return registry.join(broadcast_if_small(last), sensor, "left").withColumn("state", state)


STATUS_SCHEMA = "sensor_id long, state string, at_us long"


class DeviceStatus(StatefulProcessor):
    """State changes per device: connected on data, disconnected by an event-time timer.

    Event-time timers make the result depend on the data alone, not on the wall clock.
    """

    def __init__(self, timeout_us: int, ts: str = "timestamp_us"):
        self.timeout_us = timeout_us
        self.ts = ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us long, online boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        times = np.sort(np.concatenate([pdf[self.ts].to_numpy(dtype="int64") for pdf in rows]))
        known = self.last.get() if self.last.exists() else None
        last, online = (int(known[0]), bool(known[1])) if known else (None, False)
        if last is not None:
            times = np.concatenate([[last], np.maximum(times, last)])
        gone = np.nonzero(np.diff(times) > self.timeout_us)[0]
        # pauses inside the batch count as much as pauses between batches
        states, at = [], []
        for left, back in zip(times[gone], times[gone + 1]):
            if online or states or left != last:
                states.append("DISCONNECTED")
                at.append(int(left) + self.timeout_us)
            states.append("CONNECTED")
            at.append(int(back))
        if last is None:
            states.insert(0, "CONNECTED")
            at.insert(0, int(times[0]))
        elif not online and "CONNECTED" not in states:
            states.append("CONNECTED")
            at.append(int(times[1]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(times[-1]) + self.timeout_us) // 1000 + 1)
        self.last.update((int(times[-1]), True))
        if states:
            yield pd.DataFrame({"sensor_id": [key[0]] * len(at), "state": states, "at_us": at})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last_us, _ = self.last.get()
        self.last.update((last_us, False))
        yield pd.DataFrame(
            {"sensor_id": [key[0]], "state": ["DISCONNECTED"], "at_us": [int(last_us) + self.timeout_us]}
        )

    def close(self) -> None:
        pass


def stream_device_status(
    stream: DataFrame, timeout_us: int, sensor: str = "sensor_id", ts: str = "timestamp_us"
) -> DataFrame:
    """Streaming form over a watermarked stream; UNWIRED devices are those never emitted."""
    return stream.groupBy(F.col(sensor).cast("long").alias("sensor_id")).transformWithStateInPandas(
        statefulProcessor=DeviceStatus(timeout_us, ts),
        outputStructType=STATUS_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
