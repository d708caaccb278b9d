"""Event time, windows, late data, votes, promotion and the corpus writer as streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chromafield.operators.ordered import slice_of
from chromafield.operators.sets import dedupe
from chromafield.session import scratch_path
from chromafield.sources.sinks import append_corpus, store_observation


def with_event_time(df: DataFrame, delay: str, ts: str = "timestamp_us") -> DataFrame:
    """``event_time`` from the master clock's microseconds, with a watermark."""
    return df.withColumn("event_time", F.timestamp_micros(F.col(ts))).withWatermark("event_time", delay)


def tumbling(df: DataFrame, duration: str, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates per tumbling window and key; the window's start is ``window_us``."""
    return _flat(df.groupBy(F.window("event_time", duration), *keys).agg(*aggs), keys)


def sliding(df: DataFrame, duration: str, slide: str, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates per overlapping window.  Choice: the slide is an argument."""
    return _flat(df.groupBy(F.window("event_time", duration, slide), *keys).agg(*aggs), keys)


def sessions(df: DataFrame, gap: str, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates per session: activity with no pause longer than ``gap``."""
    return _flat(df.groupBy(F.session_window("event_time", gap).alias("window"), *keys).agg(*aggs), keys, True)


def _flat(grouped: DataFrame, keys: Sequence[str], with_end: bool = False) -> DataFrame:
    rest = [c for c in grouped.columns if c != "window" and c not in keys]
    end = [F.unix_micros("window.end").alias("window_end_us")] if with_end else []
    return grouped.select(F.unix_micros("window.start").alias("window_us"), *end, *keys, *rest)


def stream_votes(
    votes: DataFrame, duration: str, keys: Sequence[str], voter: str = "voter", score: str = "score"
) -> DataFrame:
    """Three voters per window and key once the watermark passes; a missing voter is null."""
    names = ("gpu_score", "coral_score", "tdoa_confidence")
    return tumbling(
        votes,
        duration,
        keys,
        *[F.avg(F.when(F.col(voter) == i, F.col(score))).alias(n) for i, n in enumerate(names)],
    )


def stream_clock_pairs(
    a: DataFrame,
    b: DataFrame,
    tolerance_us: int,
    keys: Sequence[str],
    a_cols: Sequence[str],
    b_cols: Sequence[str],
) -> DataFrame:
    """Interval join of two watermarked clocks on equal keys; both states are bounded.

    A time bucket joins the equality, so a row meets only the state of its own and the two
    neighbouring buckets, however busy its key is.
    """

    def bucket() -> Column:
        return slice_of(F.unix_micros("event_time"), tolerance_us)

    left = a.select(
        *[F.col(k).alias(f"a_{k}") for k in keys],
        F.col("event_time").alias("a_time"),
        *a_cols,
        F.explode(F.array(bucket() - 1, bucket(), bucket() + 1)).alias("a_bucket"),
    )
    right = b.select(
        *[F.col(k).alias(f"b_{k}") for k in keys],
        F.col("event_time").alias("b_time"),
        *b_cols,
        bucket().alias("b_bucket"),
    )
    span = f"INTERVAL {tolerance_us} MICROSECONDS"
    on = F.expr(f"b_time BETWEEN a_time - {span} AND a_time + {span}") & (
        F.col("a_bucket") == F.col("b_bucket")
    )
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return (
        left.join(right, on)
        .withColumn("divergence_us", F.unix_micros("b_time") - F.unix_micros("a_time"))
        .drop("a_bucket", "b_bucket")
    )


def stream_dedupe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop repeated packets within the watermark; the state stays bounded."""
    return dedupe(df, keys, watermark=True)


# ---- late rows -----------------------------------------------------------------------


def split_late(
    batch: DataFrame,
    batch_id: int,
    path: str,
    delay_us: int,
    on_time: Callable[[DataFrame, int], None],
    ts: str = "timestamp_us",
) -> None:
    """Keep rows behind the horizon as data in ``path/late`` and pass the rest on.

    The horizon is the newest time of the earlier batches minus the delay.  It is stored
    per batch, and a batch only reads the horizons before it, so a retry decides alike.
    """
    spark = batch.sparkSession
    horizons = f"{path}/horizon"
    newest = None
    if batch_id > 0:
        seen = spark.read.schema("batch int, newest long").json(f"{horizons}/*")
        newest = seen.where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
    batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # a row without a time is not late: it goes on with the others
        late = F.lit(False)
        if newest is not None:
            late = F.coalesce(F.col(ts) < F.lit(newest - delay_us), late)
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        on_time(batch.where(~late), batch_id)
        top = batch.agg(F.max(ts)).first()[0]
        top = max(v for v in (top, newest, 0) if v is not None)
        row = spark.createDataFrame([(batch_id, top)], "batch int, newest long")
        row.coalesce(1).write.mode("overwrite").json(f"{horizons}/b{batch_id}")
    finally:
        batch.unpersist()


def late_rows(
    stream: DataFrame, path: str, delay_us: int, on_time: Callable[[DataFrame, int], None], checkpoint: str
):
    """Stream writer that separates late rows before any stateful operator can drop them."""
    return stream.writeStream.foreachBatch(
        lambda batch, batch_id: split_late(batch, batch_id, path, delay_us, on_time)
    ).option("checkpointLocation", checkpoint)


# ---- promotion, configuration, corpus ------------------------------------------------


def promote_windows(windows: DataFrame, predicate: Column, path: str, checkpoint: str):
    """Stream writer that stores interesting windows as episodes, keyed by batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        store_observation(batch.where(predicate), path, batch_id, ts="window_us")

    return windows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def read_config(spark: SparkSession, path: str) -> dict:
    """Current settings: one small JSON document, read anew on every call."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"more than one settings document in {path}")
    return json.loads(rows[0][0]) if rows else {}


def with_config(
    stream: DataFrame, path: str, handle: Callable[[DataFrame, int, dict], None], checkpoint: str
):
    """Stream writer whose handler gets the settings as they are at each batch: no restart."""
    return stream.writeStream.foreachBatch(
        lambda batch, batch_id: handle(batch, batch_id, read_config(batch.sparkSession, path))
    ).option("checkpointLocation", checkpoint)


def corpus_writer(stream: DataFrame, path: str, checkpoint: str):
    """The corpus as its own query with its own checkpoint, so no other branch can stop it."""
    return stream.writeStream.foreachBatch(
        lambda batch, batch_id: append_corpus(batch, path, batch_id)
    ).option("checkpointLocation", checkpoint)


# ---- decay state ---------------------------------------------------------------------


def decayed(
    times: np.ndarray, values: np.ndarray, last: int | None, x: float, tau_us: float
) -> tuple[np.ndarray, int, float]:
    """Decay states of rows in time order after ``(last, x)``, and the state they leave.

    A row behind ``last`` does not decay anything.  Within 40 time constants the states are
    one scaled running sum; longer stretches are done one after the other.
    """
    at = np.maximum.accumulate(times if last is None else np.maximum(times, last)).astype(np.int64)
    step = np.diff(at, prepend=at[0] if last is None else last)
    keep = np.exp(-step / tau_us)
    if last is None:
        keep[0] = 0.0
    gain = (1.0 - keep) * values.astype(np.float64)
    out, start = np.empty(len(at)), 0
    while start < len(at):
        end = int(np.searchsorted(at, at[start] + 40 * tau_us, "right"))
        age = (at[start:end] - at[start]) / tau_us
        scaled = gain[start:end] * np.exp(age)
        scaled[0] += x * keep[start]
        out[start:end] = np.cumsum(scaled) * np.exp(-age)
        x, start = float(out[end - 1]), end
    return out, int(at[-1]), x


class DecayState(StatefulProcessor):
    """Per-entity state x <- x e^(-dt/tau) + (1 - e^(-dt/tau)) u, carried across batches."""

    def __init__(self, tau_us: int, value: str, ts: str, entity: str, ident: str):
        self.tau_us, self.value, self.ts, self.entity, self.ident = tau_us, value, ts, entity, ident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decay", "last_us long, x double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        known = self.state.get() if self.state.exists() else None
        last, x = (int(known[0]), float(known[1])) if known else (None, 0.0)
        # a micro-batch's rows of one entity, put in time order
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([self.ts, self.ident])
        out, last, x = decayed(pdf[self.ts].to_numpy(), pdf[self.value].to_numpy(), last, x, self.tau_us)
        self.state.update((last, x))
        yield pd.DataFrame(
            {self.entity: key[0], self.ident: pdf[self.ident], self.ts: pdf[self.ts], "smoothed": out}
        )

    def close(self) -> None:
        pass


def stateful_decay(
    stream: DataFrame,
    tau_us: int,
    entity: str = "entity",
    value: str = "energy",
    ts: str = "timestamp_us",
    ident: str = "particle_id",
) -> DataFrame:
    """Streaming form of ``decay_smooth``; needs the RocksDB state store."""
    return (
        stream.select(F.col(entity).cast("long").alias(entity), ident, ts, value)
        .groupBy(entity)
        .transformWithStateInPandas(
            statefulProcessor=DecayState(tau_us, value, ts, entity, ident),
            outputStructType=f"{entity} long, {ident} long, {ts} long, smoothed double",
            outputMode="Append",
            timeMode="None",
        )
    )


# later than any observation: 2100-01-01
END_US = 4_102_444_800_000_000


def closable(stream: DataFrame, ts: str = "timestamp_us", **values) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a second input for an end mark, and the function that sends the mark.

    The mark is one row at ``END_US`` with the given ``values`` (null elsewhere).  Sent after
    the last row of a finite input, it moves the watermark past everything, so that windows,
    sessions and timers which are still open give their results.  The mark's own window stays
    open and never appears; operators that emit at once give one row at ``END_US``.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "end")
    # the mark is null in fields that no observation lacks
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields])
    spark.createDataFrame([], nullable).write.parquet(path)

    def close() -> None:
        row = {f.name: values.get(f.name) for f in stream.schema.fields} | {ts: END_US}
        mark = spark.createDataFrame([tuple(row[c] for c in stream.columns)], nullable)
        mark.write.mode("append").parquet(path)

    marks = spark.readStream.schema(nullable).parquet(path)
    return stream.unionByName(marks), close


def drain(
    stream: DataFrame, name: str, mode: str = "append", close: Callable[[], None] | None = None
) -> DataFrame:
    """Run a stream over all available input and return its output as a table.

    With ``close`` from ``closable`` the end mark follows, and what was still open is part of
    the table.  Output and checkpoint lie in the session's shared folder.
    """
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")

    def run() -> None:
        drain_batches(
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", out)
            .option("checkpointLocation", ckpt)
        )

    run()
    if close:
        close()
        run()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(writer) -> None:
    """Run a prepared foreachBatch writer over all available input."""
    writer.trigger(availableNow=True).start().awaitTermination()
