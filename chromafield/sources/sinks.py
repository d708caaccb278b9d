"""Append-only sinks and exports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafield.functions.text import corpus_day
from chromafield.operators.filters import scrub
from chromafield.operators.graph import neighbourhood
from chromafield.operators.joins import corroborated
from chromafield.session import broadcast_if_small, cut_lineage


def _by_day(df: DataFrame, ts: str) -> DataFrame:
    """One partition folder per UTC day; the rebalance hint splits a hot day into many files."""
    return df.withColumn("day", corpus_day(F.col(ts))).hint("rebalance", "day")


def append_corpus(df: DataFrame, path: str, batch_id: int | None = None, ts: str = "timestamp_us") -> None:
    """Append particles to the columnar corpus and its JSONL duplicate.

    Rows are never changed or removed.  A stream passes its ``batch_id``: the batch then
    has its own folder, so a retried batch replaces only its own unfinished output.
    """
    rows = _by_day(df, ts)
    mode, suffix = ("append", "") if batch_id is None else ("overwrite", f"/batch={batch_id}")
    rows.write.mode(mode).partitionBy("day").parquet(f"{path}/particles{suffix}")
    rows.write.mode(mode).partitionBy("day").json(f"{path}/events_jsonl{suffix}")


def store_observation(df: DataFrame, path: str, batch_id: int | None = None, ts: str = "timestamp_us") -> None:
    """Append observations to the episodic table."""
    suffix = "" if batch_id is None else f"/batch={batch_id}"
    mode = "append" if batch_id is None else "overwrite"
    _by_day(df, ts).write.mode(mode).partitionBy("day").parquet(f"{path}{suffix}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a stream stored by ``batch_id`` below ``path``, as one table: all batches and days."""
    return spark.read.schema(f"{schema}, day date, batch long").parquet(path)


def mark_significant(obs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """A new version of the observations with ``significant`` set for the given ids."""
    marks = ids.select(F.col(id_col)).distinct().withColumn("_mark", F.lit(True))
    old = F.col("significant") if "significant" in obs.columns else F.lit(None).cast("boolean")
    return (
        obs.join(broadcast_if_small(marks), id_col, "left")
        .withColumn("significant", F.coalesce("_mark", old, F.lit(False)))
        .drop("_mark")
    )


def export_exhibit(
    corpus: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    event_id: int,
    out: str,
    margin_us: int = 60_000_000,
    reference_clock: DataFrame | None = None,
    tolerance_us: int = 1_000,
    hops: int = 2,
    id_col: str = "particle_id",
    ts: str = "timestamp_us",
) -> DataFrame:
    """Bundle for one event: rows around it, hashes, confirmed times and its subgraph.

    Everything is written below ``out`` as separate tables; the manifest (part, rows) is
    written last and returned, so a bundle without one is incomplete.
    """
    spark = corpus.sparkSession
    event = corpus.where(F.col(id_col) == event_id).select(ts).first()
    if event is None:
        raise ValueError(f"no event {event_id}")
    rows = scrub(corpus, event[0] - margin_us, event[0] + margin_us + 1, ts)
    near = cut_lineage(neighbourhood(edges, f"event:{event_id}", hops)).select("id")
    ids = broadcast_if_small(near)
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    parts = {
        "corpus": rows,
        "nodes": nodes.join(ids, "id", "left_semi"),
        "edges": inner.select("src", "dst", "type", "ts"),
    }
    if "corpus_hash" in corpus.columns:
        parts["hashes"] = rows.select(id_col, ts, F.hex("corpus_hash").alias("corpus_hash"))
    if reference_clock is not None:
        window = scrub(reference_clock, event[0] - margin_us, event[0] + margin_us + 1, ts)
        parts["times"] = corroborated(rows, window, tolerance_us, ts).select(id_col, ts)
    manifest = []
    for name, frame in parts.items():
        frame.write.mode("errorifexists").parquet(f"{out}/{name}")
        manifest.append((name, spark.read.schema(frame.schema).parquet(f"{out}/{name}").count()))
    summary = spark.createDataFrame(manifest, "part string, rows long")
    summary.coalesce(1).write.mode("errorifexists").json(f"{out}/manifest")
    return summary


def tee(stream: DataFrame, path: str, handle, checkpoint: str):
    """Run ``handle(batch, batch_id)`` and keep a session copy of every batch.

    The batch is cached for its two uses and released; the copy is keyed by batch id.
    Returns the stream writer, not yet started.
    """

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
