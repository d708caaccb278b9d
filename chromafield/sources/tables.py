"""Text and table sources: JSONL corpus, catalogue, CSI matrices, notes and streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.functions.text import parse_capture_name, parse_note
from chromafield.operators.sets import union_streams
from chromafield.schemas import PARTICLE
from chromafield.session import broadcast_if_small
from chromafield.sources.captures import guard_path

_WITH_CORRUPT = T.StructType(PARTICLE.fields + [T.StructField("_corrupt", T.StringType())])


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Particles from JSON lines; a corrupt line stays, with its text in ``_corrupt``.

    An empty corpus is an error: downstream jobs must halt, not run on nothing.
    """
    guard_path(path)
    df = (
        spark.read.schema(_WITH_CORRUPT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    if df.isEmpty():
        raise ValueError(f"empty corpus: {path}")
    return df


def capture_catalog(spark: SparkSession, path: str, rate: float, glob: str = "*.{iq,cf32}") -> DataFrame:
    """Size, sample count, duration and validity of each I/Q capture; contents are not read."""
    guard_path(path)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    allowed = files.where(~F.col("path").rlike("/(tests|examples)/"))
    samples = F.floor(F.col("length") / 8)
    return allowed.select(
        "path",
        parse_capture_name(F.col("path")).alias("name"),
        F.col("length").alias("bytes"),
        samples.alias("samples"),
        (samples / F.lit(float(rate))).alias("duration_s"),
        (F.col("length") % 8 == 0).alias("valid"),
    )


def csi_points(df: DataFrame, h: str = "h", keep: Sequence[str] = ("packet_id", "timestamp_us")) -> DataFrame:
    """Channel matrices as points: one row per (packet, subcarrier) with its complex gain.

    ``h`` is an array of (re, im) structs, 52 per packet on common receivers.
    """
    return df.select(*keep, F.posexplode(h).alias("subcarrier", "_g")).select(
        *keep, "subcarrier", F.col("_g.re").alias("re"), F.col("_g.im").alias("im")
    )


def ingest(
    spark: SparkSession,
    sources: Mapping[str, tuple | DataFrame],
    fmt: str = "parquet",
    max_files: int = 1000,
) -> DataFrame:
    """One stream per device, merged into one channel; nothing is preprocessed.

    ``sources`` maps a device to a stream (such as ``captures.stream_records`` over the folder
    that its recorder writes to), or to (folder, schema) or (folder, schema, file pattern) of
    table files.  Columns a device lacks are null, and ``source`` names the device.
    """
    streams = []
    for name, given in sources.items():
        if isinstance(given, DataFrame):
            if not given.isStreaming:
                raise ValueError(f"{name} is not a stream")
            streams.append(given.withColumn("source", F.lit(name)))
            continue
        path, schema, *glob = given
        guard_path(path)
        stream = (
            spark.readStream.schema(schema)
            .format(fmt)
            .option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", glob[0] if glob else "*")
            .load(path)
        )
        streams.append(stream.withColumn("source", F.lit(name)))
    return union_streams(streams)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes with front matter: one row per file."""
    guard_path(path)
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", parse_note(F.col("value")).alias("n")).select("path", "n.*")


def note_refs(notes: DataFrame, observations: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(path, timestamp, obs_id) per reference; with ``observations`` only those that exist."""
    refs = notes.select("path", "timestamp", F.explode("obs_ids").alias("obs_id")).withColumn(
        "obs_id", F.col("obs_id").try_cast("long")
    )
    if observations is None:
        return refs
    # the notes are the small side by far, so they are what may be broadcast
    known = observations.select(F.col(id_col).alias("obs_id")).join(
        broadcast_if_small(refs.select("obs_id").distinct()), "obs_id", "left_semi"
    )
    return refs.join(known.distinct(), "obs_id", "left_semi")


def query_notes(
    notes: DataFrame,
    text: str | None = None,
    tag: str | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Notes by substring of the body, tag and ISO time range."""
    out = notes
    if text is not None:
        out = out.where(F.contains(F.lower("body"), F.lit(text.lower())))
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if since is not None:
        out = out.where(F.col("timestamp") >= since)
    if until is not None:
        out = out.where(F.col("timestamp") < until)
    return out
