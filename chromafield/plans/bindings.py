"""Views that give the driver tables the shape of sensor data, and the query registry.

No row is invented: every view is a projection of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafield.functions import freq_to_material_id
from chromafield.session import configure
from chromafield.sources.captures import is_folder

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


EVENTS_SCHEMA = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)


def shape_observations(events: DataFrame) -> DataFrame:
    """Projection of the events table, batch or stream, to the observation columns."""
    k = F.get_json_object("props", "$.k").cast("int")
    angle = F.lit(2.0) * F.pi() * F.col("k") / F.lit(100.0)
    layer = F.lit(4)
    for code, name in enumerate(("click", "view", "purchase", "signup")):
        layer = F.when(F.col("event_type") == name, code).otherwise(layer)
    base = events.select(
        F.col("event_id").alias("particle_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"),
        F.pmod(F.col("user_id"), F.lit(8)).cast("int").alias("sensor_id"),
        "user_id",
        layer.alias("layer"),
        (F.col("value") * F.lit(1e6)).alias("frequency_hz"),
        (F.col("value") / F.lit(500.0)).alias("energy"),
        k.alias("k"),
    )
    return base.withColumns(
        {
            "re": F.col("energy") * F.cos(angle),
            "im": F.col("energy") * F.sin(angle),
            "hue_class": freq_to_material_id(F.col("frequency_hz")),
            "x": F.pmod(F.col("k"), F.lit(10)).cast("double"),
            "y": F.floor(F.col("k") / 10).cast("double"),
            "z": F.col("sensor_id").cast("double"),
        }
    )


class Tables:
    """Lazily loaded tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        """Observations from ``events``."""
        return shape_observations(self.table("events"))

    @cached_property
    def obs_stream(self) -> DataFrame:
        """The same observations as a stream over the ``events`` file."""
        folder, glob = self.stream_location("events")
        reader = self.spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
        return shape_observations(reader.parquet(folder))

    def stream_location(self, name: str) -> tuple[str, str]:
        """(folder, file pattern) of a table: streams read folders, a table may be one file."""
        if is_folder(f"{self.dir}/{name}.parquet"):
            return f"{self.dir}/{name}.parquet", "*"
        return self.dir, f"{name}.parquet"

    @cached_property
    def windows(self) -> DataFrame:
        """Embedding windows with the first three dimensions as position."""
        return self.table("embeddings").select(
            "vec_id",
            "embedding",
            "label",
            *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")],
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def sensors(self) -> DataFrame:
        """Receivers: all suppliers (observations name the first eight)."""
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            s.cast("int").alias("sensor_id"),
            F.col("s_name").alias("name"),
            (s * 100.0).cast("double").alias("x"),
            F.col("s_nationkey").cast("double").alias("y"),
            F.lit(0.0).alias("z"),
        )

    @cached_property
    def lineitem(self) -> DataFrame:
        """Scale runs: one observation per line item."""
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("particle_id"),
            F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("timestamp_us"),
            F.pmod(F.col("l_suppkey"), F.lit(8)).cast("int").alias("sensor_id"),
            F.col("l_quantity").alias("energy"),
            F.col("l_extendedprice").alias("frequency_hz"),
            F.col("l_suppkey").alias("emitter"),
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_returnflag").alias("flag"),
        )


OBS_SQL = """obs AS (
  SELECT *, energy * cos(2.0 * pi() * k / 100.0) AS re, energy * sin(2.0 * pi() * k / 100.0) AS im,
    CASE WHEN frequency_hz > 0 THEN
      ((CAST(round(12 * log2(frequency_hz / 349.23)) AS BIGINT) + 5) % 12 + 12) % 12 END AS hue_class,
    CAST(k % 10 AS DOUBLE) AS x, floor(k / 10.0) AS y, CAST(sensor_id AS DOUBLE) AS z
  FROM (
    SELECT event_id AS particle_id, epoch_us(ts) AS timestamp_us, user_id % 8 AS sensor_id, user_id,
      CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2
        WHEN 'signup' THEN 3 ELSE 4 END AS layer,
      value * 1e6 AS frequency_hz, value / 500.0 AS energy,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events))"""

WIN_SQL = """win AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label, CAST(embedding[1] AS DOUBLE) AS x,
    CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""

SENSOR_SQL = """sensors AS (
  SELECT s_suppkey AS sensor_id, s_name AS name, CAST(s_suppkey * 100.0 AS DOUBLE) AS x,
    CAST(s_nationkey AS DOUBLE) AS y, 0e0 AS z FROM supplier)"""

LINE_SQL = """line AS (
  SELECT l_orderkey * 10 + l_linenumber AS particle_id, epoch_us(l_shipdate) AS timestamp_us,
    l_suppkey % 8 AS sensor_id, l_quantity AS energy, l_extendedprice AS frequency_hz,
    l_suppkey AS emitter, l_orderkey AS orderkey, l_returnflag AS flag FROM lineitem)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the floating columns, so that last-bit differences do not count."""
    return df.select(
        *[
            F.round(F.col(name).cast("double"), digits).alias(name)
            if kind in ("double", "float")
            else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def nudged(df: DataFrame, digits: int = 6) -> DataFrame:
    """Like ``rounded``, with exact decimal halves moved off the rounding edge first."""
    return df.select(
        *[
            F.round(F.col(name).cast("double") + 1e-10, digits).alias(name)
            if kind in ("double", "float")
            else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def query(name: str, covers: str, sql: str | None = None):
    """Register a query on ``Tables`` under ``name``; ``covers`` lists the inventory ids."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
