"""Set operations over streams, bins and packets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_streams(frames: Sequence[DataFrame]) -> DataFrame:
    """All sensor streams as one; columns a stream lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_dissent(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(consensus, dissent): disjoint and together everything."""
    dissents = F.col("dissenter").isNotNull()
    return verdicts.where(~dissents), verdicts.where(dissents)


def common_bins(df: DataFrame, bins: Sequence[str], sensor: str = "sensor_id", n: int | None = None):
    """Bins seen by all sensors (or by at least ``n``), with the number that saw each.

    One aggregation in place of a chain of intersects.
    """
    seen = df.groupBy(*bins).agg(F.count_distinct(sensor).alias("sensors"))
    if n is None:
        n = df.agg(F.count_distinct(sensor)).first()[0]
    return seen.where(F.col("sensors") >= n)


def bin_changes(before: DataFrame, after: DataFrame, bins: Sequence[str]) -> DataFrame:
    """Bins gained or lost between two sessions, by how many rows (multiset difference)."""
    both = before.select(*bins, F.lit(-1).alias("_d")).unionByName(
        after.select(*bins, F.lit(1).alias("_d"))
    )
    return (
        both.groupBy(*bins)
        .agg(F.sum("_d").alias("delta"))
        .where("delta <> 0")
        .withColumn("change", F.when(F.col("delta") > 0, "gained").otherwise("lost"))
    )


def dedupe(df: DataFrame, keys: Sequence[str], watermark: bool = False) -> DataFrame:
    """One row per packet key.  On a stream with a watermark the state is bounded by it."""
    if watermark:
        return df.dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))
