"""Row selections over the corpus."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromafield.functions.codec import mask_has
from chromafield.functions.text import corpus_day
from chromafield.schemas import LAYER_TOGGLES, LAYERS, PRESET_HALF_WIDTH_HZ
from chromafield.session import broadcast_if_small


def scrub(df: DataFrame, t0: int, t1: int, ts: str = "timestamp_us") -> DataFrame:
    """Rows with t0 <= ts < t1; prunes the ``day`` partitions where the table has them."""
    out = df.where((F.col(ts) >= t0) & (F.col(ts) < t1))
    if "day" in df.columns:
        out = out.where(
            F.col("day").between(corpus_day(F.lit(t0)), corpus_day(F.lit(t1)))
        )
    return out


def as_of(
    df: DataFrame, keys: Sequence[str], t: int, ts: str = "timestamp_us", tie: Sequence[str] = ()
) -> DataFrame:
    """State at time t: the last row per key, found without a sort (see ``last_rows``)."""
    from chromafield.operators.ordered import last_rows

    return last_rows(df.where(F.col(ts) <= t), keys, ts, tie)


def layers(df: DataFrame, toggles: Iterable[str], mask: str | None = None) -> DataFrame:
    """Keep the layers whose toggle letters (or layer names) are on."""
    codes = [LAYERS[LAYER_TOGGLES.get(t, t)] for t in toggles]
    if mask is None:
        return df.where(F.col("layer").isin(codes))
    keep = F.lit(False)
    for code in codes:
        keep = keep | mask_has(F.col(mask), code)
    return df.where(keep)


def region(
    df: DataFrame,
    center: Sequence[float],
    radius: float | None = None,
    box: Sequence[float] | None = None,
    pos: Sequence[str] = ("x", "y", "z"),
) -> DataFrame:
    """History of a place: a box, or a ball whose bounding box is tested first (pushable)."""
    half = [radius] * 3 if box is None else box
    out = df
    for name, mid, h in zip(pos, center, half):
        out = out.where((F.col(name) >= mid - h) & (F.col(name) <= mid + h))
    if radius is not None:
        d2 = sum(((F.col(n) - F.lit(m)) ** 2 for n, m in zip(pos, center)), start=F.lit(0.0))
        out = out.where(d2 <= radius * radius)
    return out


def connected(df: DataFrame, status: DataFrame, sensor: str = "sensor_id") -> DataFrame:
    """Rows of connected devices only; other branches go on untouched."""
    live = status.where("state = 'CONNECTED'").select(sensor)
    return df.join(broadcast_if_small(live), sensor, "left_semi")


def injection_flag(df: DataFrame, hi: float, lo: float) -> DataFrame:
    """High anomaly score with low divergence of the two scorers.

    Choice: both thresholds are arguments; the sources name no numbers.
    """
    return df.withColumn("injected", (F.col("anomaly_score") >= hi) & (F.col("divergence") <= lo))


def near_freq(
    df: DataFrame, f0: float, half_width: float = PRESET_HALF_WIDTH_HZ, f: str = "frequency_hz"
) -> DataFrame:
    return df.where(F.col(f).between(f0 - half_width, f0 + half_width))


__all__ = [
    "as_of",
    "connected",
    "injection_flag",
    "layers",
    "near_freq",
    "region",
    "scrub",
]
