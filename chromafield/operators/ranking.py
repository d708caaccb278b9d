"""Top-k, count windows, traversal orders and farthest-point sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromafield.functions.color import octave_fold
from chromafield.functions.vectors import cosine
from chromafield.operators.ordered import plan_width, row_index
from chromafield.session import broadcast_if_small, cut_lineage


def top_energy(
    df: DataFrame,
    n: int = 4096,
    batch: Sequence[str] = (),
    energy: str = "energy",
    tie: str = "particle_id",
) -> DataFrame:
    """Strongest n rows, overall or per batch.

    Both forms cut to n rows per task before the exchange (TakeOrdered, or the window's
    group limit), so a hot batch ships n rows per task, not its whole content.
    """
    order = [F.desc(energy), F.asc(tie)]
    if not batch:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*batch).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def query_semantic(
    query: Sequence[float], obs: DataFrame, k: int = 5, vec: str = "embedding", tie: str = "vec_id"
) -> DataFrame:
    """k most similar observations by cosine: one scan, k rows per task to the driver side."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return (
        obs.withColumn("similarity", cosine(F.col(vec), q))
        .where("similarity IS NOT NULL")
        .orderBy(F.desc("similarity"), F.asc(tie))
        .limit(k)
    )


def dominant_bins(
    spectrum: DataFrame,
    n: int,
    keys: Sequence[str] = ("sensor_id", "window"),
    power: str = "power",
    f: str = "frequency_hz",
) -> DataFrame:
    """The n strongest bins per window, folded into the audible range: a chord."""
    w = Window.partitionBy(*keys).orderBy(F.desc(power), F.asc(f))
    return (
        spectrum.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .withColumn("tone_hz", octave_fold(F.col(f)))
    )


def count_windows(
    df: DataFrame,
    n: int = 4096,
    keys: Sequence[str] = ("sensor_id",),
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Number rows per sensor and group them by n: adds ``window`` and ``offset`` (0-based)."""
    out = row_index(df, keys, ts, tie, width, "_i")
    at = F.col("_i") - 1
    return out.withColumns(
        {"window": F.floor(at / F.lit(n)).cast("long"), "offset": F.pmod(at, F.lit(n)).cast("int")}
    ).drop("_i")


def traversals(
    patches: DataFrame,
    vectors: Sequence[str] = ("v1", "v2", "v3", "v4"),
    keys: Sequence[str] = ("frame",),
    tie: str = "patch",
    scale: float = 1e9,
    width: int | None = None,
) -> DataFrame:
    """Each patch's place in the eight orders (each eigenvector forward and reverse).

    Orders come from the sliced row index over the fixed-point vector value, so one large
    frame is sorted by many tasks.  Reverse places are counted from the frame's total.
    """
    out = patches.withColumns(
        {f"_q_{v}": F.round(F.col(v) * F.lit(scale)).cast("long") for v in vectors}
    )
    # planned on the plain input, before the scans stack up
    widths = {v: width or plan_width(out, keys, f"_q_{v}") for v in vectors}
    for v in vectors:
        size = {"_n": ("sum", F.lit(1).cast("long"))} if v == vectors[-1] else None
        out = row_index(out, keys, f"_q_{v}", [tie], widths[v], f"_fwd_{v}", size).drop(f"_q_{v}")
    streams = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(2 * i + rev).alias("stream"),
                    (
                        F.col("_n") + 1 - F.col(f"_fwd_{v}") if rev else F.col(f"_fwd_{v}")
                    ).alias("place"),
                )
                for i, v in enumerate(vectors)
                for rev in (0, 1)
            ]
        )
    )
    return out.select(*keys, tie, streams.alias("_s")).select(*keys, tie, "_s.stream", "_s.place")


def farthest_points(
    df: DataFrame,
    m: int,
    frame: str = "frame",
    pos: Sequence[str] = ("x", "y", "z"),
    tie: str = "particle_id",
) -> DataFrame:
    """m spread-out points per frame, starting from the lowest id.

    Each round is one aggregation over all frames at once: the point farthest from the
    picks so far (ties: lowest id).  Only the picks, one short array per frame, pass from
    round to round, and they are checkpointed, so a huge frame is never in one task.
    """
    first = F.struct(F.col(tie).alias("id"), *[F.col(p).cast("double").alias(p) for p in pos])
    picks = df.groupBy(frame).agg(F.array(F.min_by(first, tie)).alias("picks"))
    picks = cut_lineage(picks)

    def distance2(p):
        return sum(((F.col(c) - p[c]) ** 2 for c in pos), start=F.lit(0.0))

    for _ in range(1, m):
        near = F.array_min(F.transform("picks", distance2))
        chosen = (
            df.join(broadcast_if_small(picks), frame)
            .where(~F.exists("picks", lambda p: p["id"] == F.col(tie)))
            .groupBy(frame)
            .agg(F.max_by(first, F.struct(near, -F.col(tie))).alias("_next"))
        )
        picks = cut_lineage(
            picks.join(broadcast_if_small(chosen), frame, "left").select(
                frame,
                F.when(F.col("_next").isNull(), F.col("picks"))
                .otherwise(F.concat("picks", F.array("_next")))
                .alias("picks"),
            )
        )
    return picks.select(frame, F.posexplode("picks").alias("pick", "_p")).select(
        frame, "pick", F.col("_p.id").alias(tie), *[F.col(f"_p.{c}").alias(c) for c in pos]
    )


def qam_ceiling(evm: DataFrame, limit_db: float = -30.0, keys: Sequence[str] = ()) -> DataFrame:
    """Highest constellation order whose error vector magnitude is below the limit."""
    return (
        evm.where(F.col("evm_db") < limit_db)
        .groupBy(*keys)
        .agg(F.max("qam_order").alias("qam_ceiling"), F.max_by("evm_db", "qam_order").alias("evm_db"))
    )
