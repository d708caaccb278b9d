"""Aggregations: coherence, meters, verdicts, densities and quality figures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.functions.codec import mask_bits
from chromafield.functions.vectors import l2
from chromafield.operators.joins import asof_join
from chromafield.operators.ordered import (
    lag_rows,
    pane_width,
    plan_width,
    running_moments,
    slice_of,
    with_moments,
)
from chromafield.operators.spatial import candidate_pairs
from chromafield.session import broadcast_if_small, store_table


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def coherence_of(re: Column, im: Column) -> Column:
    """|sum E| / sum |E| as an aggregate expression; 0/0 is null."""
    return F.try_divide(magnitude(F.sum(re), F.sum(im)), F.sum(magnitude(re, im)))


def phase_coherence(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Coherence and row count per key, e.g. per frequency bin and cell."""
    return df.groupBy(*keys).agg(
        coherence_of(F.col("re"), F.col("im")).alias("gamma"), F.count("*").alias("n")
    )


def carrier_variance(
    df: DataFrame,
    carrier: Sequence[str],
    window_us: int,
    eps: float,
    ts: str = "timestamp_us",
) -> DataFrame:
    """Variance over time of a carrier's coherence; near zero means a held, synthetic phase.

    Choice: population variance, and ``eps`` is an argument.  Two aggregation levels.
    """
    per_window = phase_coherence(df, [*carrier, slice_of(F.col(ts), window_us).alias("_w")])
    return (
        per_window.groupBy(*carrier)
        .agg(
            F.count("gamma").alias("windows"),
            F.avg("gamma").alias("mean_gamma"),
            F.var_pop("gamma").alias("carrier_variance"),
        )
        .withColumn("injected", F.col("carrier_variance") < eps)
    )


def level_meter(
    df: DataFrame,
    keys: Sequence[str],
    window_us: int = 100_000,
    value: str = "i",
    ts: str = "timestamp_us",
    full_scale: float = 1.0,
) -> DataFrame:
    """Peak per window as a fraction of full scale, with a clipping flag."""
    return (
        df.groupBy(*keys, slice_of(F.col(ts), window_us).alias("window"))
        .agg((F.max(F.abs(value)) / F.lit(full_scale)).alias("peak"))
        .withColumn("clipped", F.col("peak") >= 1.0)
    )


def rx_meter(
    df: DataFrame,
    keys: Sequence[str],
    f0: float,
    window_us: int = 100_000,
    half_width: float = 500e3,
    ts: str = "timestamp_us",
    f: str = "frequency_hz",
) -> DataFrame:
    """Signal power per window and the strongest frequency within the tuned span."""
    power = F.col("re") ** 2 + F.col("im") ** 2
    near = F.col(f).between(f0 - half_width, f0 + half_width)
    return df.groupBy(*keys, slice_of(F.col(ts), window_us).alias("window")).agg(
        F.avg(power).alias("power"),
        F.max_by(F.when(near, F.col(f)), F.when(near, F.struct(power, F.col(f)))).alias("peak_hz"),
    )


VOTERS = ("gpu_score", "coral_score", "tdoa_confidence")


def verdict(votes: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Majority and dissent of up to three voters; scores are never averaged.

    Adds ``yes_votes``, ``n_votes``, ``anomalous``, ``dissenter`` (voter number or null),
    ``divergence`` and ``jury_flags``: bit 0 unanimous, bit 1 dissent, bits 2-4 the
    dissenting voter, bit 5 a voter missing.  Choice: the cut-offs are arguments.
    """
    says = [F.col(c) >= t for c, t in zip(VOTERS, thresholds)]
    yes = sum((F.coalesce(s.cast("int"), F.lit(0)) for s in says), start=F.lit(0))
    n = sum((F.col(c).isNotNull().cast("int") for c in VOTERS), start=F.lit(0))
    out = votes.withColumns({"yes_votes": yes, "n_votes": n})
    out = out.withColumn("anomalous", F.col("yes_votes") * 2 > F.col("n_votes"))
    lone = F.when(F.col("n_votes") == 3, F.when(F.col("yes_votes") == 1, True).when(F.col("yes_votes") == 2, False))
    dissenter = F.coalesce(*[F.when(s == lone, F.lit(i)) for i, s in enumerate(says)])
    out = out.withColumns(
        {"dissenter": dissenter, "divergence": F.abs(F.col("gpu_score") - F.col("coral_score"))}
    )
    unanimous = (F.col("n_votes") == 3) & F.col("yes_votes").isin(0, 3)
    flags = (
        F.when(unanimous, 1).otherwise(0)
        + F.when(F.col("dissenter").isNotNull(), 2).otherwise(0)
        + F.coalesce(F.call_function("shiftleft", F.lit(4), F.col("dissenter")), F.lit(0))
        + F.when(F.col("n_votes") < 3, 32).otherwise(0)
    )
    return out.withColumn("jury_flags", flags)


def entity_anomaly(
    df: DataFrame,
    entity: Sequence[str],
    ts: str = "timestamp_us",
    actual: str = "embedding",
    predicted: str | None = None,
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Deviation from prediction over the spread of that entity's own earlier deviations.

    The prediction is an input column; without one the entity's previous embedding is
    used.  The spread is the population deviation of all earlier deviations; it needs two
    of them and is null before.
    """
    out = df
    if width is None:
        width = plan_width(df, entity, ts)
    if predicted is None:
        out = lag_rows(df, entity, ts, [actual], tie, width)
        predicted = f"prev_{actual}"
    out = out.withColumn("deviation", l2(F.col(predicted), F.col(actual)))
    out = running_moments(out, entity, ts, "deviation", tie, width)
    out = out.withColumn("sigma", F.when(F.col("past_n") >= 2, F.col("past_sd")))
    drop = ["past_n", "past_mean", "past_sd", f"prev_{actual}"]
    return out.withColumn("anomaly_score", F.try_divide("deviation", "sigma")).drop(*drop)


def step_changes(
    df: DataFrame,
    value: str,
    span_us: int,
    min_sigma: float,
    keys: Sequence[str] = (),
    ts: str = "timestamp_us",
    env: DataFrame | None = None,
    env_col: str | None = None,
    width: int | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Rows where the mean after departs from the mean before by ``min_sigma`` deviations.

    A departure from a constant level of two rows or more counts as infinitely many.

    With ``env`` given, the correlation of value and environment over the same span is
    attached: an empty or weak ``env_corr`` means the change was not environmental.
    """
    frames = {"before": (-span_us, -1), "after": (0, span_us - 1)}
    base = df if env is None else asof_join(df, env.select(ts, env_col), ts, tie=tie, width=width)
    if width is None:
        width = pane_width(df, keys, ts, frames)  # on the plain input
    out = with_moments(base, keys, ts, value, frames, width, None if env is None else f"env_{env_col}")
    if env is not None:
        parts = ("pairs", "pn", "px", "pe", "xx", "ee", "xe")
        before, after = ({k: F.col(f"{side}_{k}") for k in parts} for side in frames)
        n = before["pn"] + after["pn"]
        both = (before["pn"] > 0) & (after["pn"] > 0)
        gap = {k: F.when(both, after[k] - before[k]).otherwise(0.0) for k in ("px", "pe")}
        share = F.coalesce(F.try_divide(before["pn"] * after["pn"], n), F.lit(0.0))
        xx, ee, xe = (
            before[k] + after[k] + gap[left] * gap[right] * share
            for k, left, right in (("xx", "px", "px"), ("ee", "pe", "pe"), ("xe", "px", "pe"))
        )
        # a side that does not vary, or is not finite, has no correlation
        sound = (before["pairs"] + after["pairs"] == n) & (xx > 0) & (ee > 0)
        corr = F.when(sound, F.try_divide(xe, F.sqrt(xx) * F.sqrt(ee)))
        out = out.withColumn("env_corr", corr).drop(*[f"{side}_{k}" for side in frames for k in parts])
    out = out.withColumnsRenamed(
        {"before_mean": "mean_before", "after_mean": "mean_after", "before_sd": "sd_before"}
    ).drop("after_n", "after_sd")
    shift = F.abs(F.col("mean_after") - F.col("mean_before"))
    # a jump from a constant level departs by any number of deviations
    steady = (F.col("sd_before") == 0) & (F.col("before_n") > 1)
    endless = F.when(steady & (shift > 0), float("inf"))
    out = out.withColumn("sigmas", F.coalesce(F.try_divide(shift, F.col("sd_before")), endless))
    return out.drop("before_n").where(F.col("sigmas") >= min_sigma)


def distribution(df: DataFrame, dims: Sequence[str], mode: str = "rollup") -> DataFrame:
    """Counts by dimension with subtotals; ``mode`` is rollup, cube or sets (each alone)."""
    if mode == "rollup":
        grouped = df.rollup(*dims)
    elif mode == "cube":
        grouped = df.cube(*dims)
    else:
        grouped = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def link_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loss and jitter profile; bad packets are features and stay in."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("packets"),
        F.sum("packet_loss_count").alias("lost"),
        F.avg("jitter_us").alias("jitter_mean"),
        F.stddev_pop("jitter_us").alias("jitter_sd"),
        F.max("jitter_us").alias("jitter_max"),
        F.percentile_approx("jitter_us", F.lit(0.95)).alias("jitter_p95"),
    )


def clock_drift(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Slope, offset and worst residual of one clock against the other, per key.

    Times are taken relative to the earliest one, so microsecond epochs keep their digits.
    """
    keys = list(keys)
    origin = pairs.agg(F.min("a_us")).first()[0]
    local = pairs.select(
        *(keys or [F.lit(0).alias("_all")]),
        (F.col("a_us") - F.lit(origin)).cast("double").alias("_a"),
        (F.col("b_us") - F.lit(origin)).cast("double").alias("_b"),
    )
    by = keys or ["_all"]
    fit = local.groupBy(*by).agg(
        F.regr_slope("_b", "_a").alias("slope"),
        F.regr_intercept("_b", "_a").alias("offset_us"),
        F.count("*").alias("n"),
    )
    residual = F.abs(F.col("_b") - (F.col("slope") * F.col("_a") + F.col("offset_us")))
    worst = (
        local.join(broadcast_if_small(fit), by)
        .groupBy(*by)
        .agg(F.max(residual).alias("max_residual_us"))
    )
    return fit.join(worst, by).drop("_all")


def evm(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error vector magnitude in dB per key: received (rx) against reference (ref) symbols.

    Without any error it is minus infinity; without reference power it is null.
    """
    err = (F.col("rx_re") - F.col("ref_re")) ** 2 + (F.col("rx_im") - F.col("ref_im")) ** 2
    ref = F.col("ref_re") ** 2 + F.col("ref_im") ** 2
    ratio = F.try_divide(F.sum(err), F.sum(ref))
    return df.groupBy(*keys).agg(
        F.when(ratio > 0, F.lit(10.0) * F.log10(ratio))
        .when(ratio == 0, float("-inf"))
        .alias("evm_db"),
        F.count("*").alias("n"),
    )


def symbol_error_rate(
    df: DataFrame, keys: Sequence[str], tx: str = "tx", rx: str = "rx"
) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg((F.col(tx) != F.col(rx)).cast("int")).alias("ser"), F.count("*").alias("n")
    )


def delay_spread(
    paths: DataFrame,
    keys: Sequence[str],
    delay_ns: str = "delay_ns",
    power: str = "power",
    bin_ns: float = 1.0,
    lo_ns: float = 1.0,
    hi_ns: float = 50.0,
) -> DataFrame:
    """Histogram of path delays over the room-sized range, and the power-weighted RMS spread."""
    d, p = F.col(delay_ns), F.col(power)
    hist = (
        paths.where(d.between(lo_ns, hi_ns))
        .groupBy(*keys, F.floor(d / F.lit(bin_ns)).alias("bin"))
        .agg(
            F.count("*").alias("paths"),
            F.sum(p).alias("_p"),
            F.sum(p * d).alias("_pd"),
            F.sum(p * d * d).alias("_pdd"),
        )
    )
    whole = Window.partitionBy(*keys)  # at most (hi - lo) / bin rows per key

    def total(c: str) -> Column:
        return F.sum(c).over(whole)

    mean = F.try_divide(total("_pd"), total("_p"))
    spread = F.sqrt(F.greatest(F.try_divide(total("_pdd"), total("_p")) - mean * mean, F.lit(0.0)))
    return hist.withColumn("rms_spread_ns", spread).drop("_p", "_pd", "_pdd")


def occupancy(
    df: DataFrame,
    n: int,
    bounds: Sequence[float],
    x: str = "x",
    y: str = "y",
    ts: str | None = None,
    span_us: int | None = None,
) -> DataFrame:
    """Counts on an n x n grid (4 quadrants are n = 2); with ``ts`` also the change in time."""
    x0, x1, y0, y1 = bounds

    def cell(c: str, lo: float, hi: float) -> Column:
        at = F.floor((F.col(c) - F.lit(lo)) / F.lit((hi - lo) / n))
        return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))

    keys = [cell(x, x0, x1).alias("gx"), cell(y, y0, y1).alias("gy")]
    if ts is None:
        return df.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = df.groupBy(*keys, slice_of(F.col(ts), span_us).alias("window")).agg(
        F.count("*").alias("n")
    )
    # one row per cell and window: far smaller than the input
    before = F.lag("n").over(Window.partitionBy("gx", "gy").orderBy("window"))
    return counts.withColumn("dn", F.col("n") - F.coalesce(before, F.lit(0)))


def sensor_mask(df: DataFrame, keys: Sequence[str], sensor: str = "sensor_id") -> DataFrame:
    """Bit mask of the contributing sensors per key."""
    return df.groupBy(*keys).agg(F.bit_or(mask_bits(F.col(sensor))).alias("sensor_id_mask"))


def patch_gaussian(
    df: DataFrame, keys: Sequence[str], pos: Sequence[str] = ("x", "y", "z")
) -> DataFrame:
    """Mean position and six covariances per patch.  Choice: population covariance."""
    x, y, z = pos
    pairs = [(x, x), (x, y), (x, z), (y, y), (y, z), (z, z)]
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(p) for p in pos]).alias("position"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covariance"),
    )


def probe_baseline(
    df: DataFrame, keys: Sequence[str] = ("probe", "domain"), score: str = "score"
) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("sigma"), F.count("*").alias("n")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of entity and relation types, and of nodes and edges."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    kinds = nodes.select(F.lit("node").alias("part"), "type").unionByName(
        edges.select(F.lit("edge").alias("part"), "type")
    )
    return kinds.groupBy("part").agg(distinct("type").alias("types"), F.count("*").alias("n"))


def weekly_synthesis(
    notes: DataFrame, n: int = 5, ts: str = "timestamp_us", tags: str = "tags", topic: str = "topic"
) -> DataFrame:
    """Weekly line for each tag carried by at least ``n`` notes: "Observed X instances of Y"."""
    week = F.date_trunc("week", F.timestamp_micros(F.col(ts)))
    return (
        notes.select(week.alias("_week"), F.explode(tags).alias("tag"))
        .groupBy("_week", "tag")
        .agg(F.count("*").alias("notes"))
        .where(F.col("notes") >= n)
        .select(
            F.unix_micros("_week").alias("week_us"),
            "tag",
            "notes",
            F.format_string("Observed %d instances of %s", F.col("notes"), F.col("tag")).alias("line"),
        )
    )


#: rows of one side of a tile of similarities
TILE_ROWS = 1024


def nt_xent(
    emb: DataFrame,
    tau: float,
    batch: str = "batch",
    label: str = "label",
    vec: str = "embedding",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Contrastive loss per batch of any size: mean over positive pairs of -log softmax similarity.

    A batch is dealt into tiles of about ``tile_rows`` rows.  Every pair of tiles is one group: it
    gives each row its greatest similarity there, the sum of exponentials relative to it, and the
    sum over its positive partners.  These merge associatively, so no task holds more than one
    tile of the matrix.  Rows without a positive partner do not count, rows without a label or a
    vector take no part, and a zero vector is similar to nothing.
    """
    rows = store_table(
        emb.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(batch).alias("_b"),
            F.col(label).cast("string").alias("_l"),
            F.col(vec).cast("array<double>").alias("_v"),
        ),
        "contrastive",
    )
    # one row per batch
    tiles = rows.groupBy("_b").agg(F.ceil(F.count("*") / F.lit(float(tile_rows))).cast("int").alias("_n"))
    dealt = rows.join(
        tiles.withColumnRenamed("_b", "_k"), F.col("_b").eqNullSafe(F.col("_k"))
    ).drop("_k").withColumn("_t", F.expr("cast(pmod(xxhash64(_row), _n) as int)"))
    other = F.explode(F.expr("sequence(0, _n - 1)"))
    paired = dealt.select("_b", "_row", "_l", "_v", "_t", other.alias("_o")).withColumns(
        {"_p": F.least("_t", "_o"), "_q": F.greatest("_t", "_o")}
    )

    def tile(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["_v"].to_numpy()).astype(np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(size > 0, size, 1.0)
        side, label_of = pdf["_t"].to_numpy(), pdf["_l"].to_numpy()
        out = []
        for a, b in {(key[1], key[2]), (key[2], key[1])}:
            left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
            if not len(left) or not len(right):
                continue
            sim = x[left] @ x[right].T / tau
            same = label_of[left][:, None] == label_of[right][None, :]
            if a == b:
                np.fill_diagonal(same, False)
            near = np.where(same, sim, 0.0).sum(axis=1)
            if a == b:
                np.fill_diagonal(sim, -np.inf)
            top = sim.max(axis=1)
            with np.errstate(invalid="ignore"):
                total = np.where(np.isfinite(top), np.exp(sim - top[:, None]).sum(axis=1), 0.0)
            out.append(
                pd.DataFrame(
                    {
                        "_b": [key[0]] * len(left),
                        "_row": pdf["_row"].to_numpy()[left],
                        "top": np.where(np.isfinite(top), top, -1e300),
                        "total": total,
                        "near": near,
                        "pairs": same.sum(axis=1),
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=["_b", "_row", "top", "total", "near", "pairs"])

    dtype = emb.schema[batch].dataType.simpleString()
    parts = paired.groupBy("_b", "_p", "_q").applyInPandas(
        tile, f"_b {dtype}, _row long, top double, total double, near double, pairs long"
    )
    # as many entries per row as its batch has tiles
    merged = parts.groupBy("_b", "_row").agg(
        F.max("top").alias("top"),
        F.collect_list(F.struct("top", "total")).alias("parts"),
        F.sum("near").alias("near"),
        F.sum("pairs").alias("pairs"),
    )
    log_sum = F.expr("top + ln(aggregate(parts, 0D, (a, p) -> a + p.total * exp(p.top - top)))")
    loss = F.when(F.col("pairs") > 0, F.col("pairs") * log_sum - F.col("near"))
    return merged.groupBy(F.col("_b").alias(batch)).agg(
        F.sum("pairs").alias("pairs"), F.try_divide(F.sum(loss), F.sum("pairs")).alias("loss")
    )


def field_at(
    points: DataFrame,
    paths: DataFrame,
    f: float,
    sigma: float,
    point_id: str = "point_id",
    tolerance: float = 1e-12,
) -> DataFrame:
    """Weighted coherence at query points: terms w * A * exp(j(phi - k r)) / r^2.

    The footprint weight is w = exp(-r^2 / 2 sigma^2).  It is cut at the reach where it falls to
    ``tolerance``, so points and paths meet by cells as wide as the reach, and neither side has
    to be small.  ``left_out`` bounds the sum of the amplitudes of all terms beyond the reach.
    Paths at one position are summed before they are paired.  A path at the point itself has no
    finite term and is left out; a point that nothing reaches has n = 0, field 0 and no gamma.
    """
    from chromafield.schemas import SPEED_OF_LIGHT

    reach = sigma * math.sqrt(2 * math.log(1 / tolerance))
    k = 2 * math.pi * f / SPEED_OF_LIGHT
    spots = paths.groupBy("x", "y", "z").agg(
        F.sum(F.col("amplitude") * F.cos("phase")).alias("re"),
        F.sum(F.col("amplitude") * F.sin("phase")).alias("im"),
        F.sum(F.abs("amplitude")).alias("size"),
        F.count(F.lit(1)).alias("n"),
    )
    asked = points.select(F.col(point_id).alias("id"), "x", "y", "z")
    near = candidate_pairs(asked, spots, reach, ["id", "x", "y", "z"], ["x", "y", "z", "re", "im", "size", "n"])
    weight = F.exp(-F.col("d2") / F.lit(2 * sigma * sigma)) / F.col("d2")
    turn = F.lit(k) * F.sqrt("d2")
    sums = (
        near.where("d2 > 0")
        .withColumns({"_w": weight, "_c": F.cos(turn), "_s": F.sin(turn)})
        .groupBy(F.col("a_id").alias("_id"))
        .agg(
            F.sum(F.expr("_w * (b_re * _c + b_im * _s)")).alias("_re"),
            F.sum(F.expr("_w * (b_im * _c - b_re * _s)")).alias("_im"),
            F.sum(F.expr("_w * b_size")).alias("_all"),
            F.sum("b_size").alias("_size"),
            F.sum("b_n").alias("_n"),
        )
    )
    # one row: the amplitudes of all paths
    total = spots.agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("_total"))
    field = magnitude(F.coalesce("_re", F.lit(0.0)), F.coalesce("_im", F.lit(0.0)))
    rest = F.col("_total") - F.coalesce("_size", F.lit(0.0))
    return (
        asked.select(F.col("id").alias(point_id))
        .join(sums, F.col(point_id) == F.col("_id"), "left")
        .join(F.broadcast(total))
        .select(
            point_id,
            F.try_divide(field, F.col("_all")).alias("gamma"),
            field.alias("field"),
            F.coalesce("_n", F.lit(0)).cast("long").alias("n"),
            (F.greatest(rest, F.lit(0.0)) * (tolerance / reach**2)).alias("left_out"),
        )
    )
