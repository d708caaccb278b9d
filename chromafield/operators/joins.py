"""Temporal, dimension and set-like joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.functions.codec import block_hash, hash_prefix
from chromafield.functions.color import freq_to_material_id
from chromafield.functions.physics import fresnel_r
from chromafield.operators.ordered import lag_rows, nearest_before, plan_width, slice_of
from chromafield.schemas import BANDS, MATERIALS, SPEED_OF_LIGHT
from chromafield.session import broadcast_if_small


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    tolerance: int | None = None,
    tie: Sequence[str] = (),
    width: int | None = None,
    prefix: str = "env_",
) -> DataFrame:
    """Latest right row at or before each left row, within ``tolerance``; left rows are kept."""
    cols = [c for c in right.columns if c != on and c not in by]
    out = nearest_before(left, right, on, by, cols, tie, width)
    hit = F.col("_match")
    if tolerance is not None:
        hit = F.when(F.col(on) - hit[on] <= tolerance, hit)
    return out.withColumn("_match", hit).select(
        *left.columns,
        F.col("_match")[on].alias(f"{prefix}{on}"),
        *[F.col("_match")[c].alias(f"{prefix}{c}") for c in cols],
    )


def with_sensor(df: DataFrame, sensors: DataFrame, on: str = "sensor_id") -> DataFrame:
    """Receiver position and device of each row; the dimension is broadcast if small."""
    return df.join(broadcast_if_small(sensors), on, "left")


def bands_frame(spark) -> DataFrame:
    return spark.createDataFrame(BANDS, "band string, lo_hz double, hi_hz double")


def band_join(df: DataFrame, bands: Sequence[tuple] = BANDS, f: str = "frequency_hz") -> DataFrame:
    """One row per matching band; bands overlap, so a row may match several.

    The band list is a constant of the library, so it is an inline array: no join at all.
    """
    freq = F.col(f)
    hits = F.array_compact(
        F.array(
            *[F.when((freq >= lo) & (freq < hi), F.lit(name)) for name, lo, hi in bands]
        )
    )
    return df.withColumn("band", F.explode(hits))


def clock_pairs(
    a: DataFrame,
    b: DataFrame,
    tol_us: int,
    ts: str = "timestamp_us",
    id_col: str = "particle_id",
    by: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Nearest row of clock ``b`` for each row of clock ``a`` within the tolerance.

    Two linear scans (backward and forward) replace the pairing of near rows; equal
    distance prefers the earlier row.
    """
    slim_a = a.select(*by, F.col(id_col).alias("a_id"), F.col(ts))
    slim_b = b.select(*by, F.col(id_col).alias("b_id"), F.col(ts))
    if width is None:
        width = plan_width(slim_a.select(*by, ts).unionByName(slim_b.select(*by, ts)), by, ts)
    back = nearest_before(slim_a, slim_b, ts, by, ["b_id"], ["b_id"], width, False, "_back")
    both = nearest_before(back, slim_b, ts, by, ["b_id"], ["b_id"], width, True, "_fwd")
    d_back = F.col(ts) - F.col("_back")[ts]
    d_fwd = F.col("_fwd")[ts] - F.col(ts)
    pick = F.when(
        F.col("_fwd").isNull() | (d_back <= d_fwd), F.col("_back")
    ).otherwise(F.col("_fwd"))
    return (
        both.withColumn("_hit", pick)
        .where(F.abs(F.col("_hit")[ts] - F.col(ts)) <= tol_us)
        .select(
            *by,
            "a_id",
            F.col("_hit")["b_id"].alias("b_id"),
            F.col(ts).alias("a_us"),
            F.col("_hit")[ts].alias("b_us"),
            (F.col("_hit")[ts] - F.col(ts)).alias("divergence_us"),
        )
    )


def corroborated(
    df: DataFrame,
    ref: DataFrame,
    tol_us: int,
    ts: str = "timestamp_us",
    id_col: str = "particle_id",
    width: int | None = None,
) -> DataFrame:
    """Rows that a second clock confirms within the tolerance (the semi-join form of pairs).

    Both nearest rows ride along the scan, so no join back on the id is needed.
    """
    slim_ref = ref.select(ts)
    if width is None:
        width = plan_width(df.select(ts).unionByName(slim_ref), [], ts)
    out = nearest_before(df, slim_ref, ts, [], [], [], width, False, "_back")
    out = nearest_before(out, slim_ref, ts, [], [], [], width, True, "_fwd")
    near = (F.col(ts) - F.col("_back")[ts] <= tol_us) | (F.col("_fwd")[ts] - F.col(ts) <= tol_us)
    return out.where(F.coalesce(near, F.lit(False))).select(*df.columns)


def collect_votes(
    a: DataFrame, b: DataFrame, c: DataFrame, keys: Sequence[str], score: str = "score"
) -> DataFrame:
    """Three voters side by side, a missing voter null: one union and one shuffle.

    Several scores of a voter for one key are reduced to their mean before the shuffle.
    """
    tagged = None
    for voter, frame in enumerate((a, b, c)):
        part = frame.select(*keys, F.lit(voter).alias("_voter"), F.col(score).alias("_score"))
        tagged = part if tagged is None else tagged.unionByName(part)
    names = ("gpu_score", "coral_score", "tdoa_confidence")
    return tagged.groupBy(*keys).agg(
        *[
            F.avg(F.when(F.col("_voter") == voter, F.col("_score"))).alias(name)
            for voter, name in enumerate(names)
        ]
    )


def cohue_pairs(
    df: DataFrame,
    tol_us: int,
    ts: str = "timestamp_us",
    sensor: str = "sensor_id",
    f: str = "frequency_hz",
) -> DataFrame:
    """Sensor pairs that saw one hue class in one time bucket, with their joint coherence.

    Rows are first summed per (hue, bucket, sensor), so a group holds at most one row per
    sensor (32 at most) and a hot hue never multiplies.  Low coherence on an equal hue is
    the injection sign.
    """
    per_sensor = (
        df.withColumn("hue_class", freq_to_material_id(F.col(f)))
        .where("hue_class IS NOT NULL")
        .groupBy("hue_class", slice_of(F.col(ts), tol_us).alias("bucket"), sensor)
        .agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n"))
    )
    group = per_sensor.groupBy("hue_class", "bucket").agg(
        F.sort_array(F.collect_list(F.struct(sensor, "re", "im", "n"))).alias("s")
    )
    a = group.where(F.size("s") > 1).select("hue_class", "bucket", "s", F.posexplode("s").alias("_p", "a"))
    pairs = a.select(
        "hue_class", "bucket", "a", F.explode(F.expr("slice(s, _p + 2, size(s))")).alias("b")
    )
    joint = F.sqrt(
        F.pow(F.col("a.re") + F.col("b.re"), F.lit(2.0)) + F.pow(F.col("a.im") + F.col("b.im"), F.lit(2.0))
    )
    apart = F.sqrt(F.col("a.re") ** 2 + F.col("a.im") ** 2) + F.sqrt(
        F.col("b.re") ** 2 + F.col("b.im") ** 2
    )
    return pairs.select(
        "hue_class",
        "bucket",
        F.col(f"a.{sensor}").alias("sensor_a"),
        F.col(f"b.{sensor}").alias("sensor_b"),
        (F.col("a.n") + F.col("b.n")).alias("n"),
        F.try_divide(joint, apart).alias("coherence"),
    )


def relate(
    events: DataFrame,
    window_us: int,
    ts: str = "timestamp_us",
    id_col: str = "particle_id",
    entity: str = "sensor_id",
    by: Sequence[str] = (),
    width: int | None = None,
    supplied: DataFrame | None = None,
) -> DataFrame:
    """Typed edges between events and entities.

    Choice: ``PRECEDES`` links each event to its immediate successor when the gap is in
    (0, W]; longer precedence follows by path.  ``CO_OCCURS_WITH`` links two entities
    active in the same window of width W, once per window.  Both stay linear in the
    events (entities per window are bounded by the sensor mask).  ``CAUSED_BY`` has no
    rule: such edges come in through ``supplied`` only.
    """
    seq = lag_rows(events, by, ts, [id_col, ts], [id_col], width)
    gap = F.col(ts) - F.col(f"prev_{ts}")
    precedes = seq.where((gap > 0) & (gap <= window_us)).select(
        F.concat(F.lit("event:"), F.col(f"prev_{id_col}")).alias("src"),
        F.concat(F.lit("event:"), F.col(id_col)).alias("dst"),
        F.lit("PRECEDES").alias("type"),
        F.col(ts).alias("ts"),
    )
    active = (
        events.groupBy(slice_of(F.col(ts), window_us).alias("_w"))
        .agg(F.sort_array(F.collect_set(entity)).alias("_e"))
        .where(F.size("_e") > 1)
        .select("_w", "_e", F.posexplode("_e").alias("_p", "_a"))
        .select("_w", "_a", F.explode(F.expr("slice(_e, _p + 2, size(_e))")).alias("_b"))
    )
    co_occurs = active.select(
        F.concat(F.lit("entity:"), F.col("_a")).alias("src"),
        F.concat(F.lit("entity:"), F.col("_b")).alias("dst"),
        F.lit("CO_OCCURS_WITH").alias("type"),
        (F.col("_w") * window_us).alias("ts"),
    )
    out = precedes.unionByName(co_occurs)
    if supplied is not None:
        caused = supplied.where("type = 'CAUSED_BY'").select("src", "dst", "type", "ts")
        out = out.unionByName(caused)
    return out


def tdoa_pairs(
    df: DataFrame,
    sensors: DataFrame,
    event_keys: Sequence[str],
    ts: str = "timestamp_us",
    sensor: str = "sensor_id",
    speed: Column | None = None,
) -> DataFrame:
    """Arrival-time differences per sensor pair of one event, checked against the baseline.

    The first arrival per (event, sensor) is taken before pairing, so a group holds at
    most one entry per sensor.  Consistent means speed * |dt| <= distance of the sensors.
    """
    speed = F.lit(SPEED_OF_LIGHT) if speed is None else speed
    first = df.groupBy(*event_keys, sensor).agg(F.min(ts).alias("_t"))
    placed = with_sensor(first, sensors.select(sensor, "x", "y", "z"), sensor)
    group = placed.groupBy(*event_keys).agg(
        F.sort_array(F.collect_list(F.struct(sensor, "_t", "x", "y", "z"))).alias("s")
    )
    a = group.where(F.size("s") > 1).select(*event_keys, "s", F.posexplode("s").alias("_p", "a"))
    pairs = a.select(*event_keys, "a", F.explode(F.expr("slice(s, _p + 2, size(s))")).alias("b"))
    baseline = F.sqrt(
        sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz"), start=F.lit(0.0))
    )
    dt = F.col("b._t") - F.col("a._t")
    return pairs.select(
        *event_keys,
        F.col(f"a.{sensor}").alias("sensor_a"),
        F.col(f"b.{sensor}").alias("sensor_b"),
        dt.alias("dt_us"),
        baseline.alias("baseline_m"),
        (F.abs(dt) * F.lit(1e-6) * speed <= baseline).alias("consistent"),
    )


def discrepancy(
    predicted: DataFrame, measured: DataFrame, keys: Sequence[str], value: str, tol: float
) -> DataFrame:
    """Keys where the measured field departs from the predicted one by more than ``tol``.

    Both sides are averaged per key before they meet, so a hot key is one row.
    """
    p = predicted.groupBy(*keys).agg(F.avg(value).alias("predicted"))
    m = measured.groupBy(*keys).agg(F.avg(value).alias("measured"))
    return (
        p.join(m, list(keys))
        .withColumn("discrepancy", F.col("measured") - F.col("predicted"))
        .where(F.abs("discrepancy") > tol)
    )


def new_emitters(current: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins active now and absent from the baseline, with how often they were seen."""
    now = current.groupBy(*keys).agg(F.count("*").alias("n"))
    then = baseline.select(*keys).distinct()
    return now.join(then, list(keys), "left_anti")


def materials_frame(spark) -> DataFrame:
    return spark.createDataFrame(MATERIALS, "material string, eps_real double, eps_imag double")


def with_material(df: DataFrame, materials: DataFrame, on: str = "material") -> DataFrame:
    """Permittivity of each row's material; the library table is broadcast if small."""
    return df.join(broadcast_if_small(materials), on, "left")


def reflectance(df: DataFrame, materials: DataFrame, theta: str, on: str = "material") -> DataFrame:
    """Material lookup followed by the complex Fresnel reflectance."""
    return with_material(df, materials, on).withColumn(
        "reflectance", fresnel_r(F.col("eps_real"), F.col("eps_imag"), F.col(theta))
    )


def verify_hashes(
    corpus: DataFrame, blocks: DataFrame, on: str = "block_id", stored: str = "corpus_hash"
) -> DataFrame:
    """Recompute each raw block's hash prefix and compare it with the stored one.

    ``blocks`` holds payload, timestamp_us and serial per block; a corpus row without its
    block is reported as ``missing``.
    """
    fresh = blocks.select(
        on,
        hash_prefix(block_hash(F.col("payload"), F.col("timestamp_us"), F.col("serial"))).alias("_fresh"),
    )
    state = (
        F.when(F.col("_fresh").isNull(), "missing")
        .when(F.col("_fresh") == F.col(stored), "match")
        .otherwise("mismatch")
    )
    return corpus.join(fresh, on, "left").withColumn("hash_state", state).drop("_fresh")


def range_match(
    measured: DataFrame,
    scene: DataFrame,
    tol: float,
    value: str = "range_m",
    id_col: str = "id",
    scale: float = 1e6,
) -> DataFrame:
    """Nearest scene distance for each measured distance, within ``tol`` metres.

    The distance, in fixed point, takes the role of time in the nearest-row scan.
    """
    tick = F.round(F.col(value) * F.lit(scale)).cast("long")
    m = measured.select(F.col(id_col), F.col(value), tick.alias("timestamp_us"))
    s = scene.select(F.col(id_col), tick.alias("timestamp_us"))
    pairs = clock_pairs(m, s, round(tol * scale), id_col=id_col)
    return pairs.select(
        F.col("a_id").alias("measured_id"),
        F.col("b_id").alias("scene_id"),
        (F.col("divergence_us") / F.lit(scale)).alias("delta_m"),
    )
