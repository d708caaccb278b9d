"""Queries for filters, aggregations, set operations and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromafield.operators import aggregates as A
from chromafield.operators import filters, joins, ranking, sets
from chromafield.operators.ordered import slice_of
from chromafield.operators.windows import latest, ranked
from chromafield.plans.bindings import (
    DAY_US,
    HOUR_US,
    LINE_SQL,
    MINUTE_US,
    OBS_SQL,
    SENSOR_SQL,
    WIN_SQL,
    Tables,
    nudged,
    query,
    rounded,
)
from chromafield.schemas import BANDS

c = F.col
T0 = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z, the first instant of the events table


@query(
    "carrier_variance_by_hue",
    "E1 E3",
    f"""WITH {OBS_SQL}, w AS (
      SELECT hue_class, timestamp_us // {DAY_US} AS d,
        sqrt(sum(re) ** 2 + sum(im) ** 2) / nullif(sum(sqrt(re * re + im * im)), 0) AS gamma
      FROM obs GROUP BY 1, 2)
    SELECT hue_class, CAST(count(gamma) AS BIGINT) AS windows, round(avg(gamma), 6) AS mean_gamma,
      round(var_pop(gamma), 6) AS carrier_variance, var_pop(gamma) < 0.004 AS injected
    FROM w GROUP BY 1""",
)
def _(t: Tables):
    return rounded(A.carrier_variance(t.obs, ["hue_class"], DAY_US, 0.004))


@query(
    "phase_coherence_by_bin",
    "E1",
    f"""WITH {OBS_SQL}
    SELECT CAST(floor(frequency_hz / 1e6) AS BIGINT) AS bin, sensor_id,
      round(sqrt(sum(re) ** 2 + sum(im) ** 2) / nullif(sum(sqrt(re * re + im * im)), 0), 6) AS gamma,
      CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2""",
)
def _(t: Tables):
    bins = F.floor(c("frequency_hz") / F.lit(1e6)).alias("bin")
    return rounded(A.phase_coherence(t.obs, [bins, "sensor_id"]))


@query(
    "emitter_carrier_variance_lineitem",
    "E1 E3",
    f"""WITH {LINE_SQL}, w AS (
      SELECT emitter, timestamp_us // {30 * DAY_US} AS d,
        sqrt(sum(energy * cos(frequency_hz)) ** 2 + sum(energy * sin(frequency_hz)) ** 2)
          / sum(sqrt((energy * cos(frequency_hz)) ** 2 + (energy * sin(frequency_hz)) ** 2)) AS gamma
      FROM line GROUP BY 1, 2)
    SELECT emitter, CAST(count(gamma) AS BIGINT) AS windows, round(avg(gamma), 6) AS mean_gamma,
      round(var_pop(gamma), 6) AS carrier_variance, var_pop(gamma) < 0.02 AS injected
    FROM w GROUP BY 1""",
)
def _(t: Tables):
    wave = t.lineitem.withColumns(
        {"re": c("energy") * F.cos("frequency_hz"), "im": c("energy") * F.sin("frequency_hz")}
    )
    return rounded(A.carrier_variance(wave, ["emitter"], 30 * DAY_US, 0.02))


@query(
    "field_at_points",
    "E2",
    f"""WITH {OBS_SQL}, {SENSOR_SQL}, p AS (
      SELECT sensor_id AS point_id, x / 100 AS px, y / 3 AS py, 2.5 AS pz FROM sensors),
    t AS (SELECT point_id, k * 2 * pi() / 100 - (2 * pi() * 75e6 / 299792458.0) * sqrt(r2) AS a,
        energy * exp(-r2 / 50.0) / r2 AS m
      FROM (SELECT point_id, k, energy, (x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2 AS r2 FROM obs, p)
      WHERE r2 > 0 AND r2 <= 50 * ln(1e12))
    SELECT p.point_id, round(sqrt(sum(m * cos(a)) ** 2 + sum(m * sin(a)) ** 2) / sum(abs(m)), 6) AS gamma,
      round(coalesce(sqrt(sum(m * cos(a)) ** 2 + sum(m * sin(a)) ** 2), 0), 6) AS field, CAST(count(m) AS BIGINT) AS n
    FROM p LEFT JOIN t ON p.point_id = t.point_id GROUP BY 1""",
)
def _(t: Tables):
    points = t.sensors.select(
        c("sensor_id").alias("point_id"),
        (c("x") / 100).alias("x"),
        (c("y") / 3).alias("y"),
        F.lit(2.5).alias("z"),
    )
    paths = t.obs.select(
        "x", "y", "z", c("energy").alias("amplitude"), (c("k") * 2 * F.pi() / 100).alias("phase")
    )
    return rounded(A.field_at(points, paths, 75e6, 5.0).drop("left_out"))


@query(
    "level_meter",
    "E4",
    f"""WITH {OBS_SQL}
    SELECT sensor_id, timestamp_us // {HOUR_US} AS window, round(max(abs(re)) / 0.4, 6) AS peak,
      max(abs(re)) / 0.4 >= 1 AS clipped FROM obs GROUP BY 1, 2""",
)
def _(t: Tables):
    return rounded(A.level_meter(t.obs, ["sensor_id"], HOUR_US, "re", full_scale=0.4))


@query(
    "receiver_meter",
    "E5 C6",
    f"""WITH {OBS_SQL}
    SELECT sensor_id, timestamp_us // {DAY_US} AS window, round(avg(re * re + im * im), 6) AS power,
      round(arg_max(frequency_hz, (re * re + im * im, frequency_hz))
        FILTER (frequency_hz BETWEEN 20e6 AND 30e6), 3) AS peak_hz FROM obs GROUP BY 1, 2""",
)
def _(t: Tables):
    out = A.rx_meter(t.obs, ["sensor_id"], 25e6, DAY_US, 5e6)
    return out.select("sensor_id", "window", F.round("power", 6).alias("power"), F.round("peak_hz", 3).alias("peak_hz"))


_VOTES_SQL = f"""{OBS_SQL}, votes AS (
      SELECT sensor_id, timestamp_us // {HOUR_US} AS hour, avg(energy) FILTER (layer = 0) AS gpu_score,
        avg(energy) FILTER (layer = 1) AS coral_score, avg(energy) FILTER (layer = 2) AS tdoa_confidence
      FROM obs WHERE layer < 3 GROUP BY 1, 2),
    says AS (SELECT *, gpu_score >= 0.0801 AS s0, coral_score >= 0.0801 AS s1, tdoa_confidence >= 0.0801 AS s2 FROM votes),
    cnt AS (SELECT *, coalesce(CAST(s0 AS INT), 0) + coalesce(CAST(s1 AS INT), 0) + coalesce(CAST(s2 AS INT), 0) AS yes,
      CAST(s0 IS NOT NULL AS INT) + CAST(s1 IS NOT NULL AS INT) + CAST(s2 IS NOT NULL AS INT) AS n FROM says),
    jury AS (SELECT *, CASE WHEN n = 3 AND yes = 1 THEN CASE WHEN s0 THEN 0 WHEN s1 THEN 1 ELSE 2 END
        WHEN n = 3 AND yes = 2 THEN CASE WHEN NOT s0 THEN 0 WHEN NOT s1 THEN 1 ELSE 2 END END AS dissenter FROM cnt)"""


def _votes(t: Tables):
    hour = slice_of(c("timestamp_us"), HOUR_US).alias("hour")
    keyed = t.obs.select("sensor_id", hour, "layer", c("energy").alias("score"))
    parts = [keyed.where(c("layer") == voter) for voter in (0, 1, 2)]
    return joins.collect_votes(*parts, ["sensor_id", "hour"])


def _verdicts(t: Tables):
    return A.verdict(_votes(t), (0.0801, 0.0801, 0.0801))


@query(
    "jury_votes",
    "D5",
    f"""WITH {_VOTES_SQL} SELECT sensor_id, hour, round(gpu_score + 1e-10, 6) AS gpu_score,
      round(coral_score + 1e-10, 6) AS coral_score, round(tdoa_confidence + 1e-10, 6) AS tdoa_confidence FROM votes""",
)
def _(t: Tables):
    return nudged(_votes(t))


@query(
    "jury_verdicts",
    "E6",
    f"""WITH {_VOTES_SQL} SELECT sensor_id, hour, yes AS yes_votes, n AS n_votes, yes * 2 > n AS anomalous,
      dissenter, round(abs(gpu_score - coral_score) + 1e-10, 6) AS divergence,
      CASE WHEN n = 3 AND yes IN (0, 3) THEN 1 ELSE 0 END + CASE WHEN dissenter IS NOT NULL
        THEN 2 + (4 << dissenter) ELSE 0 END + CASE WHEN n < 3 THEN 32 ELSE 0 END AS jury_flags FROM jury""",
)
def _(t: Tables):
    return nudged(_verdicts(t).drop("gpu_score", "coral_score", "tdoa_confidence"))


@query(
    "jury_dissent_split",
    "H2 I11",
    f"""WITH {_VOTES_SQL} SELECT 'consensus' AS stream, sensor_id, hour,
      yes || ' of ' || n || ' voters flag an anomaly (unanimous)' AS event_line FROM jury WHERE dissenter IS NULL
    UNION ALL SELECT 'dissent', sensor_id, hour,
      yes || ' of ' || n || ' voters flag an anomaly (voter ' || dissenter || ' dissents)' FROM jury
      WHERE dissenter IS NOT NULL""",
)
def _(t: Tables):
    from chromafield.functions import event_line

    consensus, dissent = sets.split_dissent(_verdicts(t))
    cols = ["stream", "sensor_id", "hour", "event_line"]
    return (
        event_line(consensus).withColumn("stream", F.lit("consensus")).select(cols)
        .unionByName(event_line(dissent).withColumn("stream", F.lit("dissent")).select(cols))
    )


@query(
    "injection_flags",
    "C5",
    f"""WITH {_VOTES_SQL} SELECT sensor_id, hour, gpu_score >= 0.1501 AND abs(gpu_score - coral_score) <= 0.0501 AS injected
    FROM votes""",
)
def _(t: Tables):
    v = _verdicts(t).withColumn("anomaly_score", c("gpu_score"))
    return filters.injection_flag(v, 0.1501, 0.0501).select("sensor_id", "hour", "injected")


@query(
    "layer_rollup",
    "E12",
    f"""WITH {OBS_SQL} SELECT sensor_id, layer, hue_class, CAST(grouping_id(sensor_id, layer, hue_class) AS BIGINT) AS level,
      CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY ROLLUP (sensor_id, layer, hue_class)""",
)
def _(t: Tables):
    return A.distribution(t.obs, ["sensor_id", "layer", "hue_class"], "rollup")


@query(
    "layer_cube",
    "E12",
    f"""WITH {OBS_SQL} SELECT sensor_id, layer, CAST(grouping_id(sensor_id, layer) AS BIGINT) AS level,
      CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY CUBE (sensor_id, layer)""",
)
def _(t: Tables):
    return A.distribution(t.obs, ["sensor_id", "layer"], "cube")


@query(
    "layer_grouping_sets",
    "E12",
    f"""WITH {OBS_SQL} SELECT sensor_id, layer, CAST(grouping_id(sensor_id, layer) AS BIGINT) AS level,
      CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY GROUPING SETS ((sensor_id), (layer))""",
)
def _(t: Tables):
    return A.distribution(t.obs, ["sensor_id", "layer"], "sets")


@query(
    "link_quality",
    "E13",
    f"""WITH {OBS_SQL} SELECT sensor_id, CAST(count(*) AS BIGINT) AS packets, CAST(sum(layer % 3) AS BIGINT) AS lost,
      round(avg(k), 6) AS jitter_mean, round(stddev_pop(k), 6) AS jitter_sd, max(k) AS jitter_max,
      CAST(quantile_disc(k, 0.95) AS BIGINT) AS jitter_p95 FROM obs GROUP BY 1""",
)
def _(t: Tables):
    raw = t.obs.select("sensor_id", c("k").cast("long").alias("jitter_us"), (c("layer") % 3).alias("packet_loss_count"))
    return rounded(A.link_quality(raw, ["sensor_id"]))


@query(
    "error_vector_magnitude",
    "E15",
    f"""WITH {LINE_SQL}, s AS (SELECT flag, CAST(pow(4, 1 + particle_id % 4) AS BIGINT) AS qam_order,
        energy AS ref_re, energy / 2 AS ref_im, energy + (frequency_hz - 50000) / 1e6 AS rx_re,
        energy / 2 + (emitter % 7) / 100.0 AS rx_im FROM line)
    SELECT flag, qam_order, round(10 * log10(sum((rx_re - ref_re) ** 2 + (rx_im - ref_im) ** 2)
      / sum(ref_re ** 2 + ref_im ** 2)), 6) AS evm_db, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2""",
)
def _(t: Tables):
    return rounded(A.evm(_symbols(t), ["flag", "qam_order"]))


def _symbols(t: Tables):
    return t.lineitem.select(
        "flag",
        F.pow(F.lit(4), 1 + c("particle_id") % 4).cast("long").alias("qam_order"),
        c("energy").alias("ref_re"),
        (c("energy") / 2).alias("ref_im"),
        (c("energy") + (c("frequency_hz") - 50000) / F.lit(1e6)).alias("rx_re"),
        (c("energy") / 2 + (c("emitter") % 7) / F.lit(100.0)).alias("rx_im"),
    )


@query(
    "qam_ceiling",
    "G7",
    f"""WITH {LINE_SQL}, s AS (SELECT flag, CAST(pow(4, 1 + particle_id % 4) AS BIGINT) AS qam_order,
        energy AS ref_re, energy / 2 AS ref_im, energy + (frequency_hz - 50000) / 1e6 AS rx_re,
        energy / 2 + (emitter % 7) / 100.0 AS rx_im FROM line),
    e AS (SELECT flag, qam_order, 10 * log10(sum((rx_re - ref_re) ** 2 + (rx_im - ref_im) ** 2)
      / sum(ref_re ** 2 + ref_im ** 2)) AS evm_db FROM s GROUP BY 1, 2)
    SELECT flag, max(qam_order) AS qam_ceiling, round(arg_max(evm_db, qam_order), 6) AS evm_db
    FROM e WHERE evm_db < -30 GROUP BY 1""",
)
def _(t: Tables):
    return rounded(ranking.qam_ceiling(A.evm(_symbols(t), ["flag", "qam_order"]), -30.0, ["flag"]))


@query(
    "symbol_error_rate",
    "E16",
    f"""WITH {LINE_SQL} SELECT flag, particle_id % 3 AS layer,
      round(avg(CASE WHEN emitter % 16 <> orderkey % 16 THEN 1.0 ELSE 0.0 END), 6) AS ser,
      CAST(count(*) AS BIGINT) AS n FROM line GROUP BY 1, 2""",
)
def _(t: Tables):
    sym = t.lineitem.select(
        "flag",
        (c("particle_id") % 3).alias("layer"),
        (c("emitter") % 16).alias("tx"),
        (c("orderkey") % 16).alias("rx"),
    )
    return rounded(A.symbol_error_rate(sym, ["flag", "layer"]))


@query(
    "delay_spread",
    "E17",
    f"""WITH {OBS_SQL}, p AS (SELECT sensor_id, energy * 250 + 0.5 AS d, k + 1.0 AS p FROM obs),
    w AS (SELECT * FROM p WHERE d BETWEEN 1 AND 50),
    s AS (SELECT sensor_id, sqrt(greatest(sum(p * d * d) / sum(p) - (sum(p * d) / sum(p)) ** 2, 0)) AS rms FROM w GROUP BY 1)
    SELECT sensor_id, CAST(floor(d / 2.0) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS paths,
      round(any_value(rms), 6) AS rms_spread_ns FROM w JOIN s USING (sensor_id) GROUP BY 1, 2""",
)
def _(t: Tables):
    paths = t.obs.select(
        "sensor_id", (c("energy") * 250 + 0.5).alias("delay_ns"), (c("k") + F.lit(1.0)).alias("power")
    )
    return rounded(A.delay_spread(paths, ["sensor_id"], bin_ns=2.0))


@query(
    "grid_occupancy",
    "E20",
    f"""WITH {WIN_SQL} SELECT CAST(least(greatest(floor((x + 0.4) / 0.1), 0), 7) AS BIGINT) AS gx,
      CAST(least(greatest(floor((y + 0.4) / 0.1), 0), 7) AS BIGINT) AS gy, CAST(count(*) AS BIGINT) AS n
    FROM win GROUP BY 1, 2""",
)
def _(t: Tables):
    return A.occupancy(t.windows, 8, (-0.4, 0.4, -0.4, 0.4))


@query(
    "quadrant_occupancy_change",
    "E20",
    f"""WITH {OBS_SQL}, g AS (SELECT CAST(least(floor(x / 5), 1) AS BIGINT) AS gx, CAST(least(floor(y / 5), 1) AS BIGINT) AS gy,
        timestamp_us // {DAY_US} AS win, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2, 3)
    SELECT gx, gy, win AS "window", n, n - coalesce(lag(n) OVER (PARTITION BY gx, gy ORDER BY win), 0) AS dn FROM g""",
)
def _(t: Tables):
    return A.occupancy(t.obs, 2, (0.0, 10.0, 0.0, 10.0), ts="timestamp_us", span_us=DAY_US)


@query(
    "contributing_sensor_mask",
    "E23",
    f"""WITH {OBS_SQL} SELECT user_id, timestamp_us // {DAY_US} AS day, CAST(bit_or(1 << layer) AS BIGINT) AS sensor_id_mask
    FROM obs GROUP BY 1, 2""",
)
def _(t: Tables):
    day = slice_of(c("timestamp_us"), DAY_US).alias("day")
    keyed = t.obs.select("user_id", day, "layer")
    return A.sensor_mask(keyed, ["user_id", "day"], "layer")


@query(
    "patch_gaussians",
    "E24",
    f"""WITH {WIN_SQL} SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my,
      round(avg(z), 6) AS mz, round(covar_pop(x, x), 6) AS xx, round(covar_pop(x, y), 6) AS xy,
      round(covar_pop(x, z), 6) AS xz, round(covar_pop(y, y), 6) AS yy, round(covar_pop(y, z), 6) AS yz,
      round(covar_pop(z, z), 6) AS zz FROM win GROUP BY 1""",
)
def _(t: Tables):
    g = A.patch_gaussian(t.windows, ["label"])
    return rounded(
        g.select(
            "label",
            "n",
            *[c("position")[i].alias(f"m{p}") for i, p in enumerate("xyz")],
            *[c("covariance")[i].alias(p) for i, p in enumerate(("xx", "xy", "xz", "yy", "yz", "zz"))],
        )
    )


@query(
    "probe_baselines",
    "E26",
    f"""WITH {OBS_SQL} SELECT layer AS probe, sensor_id AS domain, round(avg(energy), 6) AS mean,
      round(stddev_pop(energy), 6) AS sigma, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2""",
)
def _(t: Tables):
    p = t.obs.select(c("layer").alias("probe"), c("sensor_id").alias("domain"), c("energy").alias("score"))
    return rounded(A.probe_baseline(p))


# ---- filters -------------------------------------------------------------------------


@query(
    "timeline_scrub",
    "C1 J14",
    f"""WITH {OBS_SQL} SELECT particle_id, timestamp_us, round(energy, 6) AS energy FROM obs
    WHERE timestamp_us >= {T0 + 3 * DAY_US} AND timestamp_us < {T0 + 5 * DAY_US}""",
)
def _(t: Tables):
    out = filters.scrub(t.obs, T0 + 3 * DAY_US, T0 + 5 * DAY_US)
    return rounded(out.select("particle_id", "timestamp_us", "energy"))


@query(
    "state_as_of",
    "C1 F9",
    f"""WITH {OBS_SQL} SELECT user_id, particle_id, timestamp_us, layer FROM obs
    WHERE timestamp_us <= {T0 + 10 * DAY_US}
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp_us DESC, particle_id DESC) = 1""",
)
def _(t: Tables):
    rows = t.obs.select("user_id", "particle_id", "timestamp_us", "layer")
    return filters.as_of(rows, ["user_id"], T0 + 10 * DAY_US, tie=["particle_id"])


@query(
    "latest_per_source",
    "F9",
    f"""WITH {OBS_SQL} SELECT sensor_id, layer, particle_id, round(energy, 6) AS energy FROM obs
    QUALIFY row_number() OVER (PARTITION BY sensor_id, layer ORDER BY timestamp_us DESC, particle_id DESC) = 1""",
)
def _(t: Tables):
    rows = t.obs.select("sensor_id", "layer", "particle_id", "timestamp_us", "energy")
    return rounded(latest(rows, ["sensor_id", "layer"], tie=["particle_id"]).drop("timestamp_us"))


@query(
    "layer_toggles",
    "C2",
    f"""WITH {OBS_SQL} SELECT layer, CAST(count(*) AS BIGINT) AS n FROM obs WHERE layer IN (0, 3, 4) GROUP BY 1""",
)
def _(t: Tables):
    return filters.layers(t.obs, ["V", "R", "E"]).groupBy("layer").agg(F.count("*").alias("n"))


@query(
    "layer_mask_toggles",
    "C2 E23",
    f"""WITH {OBS_SQL}, m AS (SELECT user_id, timestamp_us // {HOUR_US} AS hour, bit_or(1 << layer) AS mask FROM obs GROUP BY 1, 2)
    SELECT user_id, hour, CAST(mask AS BIGINT) AS sensor_id_mask FROM m WHERE mask & 9 <> 0""",
)
def _(t: Tables):
    hour = slice_of(c("timestamp_us"), HOUR_US).alias("hour")
    masks = A.sensor_mask(t.obs.select("user_id", hour, "layer"), ["user_id", "hour"], "layer")
    return filters.layers(masks, ["video", "rf"], mask="sensor_id_mask")


@query(
    "region_history",
    "C3",
    f"""WITH {OBS_SQL} SELECT particle_id, timestamp_us, x, y, z FROM obs
    WHERE (x - 4.2) ** 2 + (y - 5.1) ** 2 + (z - 3.3) ** 2 <= 9""",
)
def _(t: Tables):
    out = filters.region(t.obs, (4.2, 5.1, 3.3), radius=3.0)
    return out.select("particle_id", "timestamp_us", "x", "y", "z")


@query(
    "region_box",
    "C3",
    f"""WITH {OBS_SQL} SELECT layer, CAST(count(*) AS BIGINT) AS n FROM obs
    WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 5 AND z BETWEEN 1 AND 7 GROUP BY 1""",
)
def _(t: Tables):
    out = filters.region(t.obs, (4.0, 4.0, 4.0), box=(2.0, 1.0, 3.0))
    return out.groupBy("layer").agg(F.count("*").alias("n"))


_STATUS_SQL = f"""status AS (SELECT s.sensor_id, CASE WHEN last IS NULL THEN 'UNWIRED'
        WHEN last < (SELECT max(timestamp_us) FROM obs) - 10 * {MINUTE_US} THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS state
      FROM (SELECT s_suppkey AS sensor_id FROM supplier) s
      LEFT JOIN (SELECT sensor_id, max(timestamp_us) AS last FROM obs GROUP BY 1) o USING (sensor_id))"""


def _status(t: Tables):
    from chromafield.streaming.device import device_status

    registry = t.table("supplier").select(c("s_suppkey").cast("int").alias("sensor_id"))
    now = t.obs.agg(F.max("timestamp_us")).first()[0]
    return device_status(t.obs, registry, 10 * MINUTE_US, now)


@query(
    "device_states",
    "K6",
    f"""WITH {OBS_SQL}, {_STATUS_SQL} SELECT CAST(sensor_id AS BIGINT) AS sensor_id, state FROM status""",
)
def _(t: Tables):
    return _status(t).select("sensor_id", "state")


@query(
    "connected_only",
    "C4",
    f"""WITH {OBS_SQL}, {_STATUS_SQL} SELECT sensor_id, CAST(count(*) AS BIGINT) AS n FROM obs
    WHERE sensor_id IN (SELECT sensor_id FROM status WHERE state = 'CONNECTED') GROUP BY 1""",
)
def _(t: Tables):
    return filters.connected(t.obs, _status(t)).groupBy("sensor_id").agg(F.count("*").alias("n"))


@query(
    "band_presets",
    "C6",
    f"""WITH {OBS_SQL} SELECT particle_id, round(frequency_hz, 3) AS frequency_hz FROM obs
    WHERE frequency_hz BETWEEN 432.5e6 AND 433.5e6 OR frequency_hz BETWEEN 99.5e6 AND 100.5e6""",
)
def _(t: Tables):
    hits = filters.near_freq(t.obs, 433e6).unionByName(filters.near_freq(t.obs, 100e6))
    return rounded(hits.select("particle_id", "frequency_hz"), 3)


# ---- dimension joins and sets --------------------------------------------------------


@query(
    "sensor_dimension",
    "D2",
    f"""WITH {OBS_SQL}, {SENSOR_SQL} SELECT particle_id, obs.sensor_id, name, s.x AS rx, s.y AS ry FROM obs
    LEFT JOIN sensors s ON s.sensor_id = obs.sensor_id""",
)
def _(t: Tables):
    dim = t.sensors.select("sensor_id", "name", c("x").alias("rx"), c("y").alias("ry"))
    return joins.with_sensor(t.obs.select("particle_id", "sensor_id"), dim)


_BAND_ROWS = ", ".join(f"('{n}', {lo!r}, {hi!r})" for n, lo, hi in BANDS)


@query(
    "frequency_bands",
    "D3",
    f"""WITH {OBS_SQL}, bands(band, lo, hi) AS (VALUES {_BAND_ROWS})
    SELECT band, sensor_id, CAST(count(*) AS BIGINT) AS n FROM obs JOIN bands ON frequency_hz >= lo AND frequency_hz < hi
    GROUP BY 1, 2""",
)
def _(t: Tables):
    return joins.band_join(t.obs).groupBy("band", "sensor_id").agg(F.count("*").alias("n"))


@query(
    "field_discrepancies",
    "D12",
    f"""WITH {OBS_SQL}, p AS (SELECT x, hue_class, avg(energy) AS predicted FROM obs WHERE layer <> 3 GROUP BY 1, 2),
    m AS (SELECT x, hue_class, avg(energy) AS measured FROM obs WHERE layer = 3 GROUP BY 1, 2)
    SELECT x, hue_class, round(predicted, 6) AS predicted, round(measured, 6) AS measured,
      round(measured - predicted, 6) AS discrepancy FROM p JOIN m USING (x, hue_class)
    WHERE abs(measured - predicted) > 0.01""",
)
def _(t: Tables):
    out = joins.discrepancy(t.obs.where("layer <> 3"), t.obs.where("layer = 3"), ["x", "hue_class"], "energy", 0.01)
    return rounded(out)


_BIN = "CAST(floor(frequency_hz / 1e5) AS BIGINT)"


@query(
    "new_emitters",
    "D13",
    f"""WITH {OBS_SQL}, b AS (SELECT *, {_BIN} AS bin FROM obs)
    SELECT bin, CAST(count(*) AS BIGINT) AS n FROM b WHERE timestamp_us >= {T0 + 15 * DAY_US}
      AND bin NOT IN (SELECT bin FROM b WHERE timestamp_us < {T0 + 15 * DAY_US}) GROUP BY 1""",
)
def _(t: Tables):
    b = t.obs.withColumn("bin", F.expr(_BIN))
    half = T0 + 15 * DAY_US
    return joins.new_emitters(b.where(c("timestamp_us") >= half), b.where(c("timestamp_us") < half), ["bin"])


@query(
    "common_bins",
    "H3",
    f"""WITH {OBS_SQL}, b AS (SELECT DISTINCT {_BIN} AS bin, sensor_id FROM obs)
    SELECT bin, CAST(8 AS BIGINT) AS sensors FROM (
      SELECT bin FROM b WHERE sensor_id = 0 INTERSECT SELECT bin FROM b WHERE sensor_id = 1
      INTERSECT SELECT bin FROM b WHERE sensor_id = 2 INTERSECT SELECT bin FROM b WHERE sensor_id = 3
      INTERSECT SELECT bin FROM b WHERE sensor_id = 4 INTERSECT SELECT bin FROM b WHERE sensor_id = 5
      INTERSECT SELECT bin FROM b WHERE sensor_id = 6 INTERSECT SELECT bin FROM b WHERE sensor_id = 7)""",
)
def _(t: Tables):
    return sets.common_bins(t.obs.withColumn("bin", F.expr(_BIN)), ["bin"])


@query(
    "bin_changes",
    "H4",
    f"""WITH {OBS_SQL}, b AS (SELECT {_BIN} AS bin, timestamp_us < {T0 + 15 * DAY_US} AS before FROM obs),
    g AS (SELECT bin FROM b WHERE NOT before EXCEPT ALL SELECT bin FROM b WHERE before),
    l AS (SELECT bin FROM b WHERE before EXCEPT ALL SELECT bin FROM b WHERE NOT before)
    SELECT bin, CAST(count(*) AS BIGINT) AS delta, 'gained' AS change FROM g GROUP BY 1
    UNION ALL SELECT bin, -CAST(count(*) AS BIGINT), 'lost' FROM l GROUP BY 1""",
)
def _(t: Tables):
    b = t.obs.withColumn("bin", F.expr(_BIN))
    half = T0 + 15 * DAY_US
    return sets.bin_changes(b.where(c("timestamp_us") < half), b.where(c("timestamp_us") >= half), ["bin"])


@query(
    "deduplicated_packets",
    "H5",
    f"""WITH {OBS_SQL} SELECT DISTINCT sensor_id, layer, k FROM obs""",
)
def _(t: Tables):
    packets = t.obs.select("sensor_id", "layer", c("k").cast("long").alias("k"))
    return sets.dedupe(packets.unionByName(packets), ["sensor_id", "layer", "k"])


@query(
    "stream_union",
    "H1",
    f"""WITH {OBS_SQL} SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(frequency_hz) AS BIGINT) AS tuned,
      CAST(count(temperature) AS BIGINT) AS warm FROM (
      SELECT 'rf' AS source, frequency_hz, NULL AS temperature FROM obs WHERE layer <> 3
      UNION ALL SELECT 'env', NULL, energy FROM obs WHERE layer = 3) GROUP BY 1""",
)
def _(t: Tables):
    rf = t.obs.where("layer <> 3").select(F.lit("rf").alias("source"), "particle_id", "frequency_hz")
    env = t.obs.where("layer = 3").select(F.lit("env").alias("source"), "particle_id", c("energy").alias("temperature"))
    return sets.union_streams([rf, env]).groupBy("source").agg(
        F.count("*").alias("n"), F.count("frequency_hz").alias("tuned"), F.count("temperature").alias("warm")
    )


# ---- rankings ------------------------------------------------------------------------


@query(
    "top_energy",
    "G1",
    f"""WITH {OBS_SQL} SELECT particle_id, round(energy, 6) AS energy FROM obs ORDER BY obs.energy DESC, particle_id LIMIT 4096""",
)
def _(t: Tables):
    return rounded(ranking.top_energy(t.obs.select("particle_id", "energy"), 4096))


@query(
    "top_energy_per_sensor",
    "G1 F12",
    f"""WITH {OBS_SQL} SELECT sensor_id, particle_id, round(energy, 6) AS energy,
      row_number() OVER (PARTITION BY sensor_id ORDER BY obs.energy DESC, particle_id) AS rank FROM obs QUALIFY rank <= 100""",
)
def _(t: Tables):
    rows = t.obs.select("sensor_id", "particle_id", "energy")
    return rounded(ranking.top_energy(rows, 100, ["sensor_id"])).withColumn("rank", c("rank").cast("long"))


@query(
    "rank_functions",
    "F12",
    f"""WITH {OBS_SQL} SELECT particle_id, row_number() OVER t AS row_number, rank() OVER w AS rank,
      dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 6) AS percent_rank, ntile(4) OVER t AS ntile
    FROM obs WINDOW w AS (PARTITION BY timestamp_us // {DAY_US} ORDER BY energy DESC),
      t AS (PARTITION BY timestamp_us // {DAY_US} ORDER BY energy DESC, particle_id)""",
)
def _(t: Tables):
    rows = t.obs.select("particle_id", slice_of(c("timestamp_us"), DAY_US).alias("day"), "energy")
    out = ranked(rows, ["day"], "energy", "particle_id").drop("day", "energy")
    return rounded(out).select(
        "particle_id", "percent_rank", *[c(n).cast("long").alias(n) for n in ("row_number", "rank", "dense_rank", "ntile")]
    )


_QUERY_VECTOR = [((i * 37) % 101 - 50) / 100 for i in range(64)]


@query(
    "semantic_top5",
    "G2 J14",
    f"""WITH {WIN_SQL} SELECT vec_id, label, round(list_cosine_similarity(embedding, {_QUERY_VECTOR}::DOUBLE[]), 6) AS similarity
    FROM win ORDER BY list_cosine_similarity(embedding, {_QUERY_VECTOR}::DOUBLE[]) DESC, vec_id LIMIT 5""",
)
def _(t: Tables):
    top = ranking.query_semantic(_QUERY_VECTOR, t.windows, 5)
    return rounded(top.select("vec_id", "label", "similarity"))
