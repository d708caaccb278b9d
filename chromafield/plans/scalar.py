"""Queries for the column functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chromafield import functions as C
from chromafield.functions.text import ADJECTIVES, NOUNS
from chromafield.operators import joins
from chromafield.plans.bindings import OBS_SQL, WIN_SQL, Tables, nudged, query, rounded
from chromafield.schemas import LOG_RANGE, MATERIALS
from chromafield.session import broadcast_if_small

c = F.col


@query(
    "frequency_color_mapping",
    "B1 B2 B3",
    f"""WITH {OBS_SQL}
    SELECT particle_id, round(least(1.0, ln(greatest(frequency_hz, 1.0)) / {LOG_RANGE!r}), 6) AS hue,
      hue_class AS material_id,
      round(CASE WHEN frequency_hz >= 20 THEN
        frequency_hz / pow(2, greatest(0, ceil(log2(frequency_hz / 1000) - 1e-9))) END, 6) AS tone_hz
    FROM obs""",
)
def _(t: Tables):
    f = c("frequency_hz")
    return rounded(
        t.obs.select(
            "particle_id",
            C.freq_to_hue(f).alias("hue"),
            C.freq_to_material_id(f).alias("material_id"),
            C.octave_fold(f).alias("tone_hz"),
        )
    )


@query(
    "sql_color_functions",
    "B1 B2 B3 B10",
    f"""WITH {OBS_SQL}, g AS (
      SELECT *, frequency_hz / pow(2, greatest(0, ceil(log2(greatest(frequency_hz, 20) / 1000) - 1e-9))) AS fold FROM obs),
    m AS (SELECT *, unnest([0, layer + 35]) AS bit FROM g)
    SELECT hue_class AS material_id, bit, CAST(count(*) AS BIGINT) AS n,
      round(avg(least(1.0, ln(greatest(frequency_hz, 1.0)) / {LOG_RANGE!r})), 6) AS hue,
      round(avg(CASE WHEN frequency_hz >= 20 THEN CASE WHEN fold > 1000 THEN fold / 2 ELSE fold END END), 5) AS folded_hz
    FROM m GROUP BY 1, 2""",
)
def _(t: Tables):
    C.register_sql_functions(t.spark)
    t.obs.createOrReplaceTempView("chromafield_obs")
    return t.spark.sql(
        "SELECT freq_to_material_id(frequency_hz) AS material_id, bit, count(*) AS n, "
        "round(avg(freq_to_hue(frequency_hz)), 6) AS hue, round(avg(octave_fold(frequency_hz)), 5) AS folded_hz "
        "FROM chromafield_obs, LATERAL explode_mask(shiftleft(1L, layer + 35) | 1L) GROUP BY 1, 2"
    )


@query(
    "particle_colors",
    "B4 B5 B6",
    f"""WITH {OBS_SQL}, h AS (
      SELECT particle_id, hue_class / 12.0 AS h, 1 / (1 + k * 1e4 / 1e5) AS s, least(1.0, energy) AS l,
        4.5 * least(1.0, ln(greatest(frequency_hz, 1.0)) / {LOG_RANGE!r}) AS h6,
        1 / (1 + (k / 100.0) / 0.37) AS cs,
        CASE WHEN energy * 500 > 110 THEN 3 WHEN energy * 500 > 80 THEN 2
          WHEN energy * 500 > 50 THEN 1 ELSE 0 END AS level
      FROM obs)
    SELECT particle_id, round(h + 1e-10, 6) AS h, round(s + 1e-10, 6) AS s, round(l + 1e-10, 6) AS l,
      round(l - l * cs * greatest(0, least((5 + h6) % 6, 4 - (5 + h6) % 6, 1)) + 1e-10, 6) AS red,
      round(l - l * cs * greatest(0, least((3 + h6) % 6, 4 - (3 + h6) % 6, 1)) + 1e-10, 6) AS green,
      round(l - l * cs * greatest(0, least((1 + h6) % 6, 4 - (1 + h6) % 6, 1)) + 1e-10, 6) AS blue,
      level FROM h""",
)
def _(t: Tables):
    gamma = F.least(F.lit(1.0), c("energy"))
    rgba = C.particle_color(c("frequency_hz"), gamma, c("k") / 100, 0.37)
    return nudged(
        t.obs.select(
            "particle_id",
            C.hsl(c("frequency_hz"), gamma, c("k") * F.lit(1e4), 1e5).alias("_hsl"),
            rgba.alias("_rgba"),
            C.level_bucket(c("energy") * 500).alias("level"),
        ).select(
            "particle_id",
            "_hsl.*",
            *[c("_rgba")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))],
            "level",
        )
    )


@query(
    "clock_ticks_to_us",
    "B7",
    f"""WITH {OBS_SQL}
    SELECT particle_id, CAST(floor((timestamp_us - 1704067200000000) * 14 + k) AS BIGINT)
      // 14 AS session_us FROM obs""",
)
def _(t: Tables):
    # a 14 MHz counter started at the session epoch
    counter = (c("timestamp_us") - F.lit(1_704_067_200_000_000)) * 14 + c("k") + 5_000
    return t.obs.select(
        "particle_id", C.qpc_to_us(counter, F.lit(5_000), F.lit(14_000_000)).alias("session_us")
    )


@query(
    "iq_features",
    "B8",
    f"""WITH {OBS_SQL}
    SELECT particle_id, round(sqrt(re * re + im * im), 6) AS amplitude, round(CASE WHEN re * re + im * im > 0 THEN atan2(im, re) END, 5) AS phase,
      round(re * re + im * im, 6) AS power,
      round(CASE WHEN energy > 0 THEN 10 * log10(re * re + im * im) END, 5) AS power_db FROM obs""",
)
def _(t: Tables):
    out = C.iq_features(t.obs, "re", "im")
    return out.select(
        "particle_id",
        F.round("amplitude", 6).alias("amplitude"),
        F.round("phase", 5).alias("phase"),
        F.round("power", 6).alias("power"),
        F.round("power_db", 5).alias("power_db"),
    )


@query(
    "source_and_mask_codes",
    "B9 B10",
    f"""WITH {OBS_SQL}, m AS (
      SELECT particle_id, hue_class, user_id, (particle_id * 40503 + k) % 65536 AS mask FROM obs)
    SELECT particle_id, hue_class * 16777216 + user_id AS source_id, hue_class AS hue_part,
      CASE WHEN hue_class IS NOT NULL THEN user_id END AS device_part, CAST(bit_count(mask) AS BIGINT) AS members,
      array_to_string(list_filter(range(0, 32), lambda b: (mask >> b) % 2 = 1), ',') AS member_list
    FROM m""",
)
def _(t: Tables):
    mask = F.pmod(c("particle_id") * 40503 + c("k"), F.lit(65536))
    src = C.pack_source(c("hue_class"), c("user_id"))
    out = t.obs.select(
        "particle_id", src.alias("source_id"), mask.alias("_m")
    )
    parts = C.unpack_source(c("source_id"))
    return out.select(
        "particle_id",
        "source_id",
        parts["hue_class"].alias("hue_part"),
        parts["device"].alias("device_part"),
        C.mask_count(c("_m")).cast("long").alias("members"),
        F.array_join(C.mask_members(c("_m")).cast("array<string>"), ",").alias("member_list"),
    )


_UNITS = "CASE layer WHEN 0 THEN 'Hz' WHEN 1 THEN 'kHz' WHEN 2 THEN 'MHz' ELSE 'GHz' END"


@query(
    "tuner_frequencies",
    "B11",
    f"""WITH {OBS_SQL}, u AS (SELECT particle_id, k * CASE layer WHEN 0 THEN 1e0 WHEN 1 THEN 1e3
        WHEN 2 THEN 1e6 ELSE 1e9 END AS hz FROM obs)
    SELECT particle_id, round(hz, 3) AS hz, round(least(greatest(hz, 24e6), 1766e6), 3) AS clamped_hz,
      hz < 24e6 OR hz > 1766e6 AS warn FROM u""",
)
def _(t: Tables):
    f = C.normalize_freq(c("k").cast("double"), F.expr(_UNITS), 24e6, 1766e6)
    return rounded(t.obs.select("particle_id", f.alias("_f")).select("particle_id", "_f.*"), 3)


_MATERIAL = "CASE layer WHEN 0 THEN 'dry_concrete' WHEN 1 THEN 'glass' WHEN 2 THEN 'wood' WHEN 3 THEN 'human_body' ELSE 'wet_concrete' END"
_MATERIAL_ROWS = ", ".join(f"('{n}', {r!r}, {i!r})" for n, r, i in MATERIALS)


@query(
    "surface_reflectance",
    "B12 B13 D15",
    f"""WITH {OBS_SQL}, m(material, er, ei) AS (VALUES {_MATERIAL_ROWS}), j AS (
      SELECT particle_id, frequency_hz AS f, k / 1e4 AS s, k / 100.0 * {math.pi / 2!r} AS th, material,
        CAST(er AS DOUBLE) AS er, CAST(ei AS DOUBLE) AS ei
      FROM (SELECT *, {_MATERIAL} AS material FROM obs) JOIN m USING (material)),
    w AS (SELECT *, cos(th) AS ct, er - sin(th) * sin(th) AS a FROM j),
    v AS (SELECT *, sqrt(greatest(0, (sqrt(a * a + ei * ei) + a) / 2)) AS wr,
        -sqrt(greatest(0, (sqrt(a * a + ei * ei) - a) / 2)) AS wi FROM w)
    SELECT particle_id, material, round(s * f / 299792458.0, 6) AS alpha,
      s * 8 * ct > 299792458.0 / nullif(f, 0) AS rough,
      round(((ct - wr) ** 2 + wi * wi) / ((ct + wr) ** 2 + wi * wi), 6) AS te,
      round(((er * ct - wr) ** 2 + (-ei * ct - wi) ** 2) / ((er * ct + wr) ** 2 + (-ei * ct + wi) ** 2), 6) AS tm
    FROM v""",
)
def _(t: Tables):
    obs = t.obs.withColumns(
        {
            "material": F.expr(_MATERIAL),
            "theta": c("k") / F.lit(100.0) * F.lit(math.pi / 2),
            "rough": C.rf_roughness(c("k") / F.lit(1e4), c("frequency_hz"), c("k") / F.lit(100.0) * F.lit(math.pi / 2)),
        }
    )
    out = joins.reflectance(obs, joins.materials_frame(t.spark), "theta")
    return rounded(
        out.select(
            "particle_id",
            "material",
            c("rough.alpha").alias("alpha"),
            c("rough.rough").alias("rough"),
            c("reflectance.te").alias("te"),
            c("reflectance.tm").alias("tm"),
        )
    )


@query(
    "wet_surface_permittivity",
    "B14",
    f"""WITH {OBS_SQL}, t AS (SELECT 300.0 / 298.15 - 1 AS t), q AS (
      SELECT 77.66 + 103.3 * t AS st, 0.0671 * (77.66 + 103.3 * t) AS md,
        20.20 - 146.0 * t + 316.0 * t * t AS r1 FROM t),
    g AS (SELECT particle_id, layer, k / 100.0 AS s, frequency_hz / 1e9 AS ghz FROM obs)
    SELECT particle_id,
      round(2.0 + layer + s * ((st - md) / (1 + (ghz / r1) ** 2) + (md - 3.52) / (1 + (ghz / (39.8 * r1)) ** 2) + 2.52), 6) AS eps_r,
      round(s * ((st - md) * (ghz / r1) / (1 + (ghz / r1) ** 2)
        + (md - 3.52) * (ghz / (39.8 * r1)) / (1 + (ghz / (39.8 * r1)) ** 2)), 6) AS eps_i
    FROM g CROSS JOIN q""",
)
def _(t: Tables):
    eps = C.wet_permittivity(c("frequency_hz"), c("layer") + F.lit(2.0), c("k") / F.lit(100.0))
    return rounded(t.obs.select("particle_id", eps.alias("_e")).select("particle_id", "_e.*"))


@query(
    "propagation_and_bearing",
    "B15 B16 B17 B18 B22",
    f"""WITH {OBS_SQL}, v AS (
      SELECT *, k * 0.5 - 10 AS tc, 950 + k AS p, k AS rh, 20 + layer * 80.0 AS af FROM obs),
    e AS (SELECT *, rh / 100.0 * (1 + 1e-4 * (7.2 + p * (0.0320 + 5.9e-6 * tc * tc))) * 6.1121
        * exp((18.678 - tc / 234.5) * tc / (tc + 257.14)) AS ev, tc + 273.15 AS kel,
        (k - 50) / 20.0 * (299792458.0 / nullif(frequency_hz, 0)) / (2 * pi() * 12.0) AS sx FROM v)
    SELECT particle_id,
      round(299792458.0 / (1 + 77.6 / kel * (p + 4810.0 * ev / kel) * 1e-6), 3) AS speed,
      round(CASE WHEN abs(sx) <= 1 THEN asin(CASE WHEN abs(sx) <= 1 THEN sx ELSE 0 END) END, 6) AS bearing,
      round(299792458.0 * (k / nullif(frequency_hz, 0)) + 1e-9, 6) AS radial_velocity,
      round(1e6 * log2(1 + pow(10, k / 2.0 / 10)), 3) AS capacity_bps, round(pow(2, k / 2.0 / 3), 3) AS qam_ceiling,
      round(CASE WHEN af < 80 THEN energy ELSE 0 END, 6) AS lf,
      round(CASE WHEN af >= 80 AND af <= 300 THEN energy ELSE 0 END, 6) AS hf
    FROM e""",
)
def _(t: Tables):
    f = c("frequency_hz")
    link = C.link_budget(F.lit(1e6), c("k") / F.lit(2.0))
    split = C.lf_hf_split(c("layer") * F.lit(80.0) + 20, c("energy"))
    out = t.obs.select(
        "particle_id",
        F.round(C.propagation_speed(c("k") * F.lit(0.5) - 10, c("k") + F.lit(950), c("k")), 3).alias("speed"),
        F.round(C.bearing((c("k") - 50) / F.lit(20.0), f, F.lit(12.0)), 6).alias("bearing"),
        F.round(C.radial_velocity(c("k"), f) + 1e-9, 6).alias("radial_velocity"),
        link.alias("_l"),
        split.alias("_s"),
    )
    return out.select(
        "particle_id",
        "speed",
        "bearing",
        "radial_velocity",
        F.round("_l.capacity_bps", 3).alias("capacity_bps"),
        F.round("_l.qam_ceiling", 3).alias("qam_ceiling"),
        F.round("_s.lf", 6).alias("lf"),
        F.round("_s.hf", 6).alias("hf"),
    )


@query(
    "block_hashes",
    "B19",
    f"""WITH {OBS_SQL}
    SELECT particle_id, sha256(concat(k, ':', layer, timestamp_us, 'serial-', sensor_id)) AS digest,
      upper(substr(sha256(concat(k, ':', layer, timestamp_us, 'serial-', sensor_id)), 1, 14)) AS prefix
    FROM obs""",
)
def _(t: Tables):
    payload = F.concat(c("k"), F.lit(":"), c("layer"))
    digest = C.block_hash(payload, c("timestamp_us"), F.concat(F.lit("serial-"), c("sensor_id")))
    return t.obs.select(
        "particle_id", digest.alias("digest"), F.hex(C.hash_prefix(digest)).alias("prefix")
    )


@query(
    "embedding_and_covariance_shapes",
    "B20 B21 B23",
    f"""WITH {WIN_SQL}
    SELECT vec_id, round(list_sum(list_slice(embedding, 1, 14)), 6) AS prefix_sum,
      CAST(len(list_slice(embedding, 1, 12)) AS BIGINT) AS short_len,
      round(embedding[2] + embedding[5] + embedding[3], 6) AS lower_sum,
      round(embedding[1] + embedding[6], 6) AS packed_sum,
      round((abs(embedding[1]) + abs(embedding[2]) + abs(embedding[3])) * 2.4e9 / 299792458.0
        - floor((abs(embedding[1]) + abs(embedding[2]) + abs(embedding[3])) * 2.4e9 / 299792458.0), 6) AS phase,
      cos(2 * pi() * (abs(embedding[1]) + abs(embedding[2]) + abs(embedding[3])) * 2.4e9 / 299792458.0) >= 0
        AS constructive
    FROM win""",
)
def _(t: Tables):
    e = F.transform("embedding", lambda v: v.cast("double"))
    m = C.cov_expand(F.slice(e, 1, 6))
    legs = F.transform(F.slice(e, 1, 3), lambda v: F.abs(v))
    out = t.windows.select(
        "vec_id",
        F.aggregate(C.embedding_prefix(e, 14), F.lit(0.0), lambda a, v: a + v).alias("prefix_sum"),
        F.size(C.embedding_prefix(e, 12)).cast("long").alias("short_len"),
        (m[1][0] + m[2][1] + m[2][0]).alias("lower_sum"),
        (C.cov_pack(m)[0] + C.cov_pack(m)[5]).alias("packed_sum"),
        C.path_phase(legs, F.lit(2.4e9)).alias("_p"),
    )
    return rounded(out.select("*", "_p.*").drop("_p"))


@query(
    "capture_names_and_days",
    "I1 I2",
    f"""WITH {OBS_SQL}
    SELECT particle_id, 'rx' AS kind, CASE WHEN layer = 4 THEN NULL ELSE 's' || sensor_id END AS device,
      (timestamp_us // 1000000) * 1000000 AS captured_us, 'iq' AS extension,
      strftime(make_timestamp(timestamp_us), '%Y-%m-%d') AS day FROM obs""",
)
def _(t: Tables):
    stamp = F.date_format(F.timestamp_micros("timestamp_us"), "yyyyMMdd'T'HHmmss")
    device = F.when(c("layer") == 4, F.lit("")).otherwise(F.concat(F.lit("_s"), c("sensor_id")))
    name = F.concat(F.lit("captures/rx"), device, F.lit("_"), stamp, F.lit(".iq"))
    out = t.obs.select("particle_id", "timestamp_us", C.parse_capture_name(name).alias("p"))
    return out.select(
        "particle_id",
        "p.kind",
        "p.device",
        F.unix_micros("p.captured_at").alias("captured_us"),
        "p.extension",
        C.corpus_day(c("timestamp_us")).cast("string").alias("day"),
    )


@query(
    "particle_json_lines",
    "I3",
    f"""WITH {OBS_SQL}
    SELECT particle_id, CASE WHEN k = 13 THEN NULL ELSE timestamp_us END AS timestamp_us,
      CASE WHEN k = 13 THEN NULL ELSE CAST(layer AS INT) END AS layer,
      k = 13 AS corrupt FROM obs""",
)
def _(t: Tables):
    good = F.to_json(F.struct("timestamp_us", "layer", c("energy").alias("energy")))
    line = F.when(c("k") == 13, F.lit('{"timestamp_us": oops')).otherwise(good)
    out = t.obs.select("particle_id", C.parse_particle(line).alias("p"))
    return out.select(
        "particle_id",
        c("p.timestamp_us").alias("timestamp_us"),
        c("p.layer").cast("int").alias("layer"),
        c("p._corrupt").isNotNull().alias("corrupt"),
    )


@query(
    "settings_violations",
    "I4",
    f"""WITH {OBS_SQL}
    SELECT particle_id, concat_ws(';', CASE WHEN layer = 4 THEN 'material unknown' END,
      CASE WHEN k % 7 = 0 THEN 'center needs 3 numbers' END,
      CASE WHEN k % 11 = 0 THEN 'size must be positive' END,
      CASE WHEN k > 90 THEN 'wetness outside 0..1' END) AS violations FROM obs""",
)
def _(t: Tables):
    material = F.when(c("layer") == 4, "plasma").otherwise("glass")
    one = F.lit(1.0)
    center = F.when(c("k") % 7 == 0, F.array(one)).otherwise(F.array(one, one, one))
    size = F.when(c("k") % 11 == 0, F.array(one, F.lit(0.0), one)).otherwise(F.array(one, one, one))
    doc = F.to_json(
        F.struct(
            material.alias("material"),
            center.alias("center"),
            size.alias("size"),
            (c("k") / F.lit(90.0)).alias("wetness"),
            F.lit(2.5).alias("permittivity"),
        )
    )
    out = C.validate_settings(t.obs.select("particle_id", doc.alias("settings")))
    return out.select("particle_id", F.array_join("violations", ";").alias("violations"))


_WORDS = [
    "list_value(" + ", ".join(f"'{w}'" for w in words) + ")" for words in (ADJECTIVES, NOUNS)
]


@query(
    "motif_names",
    "I9",
    f"""SELECT label AS motif, CAST(count(*) AS BIGINT) AS n,
      any_value({_WORDS[0]}[CAST('0x' || substr(md5(CAST(label AS VARCHAR)), 1, 7) AS BIGINT) % 16 + 1]) || '-' ||
      any_value({_WORDS[1]}[CAST('0x' || substr(md5(CAST(label AS VARCHAR)), 8, 7) AS BIGINT) % 16 + 1]) AS name
    FROM embeddings GROUP BY label""",
)
def _(t: Tables):
    return (
        t.windows.groupBy(c("label").alias("motif"))
        .agg(F.count("*").alias("n"))
        .withColumn("name", C.motif_name(c("motif")))
    )


@query(
    "vector_similarity",
    "I7 I12",
    f"""WITH {WIN_SQL}, q AS (SELECT label, arg_min(embedding, vec_id) AS head FROM win GROUP BY label)
    SELECT vec_id, round(list_inner_product(embedding, head), 6) AS dot,
      round(list_cosine_similarity(embedding, head), 6) AS cosine,
      round(list_distance(embedding, head), 5) AS l2,
      isnan(CASE WHEN vec_id % 5 = 0 THEN CAST('nan' AS DOUBLE) ELSE embedding[1] END) AS diagnostic
    FROM win JOIN q USING (label)""",
)
def _(t: Tables):
    heads = t.windows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    e, h = c("embedding"), c("head")
    reading = F.when(c("vec_id") % 5 == 0, F.lit(float("nan"))).otherwise(e[0].cast("double"))
    return t.windows.join(broadcast_if_small(heads), "label").select(
        "vec_id",
        F.round(C.dot(e, h), 6).alias("dot"),
        F.round(C.cosine(e, h), 6).alias("cosine"),
        F.round(C.l2(e, h), 5).alias("l2"),
        C.is_diagnostic(reading).alias("diagnostic"),
    )
