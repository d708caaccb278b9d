"""Queries for ordered operators and temporal joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromafield.functions import motif_edit_distance
from chromafield.functions.text import ADJECTIVES, NOUNS
from chromafield.operators import aggregates as A
from chromafield.operators import joins, ranking
from chromafield.operators import windows as W
from chromafield.operators.ordered import lag_rows, slice_of
from chromafield.plans.bindings import (
    DAY_US,
    HOUR_US,
    MINUTE_US,
    OBS_SQL,
    SENSOR_SQL,
    WIN_SQL,
    Tables,
    query,
    rounded,
)
from chromafield.session import store_table

c = F.col
BY_TIME = "PARTITION BY sensor_id ORDER BY timestamp_us, particle_id"
TIE = ["particle_id"]


@query(
    "carrier_temporal_difference",
    "F1",
    f"""WITH {OBS_SQL} SELECT particle_id, round(re - lag(re) OVER w, 6) + 0e0 AS d_re,
      round(im - lag(im) OVER w, 6) + 0e0 AS d_im FROM obs WINDOW w AS ({BY_TIME})""",
)
def _(t: Tables):
    rows = t.obs.select("sensor_id", "particle_id", "timestamp_us", "re", "im")
    out = W.temporal_diff(rows, ["re", "im"], ["sensor_id"], tie=TIE)
    return rounded(out.select("particle_id", "d_re", "d_im"))


@query(
    "observation_intervals",
    "F2",
    f"""WITH {OBS_SQL} SELECT particle_id, timestamp_us - lag(timestamp_us) OVER (
      PARTITION BY user_id ORDER BY timestamp_us, particle_id) AS dt_us FROM obs""",
)
def _(t: Tables):
    rows = t.obs.select("user_id", "particle_id", "timestamp_us")
    return W.delta_t(rows, ["user_id"], tie=TIE).select("particle_id", "dt_us")


@query(
    "decay_smoothing",
    "F3",
    f"""WITH {OBS_SQL}, d AS (SELECT user_id, particle_id, timestamp_us, energy,
        timestamp_us - lag(timestamp_us) OVER (PARTITION BY user_id ORDER BY timestamp_us, particle_id) AS dt FROM obs),
    b AS (SELECT *, CASE WHEN dt IS NULL THEN 1.0 ELSE 1.0 - exp(-dt / {6.0 * HOUR_US}) END * energy AS b FROM d)
    SELECT x.particle_id, round(sum(y.b * exp(-(x.timestamp_us - y.timestamp_us) / {6.0 * HOUR_US})), 6) AS smoothed
    FROM b x JOIN b y ON x.user_id = y.user_id AND y.timestamp_us <= x.timestamp_us GROUP BY 1""",
)
def _(t: Tables):
    rows = t.obs.select("user_id", "particle_id", "timestamp_us", "energy")
    out = W.decay_smooth(rows, ["user_id"], "energy", 6 * HOUR_US, tie=TIE)
    return rounded(out.select("particle_id", "smoothed"))


@query(
    "rolling_z_score",
    "F4",
    f"""WITH {OBS_SQL}, r AS (SELECT particle_id, energy, count(energy) OVER w AS n, avg(energy) OVER w AS m,
        stddev_pop(energy) OVER w AS sd FROM obs
        WINDOW w AS (PARTITION BY sensor_id ORDER BY timestamp_us RANGE BETWEEN {DAY_US} PRECEDING AND 1 PRECEDING))
    SELECT particle_id, CAST(n AS BIGINT) AS base_n, round(m + 1e-10, 6) AS base_mean, round(sd + 1e-10, 6) AS base_sd,
      round(CASE WHEN n > 2 THEN (energy - m) / nullif(sd, 0) END, 4) AS z FROM r""",
)
def _(t: Tables):
    rows = t.obs.select("sensor_id", "particle_id", "timestamp_us", "energy")
    out = W.rolling_z(rows, ["sensor_id"], "energy", DAY_US)
    return out.select(
        "particle_id",
        "base_n",
        # the nudge keeps exact decimal halves (means over 32 rows) off the rounding edge
        F.round(c("base_mean") + 1e-10, 6).alias("base_mean"),
        F.round(c("base_sd") + 1e-10, 6).alias("base_sd"),
        F.round(F.when(c("base_n") > 2, c("z")), 4).alias("z"),
    )


@query(
    "sustained_conditions",
    "F5",
    f"""WITH {OBS_SQL}, m AS (SELECT *, energy > 0.1001 AS ok, row_number() OVER ({BY_TIME}) AS i FROM obs),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY sensor_id, ok ORDER BY timestamp_us, particle_id) AS run FROM m)
    SELECT sensor_id, min(timestamp_us) AS start_us, max(timestamp_us) AS end_us, CAST(count(*) AS BIGINT) AS rows
    FROM g WHERE ok GROUP BY sensor_id, run HAVING count(*) >= 3""",
)
def _(t: Tables):
    rows = t.obs.select("sensor_id", "particle_id", "timestamp_us", "energy")
    return W.sustained(rows, ["sensor_id"], c("energy") > 0.1001, 3, tie=TIE)


def _name_sql(column: str) -> str:
    words = ["list_value(" + ", ".join(f"'{w}'" for w in ws) + ")" for ws in (ADJECTIVES, NOUNS)]
    md5 = f"md5(CAST({column} AS VARCHAR))"
    return (
        f"{words[0]}[CAST('0x' || substr({md5}, 1, 7) AS BIGINT) % 16 + 1] || '-' || "
        f"{words[1]}[CAST('0x' || substr({md5}, 8, 7) AS BIGINT) % 16 + 1]"
    )


@query(
    "motif_progress",
    "F6 I9",
    f"""WITH {OBS_SQL}, p AS (SELECT *, row_number() OVER w AS phase, count(*) OVER (PARTITION BY layer) AS total,
        min(timestamp_us) OVER (PARTITION BY layer) AS first, max(timestamp_us) OVER (PARTITION BY layer) AS last FROM obs
        WINDOW w AS (PARTITION BY layer ORDER BY timestamp_us, particle_id))
    SELECT layer AS motif, {_name_sql("layer")} AS name, phase, total AS phase_total, round(energy, 6) AS confidence,
      round((last - first) / ((total - 1) * 1e6) - (last - timestamp_us) / 1e6, 3) AS next_event_eta_secs,
      round(frequency_hz, 3) AS freq_hz, timestamp_us FROM p""",
)
def _(t: Tables):
    rows = t.obs.select(c("layer").alias("motif"), "particle_id", "timestamp_us", "frequency_hz", c("energy").alias("confidence"))
    out = W.motif_events(rows, tie=TIE)
    return out.withColumns(
        {
            "confidence": F.round("confidence", 6),
            "next_event_eta_secs": F.round("next_event_eta_secs", 3),
            "freq_hz": F.round("freq_hz", 3),
        }
    )


_SCAN = f"OVER ({BY_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND"


@query(
    "running_scans",
    "F7",
    f"""WITH {OBS_SQL} SELECT particle_id, round(sum(energy) {_SCAN} CURRENT ROW), 5) AS inclusive_sum,
      round(coalesce(sum(energy) {_SCAN} 1 PRECEDING), 0), 5) AS exclusive_sum,
      round(coalesce(product(1 - energy / 100) {_SCAN} 1 PRECEDING), 1), 6) AS exclusive_product,
      round(first_value(energy) {_SCAN} CURRENT ROW), 6) AS leader,
      bool_or(energy > 0.5) {_SCAN} CURRENT ROW) AS ballot FROM obs""",
)
def _(t: Tables):
    out = t.obs.select("sensor_id", "particle_id", "timestamp_us", "energy")
    e = c("energy")
    inputs = {
        "inclusive_sum": e,
        "exclusive_sum": e,
        "exclusive_product": 1 - e / 100,
        "leader": e,
        "ballot": e > 0.5,
    }
    from chromafield.operators.ordered import plan_width

    width = plan_width(out, ["sensor_id"], "timestamp_us")
    for kind, value in inputs.items():
        out = W.scan(out, value, kind, ["sensor_id"], tie=TIE, width=width, name=kind)
    return out.select(
        "particle_id",
        F.round("inclusive_sum", 5).alias("inclusive_sum"),
        F.round("exclusive_sum", 5).alias("exclusive_sum"),
        F.round("exclusive_product", 6).alias("exclusive_product"),
        F.round("leader", 6).alias("leader"),
        "ballot",
    )


@query(
    "hash_chain",
    "F8",
    f"""WITH RECURSIVE {OBS_SQL}, n AS (SELECT user_id, particle_id, timestamp_us, CAST(particle_id AS VARCHAR) || ':' || k AS p,
        row_number() OVER (PARTITION BY user_id ORDER BY timestamp_us, particle_id) AS i FROM obs),
    chain AS (SELECT user_id, i, particle_id, sha256(p) AS h FROM n WHERE i = 1
      UNION ALL SELECT n.user_id, n.i, n.particle_id, sha256(chain.h || n.p) FROM chain JOIN n
        ON n.user_id = chain.user_id AND n.i = chain.i + 1)
    SELECT particle_id, h AS chain_hash, TRUE AS chain_ok FROM chain""",
)
def _(t: Tables):
    rows = t.obs.select(
        "user_id", "particle_id", "timestamp_us", F.concat_ws(":", "particle_id", "k").alias("payload")
    )
    # a chain is stored when it is built and verified from the store
    built = store_table(W.build_chain(rows, ["user_id"], "payload", tie=TIE), "chain")
    return W.verify_chain(built, ["user_id"], "payload", tie=TIE).select(
        "particle_id", "chain_hash", "chain_ok"
    )


CHAIN_ROWS = 4
_FOLD = "list_reduce(list_prepend({start}, {texts}), lambda a, b: sha256(a || b))"


@query(
    "hash_chain_blocks",
    "F8",
    f"""WITH RECURSIVE {OBS_SQL}, n AS (SELECT sensor_id AS s, particle_id, CAST(particle_id AS VARCHAR) || ':' || k AS p,
        row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp_us, particle_id) - 1 AS i,
        count(*) OVER (PARTITION BY sensor_id) AS m FROM obs),
    lists AS (SELECT 0 AS l, s, i, p AS x, m FROM n
      UNION ALL
      SELECT l + 1, s, i // {CHAIN_ROWS}, {_FOLD.format(start="''", texts='list(x ORDER BY i)')},
        (m + {CHAIN_ROWS - 1}) // {CHAIN_ROWS}
      FROM lists WHERE m > {CHAIN_ROWS} GROUP BY l, s, i // {CHAIN_ROWS}, m),
    upto AS (SELECT l, s, i, list(x) OVER (PARTITION BY l, s, i // {CHAIN_ROWS} ORDER BY i) AS xs FROM lists),
    chain AS (SELECT l, s, i, {_FOLD.format(start="''", texts='xs')} AS h FROM upto WHERE i < {CHAIN_ROWS}
      UNION ALL
      SELECT upto.l, upto.s, upto.i, {_FOLD.format(start='chain.h', texts='xs')}
      FROM chain JOIN upto ON upto.l = chain.l - 1 AND upto.s = chain.s AND upto.i // {CHAIN_ROWS} = chain.i + 1)
    SELECT particle_id, h AS chain_hash, TRUE AS chain_ok FROM chain JOIN n USING (s, i) WHERE l = 0""",
)
def _(t: Tables):
    """Long sessions in short blocks: the chain of the blocks has several levels."""
    rows = t.obs.select(
        "sensor_id", "particle_id", "timestamp_us", F.concat_ws(":", "particle_id", "k").alias("payload")
    )
    chain = W.build_chain(rows, ["sensor_id"], "payload", tie=TIE, block_rows=CHAIN_ROWS)
    return W.verify_chain(
        store_table(chain, "chain"), ["sensor_id"], "payload", tie=TIE, block_rows=CHAIN_ROWS
    ).select("particle_id", "chain_hash", "chain_ok")


@query(
    "history_by_time",
    "F10",
    f"""WITH {OBS_SQL} SELECT particle_id, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(energy) OVER w, 6) AS total
    FROM obs WINDOW w AS (PARTITION BY sensor_id ORDER BY timestamp_us RANGE BETWEEN {HOUR_US} PRECEDING AND CURRENT ROW)""",
)
def _(t: Tables):
    rows = t.obs.select("sensor_id", "particle_id", "timestamp_us", "energy")
    out = W.history(rows, ["sensor_id"], "energy", span_us=HOUR_US)
    return rounded(_history_sums(out))


def _history_sums(out):
    return out.select(
        "particle_id",
        F.size("history").cast("long").alias("n"),
        F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    "shared_history_reach",
    "F10",
    f"""WITH {OBS_SQL} SELECT particle_id, CAST(count(*) OVER w AS BIGINT) AS n,
      CAST(count(*) OVER (PARTITION BY sensor_id ORDER BY timestamp_us) AS BIGINT) AS last,
      CAST(ceil(count(*) OVER (PARTITION BY sensor_id) / 64.0) AS BIGINT) AS blocks
    FROM obs WINDOW w AS (PARTITION BY sensor_id ORDER BY timestamp_us RANGE BETWEEN {30 * DAY_US} PRECEDING AND CURRENT ROW)""",
)
def _(t: Tables):
    """Thirty days of history per row, as references into shared blocks."""
    rows = t.obs.select("sensor_id", "particle_id", "timestamp_us", "energy")
    refs, blocks = W.shared_history(rows, ["sensor_id"], "energy", span_us=30 * DAY_US, tie=TIE, block_rows=64)
    number = blocks.groupBy("sensor_id").agg(F.count("*").alias("blocks"))
    return refs.join(number, "sensor_id").select(
        "particle_id", (c("history_to") - c("history_from") + 1).alias("n"), c("history_to").alias("last"), "blocks"
    )


@query(
    "history_by_rows",
    "F10",
    f"""WITH {OBS_SQL} SELECT particle_id, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(energy) OVER w, 6) AS total
    FROM obs WINDOW w AS ({BY_TIME} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""",
)
def _(t: Tables):
    rows = t.obs.select("sensor_id", "particle_id", "timestamp_us", "energy")
    return rounded(_history_sums(W.history(rows, ["sensor_id"], "energy", rows=120, tie=TIE)))


@query(
    "edge_stability",
    "F11",
    f"""WITH {OBS_SQL}, e AS (SELECT DISTINCT sensor_id AS src, coalesce(hue_class, 12) AS dst, timestamp_us // {6 * HOUR_US} AS frame FROM obs),
    m AS (SELECT e.*, EXISTS (SELECT 1 FROM e f WHERE f.src = e.src AND f.dst = e.dst AND f.frame = e.frame + 1) AS n1,
      EXISTS (SELECT 1 FROM e f WHERE f.src = e.src AND f.dst = e.dst AND f.frame = e.frame + 2) AS n2 FROM e)
    SELECT frame, CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (n1) AS BIGINT) AS kept,
      CAST(count(*) FILTER (NOT n1 AND n2) AS BIGINT) AS flips,
      round(avg(CASE WHEN n1 THEN 1.0 ELSE 0.0 END), 6) AS stability FROM m GROUP BY 1""",
)
def _(t: Tables):
    # 12: no pitch class
    edges = t.obs.select(
        c("sensor_id").alias("src"), F.coalesce("hue_class", F.lit(12)).alias("dst"), slice_of(c("timestamp_us"), 6 * HOUR_US).alias("frame")
    )
    return rounded(W.edge_stability(edges))


@query(
    "count_windows",
    "G6",
    f"""WITH {OBS_SQL}, n AS (SELECT *, row_number() OVER ({BY_TIME}) - 1 AS i FROM obs)
    SELECT sensor_id, i // 64 AS win, CAST(count(*) AS BIGINT) AS n, round(sum(energy), 6) AS energy,
      max(i % 64) AS last_offset FROM n GROUP BY 1, 2""",
)
def _(t: Tables):
    out = ranking.count_windows(t.obs.select("sensor_id", "particle_id", "timestamp_us", "energy"), 64, tie=TIE)
    return rounded(
        out.groupBy("sensor_id", c("window").alias("win")).agg(
            F.count("*").alias("n"), F.sum("energy").alias("energy"), F.max("offset").alias("last_offset")
        )
    )


@query(
    "motif_edit_distances",
    "I5 G6",
    f"""WITH {OBS_SQL}, n AS (SELECT *, row_number() OVER ({BY_TIME}) - 1 AS i FROM obs),
    s AS (SELECT sensor_id, i // 16 AS win, string_agg(CAST(layer AS VARCHAR), '' ORDER BY i) AS seq FROM n GROUP BY 1, 2)
    SELECT sensor_id, win, CAST(levenshtein(seq, lag(seq) OVER (PARTITION BY sensor_id ORDER BY win)) AS BIGINT) AS distance FROM s""",
)
def _(t: Tables):
    numbered = ranking.count_windows(
        t.obs.select("sensor_id", "particle_id", "timestamp_us", "layer"), 16, tie=TIE
    )
    seqs = numbered.groupBy("sensor_id", c("window").alias("win")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("offset", "layer"))), lambda x: x["layer"]).alias("seq")
    )
    pairs = lag_rows(seqs, ["sensor_id"], "win", ["seq"])
    return pairs.select(
        "sensor_id", "win", motif_edit_distance(c("seq"), c("prev_seq")).cast("long").alias("distance")
    )


# ---- temporal joins ------------------------------------------------------------------


@query(
    "environment_as_of",
    "D1",
    f"""WITH {OBS_SQL}, env AS (SELECT timestamp_us, energy AS temperature FROM obs WHERE layer = 3)
    SELECT o.particle_id, CASE WHEN o.timestamp_us - e.timestamp_us <= {HOUR_US} THEN e.timestamp_us END AS env_timestamp_us,
      round(CASE WHEN o.timestamp_us - e.timestamp_us <= {HOUR_US} THEN e.temperature END, 6) AS env_temperature
    FROM (SELECT * FROM obs WHERE layer <> 3) o ASOF LEFT JOIN env e ON o.timestamp_us >= e.timestamp_us""",
)
def _(t: Tables):
    left = t.obs.where("layer <> 3").select("particle_id", "timestamp_us")
    env = t.obs.where("layer = 3").select("timestamp_us", c("energy").alias("temperature"))
    return rounded(joins.asof_join(left, env, "timestamp_us", tolerance=HOUR_US).drop("timestamp_us"))


@query(
    "environment_as_of_per_sensor",
    "D1",
    f"""WITH {OBS_SQL}, env AS (SELECT sensor_id, timestamp_us, energy AS temperature FROM obs WHERE layer = 3)
    SELECT o.particle_id, o.sensor_id, e.timestamp_us AS env_timestamp_us, round(e.temperature, 6) AS env_temperature
    FROM (SELECT * FROM obs WHERE layer <> 3) o ASOF LEFT JOIN env e
      ON o.sensor_id = e.sensor_id AND o.timestamp_us >= e.timestamp_us""",
)
def _(t: Tables):
    left = t.obs.where("layer <> 3").select("particle_id", "sensor_id", "timestamp_us")
    env = t.obs.where("layer = 3").select("sensor_id", "timestamp_us", c("energy").alias("temperature"))
    return rounded(joins.asof_join(left, env, "timestamp_us", ["sensor_id"]).drop("timestamp_us"))


_PAIR_SQL = f"""{OBS_SQL}, a AS (SELECT * FROM obs WHERE layer = 0), b AS (SELECT * FROM obs WHERE layer = 1),
    n AS (SELECT a.particle_id AS a_id, a.timestamp_us AS a_us, p.particle_id AS p_id, p.timestamp_us AS p_us FROM a
      ASOF LEFT JOIN b p ON a.timestamp_us >= p.timestamp_us),
    m AS (SELECT n.*, q.particle_id AS q_id, q.timestamp_us AS q_us FROM n ASOF LEFT JOIN b q ON n.a_us <= q.timestamp_us),
    pairs AS (SELECT a_id, a_us, CASE WHEN q_us IS NULL OR a_us - p_us <= q_us - a_us THEN p_id ELSE q_id END AS b_id,
      CASE WHEN q_us IS NULL OR a_us - p_us <= q_us - a_us THEN p_us ELSE q_us END AS b_us FROM m)"""


def _pairs(t: Tables, tol: int):
    rows = t.obs.select("particle_id", "timestamp_us", "layer")
    return joins.clock_pairs(rows.where("layer = 0"), rows.where("layer = 1"), tol)


@query(
    "clock_pairs",
    "D4",
    f"""WITH {_PAIR_SQL} SELECT a_id, b_id, a_us, b_us, b_us - a_us AS divergence_us FROM pairs
    WHERE abs(b_us - a_us) <= {10 * MINUTE_US}""",
)
def _(t: Tables):
    return _pairs(t, 10 * MINUTE_US)


@query(
    "clock_drift",
    "E14 D4",
    f"""WITH {_PAIR_SQL}, f AS (SELECT a_us - (SELECT min(a_us) FROM pairs WHERE abs(b_us - a_us) <= {10 * MINUTE_US}) AS a,
        b_us - (SELECT min(a_us) FROM pairs WHERE abs(b_us - a_us) <= {10 * MINUTE_US}) AS b FROM pairs
        WHERE abs(b_us - a_us) <= {10 * MINUTE_US}),
    g AS (SELECT regr_slope(b, a) AS s, regr_intercept(b, a) AS i, CAST(count(*) AS BIGINT) AS n FROM f)
    SELECT round(s, 6) AS slope, round(i, 0) AS offset_us, n,
      round((SELECT max(abs(b - (g.s * a + g.i))) FROM f), 0) AS max_residual_us FROM g""",
)
def _(t: Tables):
    out = A.clock_drift(_pairs(t, 10 * MINUTE_US))
    return out.select(
        F.round("slope", 6).alias("slope"),
        F.round("offset_us", 0).alias("offset_us"),
        "n",
        F.round("max_residual_us", 0).alias("max_residual_us"),
    )


@query(
    "corroborated_events",
    "D16",
    f"""WITH {OBS_SQL}, b AS (SELECT timestamp_us FROM obs WHERE layer = 1)
    SELECT particle_id, timestamp_us FROM obs WHERE layer <> 1 AND EXISTS (
      SELECT 1 FROM b WHERE b.timestamp_us BETWEEN obs.timestamp_us - {2 * MINUTE_US} AND obs.timestamp_us + {2 * MINUTE_US})""",
)
def _(t: Tables):
    rows = t.obs.select("particle_id", "timestamp_us", "layer")
    return joins.corroborated(
        rows.where("layer <> 1").drop("layer"), rows.where("layer = 1"), 2 * MINUTE_US
    )


@query(
    "same_hue_pairs",
    "D6",
    f"""WITH {OBS_SQL}, s AS (SELECT hue_class, timestamp_us // {HOUR_US} AS bucket, sensor_id, sum(re) AS re, sum(im) AS im,
        count(*) AS n FROM obs WHERE hue_class IS NOT NULL GROUP BY 1, 2, 3)
    SELECT a.hue_class, a.bucket, a.sensor_id AS sensor_a, b.sensor_id AS sensor_b, CAST(a.n + b.n AS BIGINT) AS n,
      round(sqrt((a.re + b.re) ** 2 + (a.im + b.im) ** 2)
        / nullif(sqrt(a.re ** 2 + a.im ** 2) + sqrt(b.re ** 2 + b.im ** 2), 0), 6) AS coherence
    FROM s a JOIN s b ON a.hue_class = b.hue_class AND a.bucket = b.bucket AND a.sensor_id < b.sensor_id""",
)
def _(t: Tables):
    return rounded(joins.cohue_pairs(t.obs, HOUR_US))


@query(
    "event_relations",
    "D9",
    f"""WITH {OBS_SQL}, l AS (SELECT *, lag(particle_id) OVER w AS pid, lag(timestamp_us) OVER w AS pts FROM obs
        WINDOW w AS (ORDER BY timestamp_us, particle_id)),
    e AS (SELECT DISTINCT timestamp_us // {5 * MINUTE_US} AS w, sensor_id FROM obs)
    SELECT 'event:' || pid AS src, 'event:' || particle_id AS dst, 'PRECEDES' AS type, timestamp_us AS ts FROM l
      WHERE timestamp_us - pts > 0 AND timestamp_us - pts <= {5 * MINUTE_US}
    UNION ALL SELECT 'entity:' || a.sensor_id, 'entity:' || b.sensor_id, 'CO_OCCURS_WITH', a.w * {5 * MINUTE_US}
      FROM e a JOIN e b ON a.w = b.w AND a.sensor_id < b.sensor_id""",
)
def _(t: Tables):
    return joins.relate(t.obs.select("particle_id", "timestamp_us", "sensor_id"), 5 * MINUTE_US)


@query(
    "arrival_time_differences",
    "D10",
    f"""WITH {OBS_SQL}, {SENSOR_SQL}, f AS (SELECT user_id % 64 AS src, timestamp_us // {DAY_US} AS day, k % 8 AS sensor_id,
        min(timestamp_us) AS ts FROM obs GROUP BY 1, 2, 3),
    p AS (SELECT f.*, s.x, s.y, s.z FROM f JOIN sensors s USING (sensor_id))
    SELECT a.src, a.day, a.sensor_id AS sensor_a, b.sensor_id AS sensor_b, b.ts - a.ts AS dt_us,
      round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS baseline_m,
      abs(b.ts - a.ts) * 1e-6 * 0.01 <= sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS consistent
    FROM p a JOIN p b ON a.src = b.src AND a.day = b.day AND a.sensor_id < b.sensor_id""",
)
def _(t: Tables):
    heard = t.obs.select(
        (c("user_id") % 64).alias("src"),
        slice_of(c("timestamp_us"), DAY_US).alias("day"),
        (c("k") % 8).cast("int").alias("sensor_id"),
        "timestamp_us",
    )
    return rounded(joins.tdoa_pairs(heard, t.sensors, ["src", "day"], speed=F.lit(0.01)))


@query(
    "range_matches",
    "D18",
    f"""WITH {OBS_SQL}, m AS (SELECT particle_id AS id, CAST(round(energy * 500 * 1e6) AS BIGINT) AS r FROM obs WHERE layer = 0),
    s AS (SELECT particle_id AS id, CAST(round(energy * 500 * 1e6) AS BIGINT) AS r FROM obs WHERE layer = 1),
    d AS (SELECT m.id AS measured_id, min(abs(s.r - m.r)) AS delta FROM m JOIN s ON abs(s.r - m.r) <= 100000 GROUP BY 1)
    SELECT measured_id, round(delta / 1e6, 6) AS distance FROM d""",
)
def _(t: Tables):
    rows = t.obs.select(c("particle_id").alias("id"), (c("energy") * 500).alias("range_m"), "layer")
    out = joins.range_match(rows.where("layer = 0"), rows.where("layer = 1"), 0.10)
    return out.select("measured_id", F.round(F.abs("delta_m"), 6).alias("distance"))


@query(
    "hash_verification",
    "D17",
    f"""WITH {OBS_SQL}, h AS (SELECT particle_id AS block_id,
        upper(substr(sha256(concat(k, ':', layer, timestamp_us, 'serial-', sensor_id)), 1, 14)) AS prefix FROM obs)
    SELECT block_id, CASE WHEN block_id % 10 = 3 THEN 'missing' WHEN block_id % 10 = 7 THEN 'mismatch' ELSE 'match' END AS hash_state
    FROM h""",
)
def _(t: Tables):
    from chromafield.functions import block_hash, hash_prefix

    payload = F.concat(c("k"), F.lit(":"), c("layer"))
    blocks = t.obs.select(
        c("particle_id").alias("block_id"), payload.alias("payload"), "timestamp_us",
        F.concat(F.lit("serial-"), c("sensor_id")).alias("serial"),
    )
    # every tenth block is tampered with and another tenth is lost
    stored = F.when(c("block_id") % 10 == 7, F.concat(c("payload"), F.lit("!"))).otherwise(c("payload"))
    corpus = blocks.select(
        "block_id", hash_prefix(block_hash(stored, c("timestamp_us"), c("serial"))).alias("corpus_hash")
    )
    kept = blocks.where(c("block_id") % 10 != 3)
    return joins.verify_hashes(corpus, kept).select("block_id", "hash_state")


@query(
    "entity_anomaly",
    "E7",
    f"""WITH {WIN_SQL}, l AS (SELECT vec_id, label, list_distance(embedding, lag(embedding) OVER w) AS dev FROM win
        WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    s AS (SELECT *, count(dev) OVER p AS n, stddev_pop(dev) OVER p AS sd FROM l
      WINDOW p AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT vec_id, round(dev, 5) AS deviation, round(CASE WHEN n >= 2 THEN sd END, 5) AS sigma,
      round(CASE WHEN n >= 2 THEN dev / nullif(sd, 0) END, 3) AS anomaly_score FROM s""",
)
def _(t: Tables):
    rows = t.windows.select("vec_id", "label", "embedding")
    out = A.entity_anomaly(rows, ["label"], "vec_id")
    return out.select(
        "vec_id",
        F.round("deviation", 5).alias("deviation"),
        F.round("sigma", 5).alias("sigma"),
        F.round("anomaly_score", 3).alias("anomaly_score"),
    )


@query(
    "environment_step_changes",
    "E11",
    f"""WITH {OBS_SQL}, env AS (SELECT timestamp_us, energy AS temperature FROM obs WHERE layer = 3),
    j AS (SELECT o.particle_id, o.timestamp_us, o.energy, e.temperature FROM (SELECT * FROM obs WHERE layer <> 3) o
      ASOF LEFT JOIN env e ON o.timestamp_us >= e.timestamp_us),
    w AS (SELECT *, avg(energy) OVER b AS mb, avg(energy) OVER a AS ma, stddev_pop(energy) OVER b AS sd,
        count(energy) OVER b AS nb, corr(energy, temperature) OVER f AS cr FROM j
      WINDOW b AS (ORDER BY timestamp_us RANGE BETWEEN {12 * HOUR_US} PRECEDING AND 1 PRECEDING),
        a AS (ORDER BY timestamp_us RANGE BETWEEN CURRENT ROW AND {12 * HOUR_US - 1} FOLLOWING),
        f AS (ORDER BY timestamp_us RANGE BETWEEN {12 * HOUR_US} PRECEDING AND {12 * HOUR_US - 1} FOLLOWING))
    SELECT particle_id, round(mb + 1e-10, 6) AS mean_before, round(ma + 1e-10, 6) AS mean_after, round(CASE WHEN NOT isnan(cr) THEN cr END, 4) AS env_corr,
      CASE WHEN sd > 0 THEN round(abs(ma - mb) / sd, 4) ELSE 'inf'::DOUBLE END AS sigmas FROM w
    WHERE CASE WHEN sd > 0 THEN abs(ma - mb) / sd >= 0.3 ELSE sd = 0 AND nb > 1 AND ma <> mb END""",
)
def _(t: Tables):
    left = t.obs.where("layer <> 3").select("particle_id", "timestamp_us", "energy")
    env = t.obs.where("layer = 3").select("timestamp_us", c("energy").alias("temperature"))
    out = A.step_changes(left, "energy", 12 * HOUR_US, 0.3, env=env, env_col="temperature")
    return out.select(
        "particle_id",
        F.round(c("mean_before") + 1e-10, 6).alias("mean_before"),
        F.round(c("mean_after") + 1e-10, 6).alias("mean_after"),
        F.round("env_corr", 4).alias("env_corr"),
        F.round("sigmas", 4).alias("sigmas"),
    )


