"""Queries for neighbour search, densities, graphs, signal windows and models."""

from __future__ import annotations



from pyspark.sql import functions as F

from chromafield.operators import aggregates as A
from chromafield.operators import graph as G
from chromafield.operators import models as M
from chromafield.operators import ranking, signal, spatial

from chromafield.operators.ordered import slice_of
from chromafield.operators.vector_index import build_index
from chromafield.plans.bindings import (
    HOUR_US,
    MINUTE_US,
    OBS_SQL,
    WIN_SQL,
    Tables,
    query,
    rounded,
)
from chromafield.session import scratch_path, store_table

c = F.col
TIE = ["particle_id"]
_D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"


def _points(t: Tables):
    return t.windows.select(c("vec_id").alias("id"), "label", "x", "y", "z")


@query(
    "nearest_neighbours",
    "D7",
    f"""WITH {WIN_SQL}, p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_D2} AS d2 FROM win a JOIN win b ON a.vec_id <> b.vec_id)
    SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY d2, neighbour) AS rank, round(sqrt(d2), 6) AS distance
    FROM p QUALIFY rank <= 20""",
)
def _(t: Tables):
    out = spatial.knn(_points(t), 20)
    return rounded(out.withColumn("rank", c("rank").cast("long")))


@query(
    "radius_neighbours",
    "D8",
    f"""WITH {WIN_SQL} SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(sqrt({_D2}), 6) AS distance
    FROM win a JOIN win b ON a.label < 5 AND b.label >= 5 AND {_D2} <= 0.0081""",
)
def _(t: Tables):
    p = _points(t)
    return rounded(spatial.radius_join(p.where("label < 5"), p.where("label >= 5"), 0.09))


@query(
    "spatial_near_edges",
    "D8",
    f"""WITH {OBS_SQL}, h AS (SELECT x, y, z, min(particle_id) AS id FROM obs GROUP BY 1, 2, 3)
    SELECT a.id AS src, b.id AS dst, round(sqrt({_D2}), 6) AS distance FROM h a JOIN h b ON a.id < b.id AND {_D2} <= 1.21
    UNION ALL SELECT h.id, o.particle_id, 0e0 FROM obs o JOIN h USING (x, y, z) WHERE o.particle_id > h.id""",
)
def _(t: Tables):
    points = t.obs.select(c("particle_id").alias("id"), "x", "y", "z")
    return rounded(spatial.near_edges(points, 1.1))


@query(
    "rf_without_geometry",
    "D11",
    f"""WITH {WIN_SQL}, p AS (SELECT *, abs(embedding[4]) AS energy FROM win)
    SELECT vec_id AS id, round(energy, 6) AS energy FROM p a WHERE label < 5 AND energy >= 0.02 AND NOT EXISTS (
      SELECT 1 FROM p b WHERE b.label >= 5 AND {_D2} <= 0.0036)""",
)
def _(t: Tables):
    p = t.windows.select(
        c("vec_id").alias("id"), "label", "x", "y", "z", F.abs(c("embedding")[3].cast("double")).alias("energy")
    )
    out = spatial.rf_without_geometry(p.where("label < 5"), p.where("label >= 5"), 0.06, 0.02)
    return rounded(out.select("id", "energy"))


_H = 0.15


@query(
    "kernel_density",
    "E18",
    f"""WITH {WIN_SQL} SELECT a.vec_id AS id, round(sum(315.0 / (64 * pi() * {_H!r} ** 9) * ({_H!r} ** 2 - ({_D2})) ** 3), 3) AS density
    FROM win a JOIN win b ON {_D2} <= {_H!r} ** 2 GROUP BY 1""",
)
def _(t: Tables):
    return rounded(spatial.kernel_density(_points(t), _H).select("id", "density"), 3)


@query(
    "density_gradient",
    "E19",
    f"""WITH {WIN_SQL}, g AS (SELECT a.vec_id AS id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt({_D2}) AS r
      FROM win a JOIN win b ON {_D2} <= {_H!r} ** 2),
    s AS (SELECT id, CASE WHEN r > 0 THEN 45.0 / (pi() * {_H!r} ** 6) * ({_H!r} - r) ** 2 / r ELSE 0 END AS w, dx, dy, dz FROM g)
    SELECT id, round(sqrt(sum(w * dx) ** 2 + sum(w * dy) ** 2 + sum(w * dz) ** 2), 2) AS gradient FROM s GROUP BY 1""",
)
def _(t: Tables):
    return rounded(spatial.density_gradient(_points(t), _H).select("id", "gradient"), 2)


# ---- signal windows ------------------------------------------------------------------

_N = 64
_NUM_SQL = f"""{OBS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp_us, particle_id) - 1 AS i FROM obs),
    s AS (SELECT sensor_id, i // {_N} AS win, i % {_N} AS o, re, im, energy FROM n)"""


def _samples(t: Tables):
    return t.obs.select("sensor_id", "particle_id", "timestamp_us", "re", "im", "energy")


@query(
    "spectrum",
    "J1",
    f"""WITH {_NUM_SQL}, f AS (SELECT sensor_id, win, b.bin, 2 * pi() * ((b.bin * o) % {_N}) / {_N} AS a, re, im
      FROM s, (SELECT unnest(range(0, {_N})) AS bin) b),
    g AS (SELECT sensor_id, win, bin, sum(re * cos(a) + im * sin(a)) AS re, sum(im * cos(a) - re * sin(a)) AS im FROM f GROUP BY 1, 2, 3)
    SELECT sensor_id, win, bin, round((CASE WHEN bin < {_N // 2} THEN bin ELSE bin - {_N} END) * 1000.0 / {_N}, 6) AS frequency_hz,
      round(re, 5) + 0e0 AS re, round(im, 5) + 0e0 AS im, round(re * re + im * im, 5) AS power FROM g""",
)
def _(t: Tables):
    out = signal.spectrum(_samples(t), _N, 1000.0, tie=TIE).withColumnRenamed("window", "win")
    return out.select(
        "sensor_id",
        "win",
        c("bin").cast("long").alias("bin"),
        F.round("frequency_hz", 6).alias("frequency_hz"),
        *[F.round(n, 5).alias(n) for n in ("re", "im", "power")],
    )


@query(
    "dominant_chords",
    "G3 J1 B3",
    f"""WITH {_NUM_SQL}, f AS (SELECT sensor_id, win, b.bin, 2 * pi() * ((b.bin * o) % {_N}) / {_N} AS a, re, im
      FROM s, (SELECT unnest(range(0, {_N})) AS bin) b),
    g AS (SELECT sensor_id, win, bin, sum(re * cos(a) + im * sin(a)) ** 2 + sum(im * cos(a) - re * sin(a)) ** 2 AS power
      FROM f GROUP BY 1, 2, 3),
    h AS (SELECT *, (CASE WHEN bin < {_N // 2} THEN bin ELSE bin - {_N} END) * 4e6 / {_N} AS fr FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, win ORDER BY power DESC, fr) AS rank FROM h)
    SELECT sensor_id, win, rank, round(fr, 3) AS frequency_hz, round(CASE WHEN fr >= 20 THEN
      fr / pow(2, greatest(0, ceil(log2(greatest(fr, 1) / 1000) - 1e-9))) END, 6) AS tone_hz FROM r WHERE rank <= 3""",
)
def _(t: Tables):
    spec = signal.spectrum(_samples(t), _N, 4e6, tie=TIE)
    out = ranking.dominant_bins(spec, 3)
    return out.select(
        "sensor_id",
        c("window").alias("win"),
        c("rank").cast("long").alias("rank"),
        F.round("frequency_hz", 3).alias("frequency_hz"),
        F.round("tone_hz", 6).alias("tone_hz"),
    )


def _dwt_sql(taps: int, levels: int) -> str:
    low = signal.DAUBECHIES[taps]
    high = [(-1) ** i * low[taps - 1 - i] for i in range(taps)]
    values = ", ".join(f"({i}, {lo!r}, {hi!r})" for i, (lo, hi) in enumerate(zip(low, high)))
    size, steps = _N, []
    for level in range(1, levels + 1):
        size //= 2
        source = "a0" if level == 1 else f"a{level - 1}"
        # output position p takes input positions (2p + tap) mod length
        steps.append(
            f"a{level} AS (SELECT sensor_id, win, p, sum(v * CAST(lo AS DOUBLE)) AS v, sum(v * CAST(hi AS DOUBLE)) AS d "
            f"FROM (SELECT unnest(range(0, {size})) AS p) g, taps JOIN {source} x ON true "
            f"WHERE x.p0 = (2 * g.p + taps.i) % {size * 2} GROUP BY 1, 2, 3)"
            .replace("sensor_id, win, p, sum", "sensor_id, win, g.p AS p0, sum", 1)
        )
    parts = [
        f"SELECT sensor_id, win, CAST({lv} AS BIGINT) AS level, sum(d * d) AS energy FROM a{lv} GROUP BY 1, 2"
        for lv in range(1, levels + 1)
    ]
    parts.append(f"SELECT sensor_id, win, CAST({levels + 1} AS BIGINT), sum(v * v) FROM a{levels} GROUP BY 1, 2")
    return (
        f"WITH {_NUM_SQL}, taps(i, lo, hi) AS (VALUES {values}), "
        f"a0 AS (SELECT sensor_id, win, o AS p0, energy AS v FROM s), " + ", ".join(steps)
        + " SELECT sensor_id, win, level, round(energy, 6) AS energy FROM (" + " UNION ALL ".join(parts) + ")"
    )


@query("wavelet_energy", "J2", _dwt_sql(8, 6))
def _(t: Tables):
    out = signal.wavelet_energy(_samples(t), 8, 6, _N, tie=TIE)
    return rounded(
        out.select("sensor_id", c("window").alias("win"), c("level").cast("long").alias("level"), "energy")
    )


def _warp_sql(band: int | None = None) -> str:
    """Recursive SQL over pairs(p, a, b): a row of the cost matrix per step, then ``warped(p, dtw)``.

    Lists of [step, best of the row before] become the row's costs from left to right.
    """
    centre = "(2 * (i - 1) * (len(b) - 1) + len(a) - 1) // (2 * (len(a) - 1))"
    inside = f"abs(j - 1 - {centre}) <= greatest({band}, -(-(len(b) - 1) // (len(a) - 1)))" if band else "TRUE"
    return f"""cells AS (
      SELECT p, a, b, 0 AS i, list_prepend(0e0, list_transform(b, lambda x: 'inf'::DOUBLE)) AS costs FROM pairs
      UNION ALL
      SELECT p, a, b, i, list_reduce(
          list_prepend(['inf'::DOUBLE], list_transform(range(1, len(b) + 1), lambda j:
            [CASE WHEN {inside} THEN abs(a[i] - b[j]) ELSE 'inf'::DOUBLE END, least(costs[j], costs[j + 1])])),
          lambda done, x: list_append(done, x[1] + least(x[2], done[len(done)])))
      FROM (SELECT p, a, b, i + 1 AS i, costs FROM cells WHERE i < len(a))),
    warped AS (SELECT p, costs[len(costs)] AS dtw FROM cells WHERE i = len(a))"""


_TEMPLATE_SQL = """t AS (SELECT label AS template_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
    pairs AS (SELECT {{'vec_id': vec_id, 'template_id': template_id}} AS p,
      list_transform({a}, lambda x: x::DOUBLE) AS a, list_transform({b}, lambda x: x::DOUBLE) AS b FROM embeddings, t)"""


def _templates(t: Tables):
    return t.windows.groupBy(c("label").alias("template_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


@query(
    "template_scores",
    "D19 I6",
    f"""WITH RECURSIVE {_TEMPLATE_SQL.format(a='embedding', b='v')}, {_warp_sql()}
    SELECT p.vec_id AS vec_id, p.template_id AS template_id, round(dtw, 6) AS dtw FROM warped""",
)
def _(t: Tables):
    return rounded(signal.template_scores(t.windows.select("vec_id", "embedding"), _templates(t)))


_BAND = 6


@query(
    "template_matches",
    "D19 I6",
    f"""WITH RECURSIVE {_TEMPLATE_SQL.format(a='embedding', b='v')}, {_warp_sql(_BAND)},
    r AS (SELECT p.vec_id AS vec_id, p.template_id AS template_id, dtw,
      CAST(row_number() OVER (PARTITION BY p.vec_id ORDER BY dtw, p.template_id) AS INT) AS rank FROM warped)
    SELECT vec_id, rank, template_id, round(dtw, 6) AS dtw FROM r WHERE rank <= 3""",
)
def _(t: Tables):
    return rounded(
        signal.template_matches(t.windows.select("vec_id", "embedding"), _templates(t), 3, _BAND).drop("scored")
    )


@query(
    "consecutive_window_warping",
    "I6",
    f"""WITH RECURSIVE l AS (SELECT vec_id, lag(vec_id) OVER w AS prev_vec_id, embedding, lag(embedding) OVER w AS prev
      FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    pairs AS (SELECT {{'vec_id': vec_id, 'prev_vec_id': prev_vec_id}} AS p, list_transform(prev, lambda x: x::DOUBLE) AS a,
      list_transform(embedding, lambda x: x::DOUBLE) AS b FROM l WHERE prev_vec_id IS NOT NULL), {_warp_sql()}
    SELECT p.vec_id AS vec_id, p.prev_vec_id AS prev_vec_id, round(dtw, 6) AS dtw FROM warped""",
)
def _(t: Tables):
    from chromafield.operators.ordered import lag_rows

    pairs = lag_rows(t.windows.select("vec_id", "label", "embedding"), ["label"], "vec_id", ["embedding", "vec_id"])
    both = pairs.where("prev_vec_id IS NOT NULL")
    return rounded(
        both.select("vec_id", "prev_vec_id", signal.dtw(c("prev_embedding"), c("embedding")).alias("dtw"))
    )


# ---- graph ---------------------------------------------------------------------------

_FRAME = 50


def _framed(t: Tables):
    return t.windows.select(
        c("vec_id").alias("id"),
        F.floor(c("vec_id") / _FRAME).cast("long").alias("frame"),
        F.pmod("vec_id", F.lit(_FRAME)).alias("patch"),
        "x",
        "y",
        "z",
        (c("embedding")[3].cast("double") * F.lit(10.0)).alias("phase"),
        "embedding",
    )


_EDGE_SQL = f"""{WIN_SQL}, p AS (SELECT vec_id AS id, vec_id // {_FRAME} AS frame, vec_id % {_FRAME} AS patch, x, y, z,
      embedding[4] * 10.0 AS ph FROM win),
    kn AS (SELECT a.id AS s, b.id AS d, {_D2} AS d2, a.ph - b.ph AS dp FROM p a JOIN p b ON a.frame = b.frame AND a.id <> b.id
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) <= 6),
    ac AS (SELECT a.id AS s, b.id AS d, {_D2} AS d2, a.ph - b.ph AS dp FROM p a JOIN p b ON a.patch = b.patch AND b.frame = a.frame + 1),
    u AS (SELECT least(s, d) AS s, greatest(s, d) AS d, max(exp(-d2 / 0.08) * (1 + cos(dp)) / 2) AS w
      FROM (SELECT * FROM kn UNION ALL SELECT * FROM ac) GROUP BY 1, 2),
    e AS (SELECT s AS src, d AS dst, w AS weight FROM u UNION ALL SELECT d, s, w FROM u)"""


@query("spacetime_edges", "J3", f"WITH {_EDGE_SQL} SELECT src, dst, round(weight, 6) AS weight FROM e")
def _(t: Tables):
    return rounded(G.spacetime_edges(_framed(t), 6, 0.2))


@query(
    "sparse_matrix_vector",
    "J4",
    f"""WITH {OBS_SQL}, e AS (SELECT user_id AS src, hue_class * 100 + layer AS dst, sum(energy) AS weight FROM obs GROUP BY 1, 2),
    x AS (SELECT hue_class * 100 + layer AS id, avg(k) AS value FROM obs GROUP BY 1)
    SELECT src AS id, round(sum(weight * value), 6) AS value FROM e JOIN x ON e.dst = x.id GROUP BY 1""",
)
def _(t: Tables):
    dst = (F.coalesce("hue_class", F.lit(12)) * 100 + c("layer")).alias("dst")
    edges = t.obs.groupBy(c("user_id").alias("src"), dst).agg(F.sum("energy").alias("weight"))
    x = t.obs.groupBy(dst.alias("id")).agg(F.avg("k").alias("value"))
    return rounded(G.spmv(edges, x))


def _sensor_graph(t: Tables):
    """Users linked by their (pitch class, layer) activity: a bipartite weighted graph."""
    # 12: no pitch class
    half = t.obs.select(
        F.concat(F.lit("u"), c("user_id")).alias("src"),
        F.concat(F.lit("h"), F.coalesce("hue_class", F.lit(12)), F.lit("_"), c("layer")).alias("dst"),
        "energy",
    )
    e = half.groupBy("src", "dst").agg(F.sum("energy").alias("weight"))
    return e.unionByName(e.select(c("dst").alias("src"), c("src").alias("dst"), "weight"))


@query("laplacian_eigenvectors", "J5 J6")
def _(t: Tables):
    return rounded(G.eigenvectors(_sensor_graph(t), 4, 10))


@query(
    "orthonormal_basis",
    "J6",
    f"""WITH {WIN_SQL}, v AS (SELECT vec_id, x, y, z FROM win), a AS (SELECT vec_id, x / sqrt(sum(x * x) OVER ()) AS q1, y, z FROM v),
    b AS (SELECT *, y - q1 * sum(q1 * y) OVER () AS u FROM a), d AS (SELECT *, u / sqrt(sum(u * u) OVER ()) AS q2 FROM b),
    e AS (SELECT *, z - q1 * sum(q1 * z) OVER () - q2 * sum(q2 * z) OVER () AS w FROM d)
    SELECT vec_id, round(q1, 6) AS x, round(q2, 6) AS y, round(w / sqrt(sum(w * w) OVER ()), 6) AS z FROM e""",
)
def _(t: Tables):
    return rounded(G.orthogonalize(t.windows.select("vec_id", "x", "y", "z"), ["x", "y", "z"]))


@query(
    "entity_tracks",
    "J7",
    f"""WITH RECURSIVE {WIN_SQL}, p AS (SELECT *, vec_id // {_FRAME} AS frame FROM win),
    m AS (SELECT a.vec_id AS id, b.vec_id AS parent, list_cosine_similarity(a.embedding, b.embedding) AS sim, a.frame - b.frame AS back
      FROM p a JOIN p b ON a.frame - b.frame BETWEEN 1 AND 2 AND {_D2} <= 0.04),
    l AS (SELECT id, parent FROM m WHERE sim >= 0.25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, back, parent) = 1),
    r AS (SELECT vec_id AS id, vec_id AS track FROM p WHERE vec_id NOT IN (SELECT id FROM l)
      UNION ALL SELECT l.id, r.track FROM l JOIN r ON l.parent = r.id)
    SELECT id, track FROM r""",
)
def _(t: Tables):
    emb = _framed(t).withColumnRenamed("id", "vec_id")
    return G.tracks(emb, 0.2, 0.25, 2)


def _pole(t: Tables):
    particles = t.obs.select(
        "particle_id", "timestamp_us", "sensor_id", "frequency_hz", "energy", "x", "y", "z"
    )
    poses = t.obs.where("layer = 1").select(
        c("user_id").alias("person_id"), "particle_id", "timestamp_us"
    )
    return G.pole_graph(particles, MINUTE_US, poses=poses)


_POLE_SQL = f"""{OBS_SQL}, o AS (SELECT *, 'event:' || particle_id AS ev, concat_ws(':', 'object', sensor_id, hue_class) AS ob,
      'location:' || CAST(x AS BIGINT) || ':' || CAST(y AS BIGINT) || ':' || CAST(z AS BIGINT) AS lo FROM obs),
    l AS (SELECT ev, timestamp_us, lag(ev) OVER w AS pev, lag(timestamp_us) OVER w AS pts FROM o WINDOW w AS (ORDER BY timestamp_us, particle_id)),
    pl AS (SELECT DISTINCT lo, x, y, z FROM o),
    edges AS (SELECT ev AS src, ob AS dst, 'CO_OCCURS_WITH' AS type, timestamp_us AS ts FROM o
      UNION ALL SELECT ev, lo, 'SPATIAL_NEAR', timestamp_us FROM o
      UNION ALL SELECT pev, ev, 'PRECEDES', timestamp_us FROM l WHERE timestamp_us - pts > 0 AND timestamp_us - pts <= {MINUTE_US}
      UNION ALL SELECT a.lo, b.lo, 'SPATIAL_NEAR', NULL FROM pl a JOIN pl b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
        AND abs(a.z - b.z) <= 1 AND (a.x, a.y, a.z) < (b.x, b.y, b.z)
      UNION ALL SELECT ev, 'person:' || user_id, 'CO_OCCURS_WITH', timestamp_us FROM o WHERE layer = 1),
    nodes AS (SELECT ev AS id, 'Event' AS type FROM o UNION ALL SELECT DISTINCT ob, 'Object' FROM o UNION ALL SELECT lo, 'Location' FROM pl
      UNION ALL SELECT DISTINCT 'person:' || user_id, 'Person' FROM o WHERE layer = 1)"""


def _stored_pole(t: Tables):
    """The graph as a store would hold it: written once, then read by each traversal."""
    nodes, edges = _pole(t)
    return store_table(nodes, "nodes"), store_table(edges, "edges")


@query("event_graph_edges", "J10", f"WITH {_POLE_SQL} SELECT * FROM edges")
def _(t: Tables):
    return _pole(t)[1]


@query("event_graph_nodes", "J10", f"WITH {_POLE_SQL} SELECT * FROM nodes")
def _(t: Tables):
    return _pole(t)[0].select("id", "type")


@query(
    "event_graph_coverage",
    "E22",
    f"""WITH {_POLE_SQL} SELECT 'node' AS part, CAST(count(DISTINCT type) AS BIGINT) AS types, CAST(count(*) AS BIGINT) AS n FROM nodes
    UNION ALL SELECT 'edge', CAST(count(DISTINCT type) AS BIGINT), CAST(count(*) AS BIGINT) FROM edges""",
)
def _(t: Tables):
    return A.graph_stats(*_pole(t))


@query(
    "event_neighbourhood",
    "J11",
    f"""WITH {_POLE_SQL}, b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
    h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 'event:10' AND dst <> 'event:10'),
    h2 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h1) AND dst <> 'event:10' AND dst NOT IN (SELECT id FROM h1))
    SELECT 'event:10' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
)
def _(t: Tables):
    return G.neighbourhood(_stored_pole(t)[1], "event:10", 2)


_QUERY_VECTOR = [((i * 37) % 101 - 50) / 100 for i in range(64)]


@query(
    "similar_with_context",
    "D14 G2",
    f"""WITH {_POLE_SQL}, {WIN_SQL}, top AS (SELECT vec_id, list_cosine_similarity(embedding, {_QUERY_VECTOR}::DOUBLE[]) AS sim FROM win
      ORDER BY sim DESC, vec_id LIMIT 5)
    SELECT n.id, round(sim, 6) AS similarity, n.type, e.dst, e.type AS relation, e.ts FROM top
      JOIN nodes n ON n.id = 'event:' || vec_id LEFT JOIN edges e ON e.src = n.id""",
)
def _(t: Tables):
    nodes, edges = _stored_pole(t)
    out = M.retrieve(_QUERY_VECTOR, t.windows, nodes, edges, 5)
    return rounded(out.select("id", "similarity", "type", "dst", "relation", "ts"))


@query(
    "indexed_semantic_top5",
    "G2 I8 J14",
    f"""WITH {WIN_SQL} SELECT vec_id, label, round(list_cosine_similarity(embedding, {_QUERY_VECTOR}::DOUBLE[]), 6) AS similarity
    FROM win ORDER BY list_cosine_similarity(embedding, {_QUERY_VECTOR}::DOUBLE[]) DESC, vec_id LIMIT 5""",
)
def _(t: Tables):
    """The same search through a stored index."""
    index = build_index(t.table("embeddings"), scratch_path(t.spark, "index"), cells=16)
    return rounded(index.search(_QUERY_VECTOR, 5).select("vec_id", "label", "similarity"))


@query(
    "observation_analysis",
    "J14",
    f"""WITH {_POLE_SQL}, one AS (SELECT * FROM obs WHERE particle_id = 10),
    src AS (SELECT obs.* FROM obs, one WHERE obs.sensor_id = one.sensor_id AND obs.hue_class = one.hue_class),
    g AS (SELECT sqrt(sum(re) ** 2 + sum(im) ** 2) / sum(sqrt(re * re + im * im)) AS gamma, CAST(count(*) AS BIGINT) AS n FROM src),
    w AS (SELECT timestamp_us // {HOUR_US} AS h, sqrt(sum(re) ** 2 + sum(im) ** 2) / nullif(sum(sqrt(re * re + im * im)), 0) AS gm FROM src GROUP BY 1),
    b AS (SELECT src AS s, dst AS d FROM edges UNION ALL SELECT dst, src FROM edges)
    SELECT particle_id, timestamp_us, round(frequency_hz, 3) AS frequency_hz, round(energy, 6) AS energy, sensor_id, hue_class,
      round(gamma, 6) AS gamma, n, (SELECT CAST(count(gm) AS BIGINT) FROM w) AS windows, round((SELECT avg(gm) FROM w), 6) AS mean_gamma,
      round((SELECT var_pop(gm) FROM w), 6) AS carrier_variance,
      (SELECT CAST(count(DISTINCT d) AS BIGINT) FROM b WHERE s = 'event:10' AND d <> 'event:10') AS related FROM one, g""",
)
def _(t: Tables):
    out = M.analyze(t.obs, _stored_pole(t)[1], 10, 1, HOUR_US).drop("x", "y", "z")
    return rounded(out.withColumn("frequency_hz", F.round("frequency_hz", 3)))


@query(
    "traversal_orders",
    "G4",
    f"""WITH {WIN_SQL}, p AS (SELECT vec_id // {_FRAME} AS frame, vec_id AS patch, CAST(round(embedding[1] * 1e9) AS BIGINT) AS v1,
        CAST(round(embedding[2] * 1e9) AS BIGINT) AS v2, CAST(round(embedding[3] * 1e9) AS BIGINT) AS v3, CAST(round(embedding[4] * 1e9) AS BIGINT) AS v4 FROM win),
    r AS (SELECT frame, patch, count(*) OVER (PARTITION BY frame) + 1 AS n,
      row_number() OVER (PARTITION BY frame ORDER BY v1, patch) AS p1, row_number() OVER (PARTITION BY frame ORDER BY v2, patch) AS p2,
      row_number() OVER (PARTITION BY frame ORDER BY v3, patch) AS p3, row_number() OVER (PARTITION BY frame ORDER BY v4, patch) AS p4 FROM p)
    SELECT frame, patch, unnest(range(0, 8)) AS stream, unnest([p1, n - p1, p2, n - p2, p3, n - p3, p4, n - p4]) AS place FROM r""",
)
def _(t: Tables):
    patches = t.windows.select(
        F.floor(c("vec_id") / _FRAME).cast("long").alias("frame"),
        c("vec_id").alias("patch"),
        *[c("embedding")[i].cast("double").alias(f"v{i + 1}") for i in range(4)],
    )
    return ranking.traversals(patches).withColumn("stream", c("stream").cast("long"))


def _fps_sql(m: int) -> str:
    steps = [
        f"p AS (SELECT label AS frame, vec_id, x, y, z FROM win)",
        "s0 AS (SELECT frame, vec_id, x, y, z, 0 AS pick FROM p QUALIFY row_number() OVER (PARTITION BY frame ORDER BY vec_id) = 1)",
    ]
    for i in range(1, m):
        chosen = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(i))
        steps.append(
            f"s{i} AS (SELECT a.frame, a.vec_id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.z) AS z, {i} AS pick FROM p a JOIN ({chosen}) b "
            f"ON a.frame = b.frame GROUP BY 1, 2 HAVING min({_D2}) > 0 "
            f"QUALIFY row_number() OVER (PARTITION BY a.frame ORDER BY min({_D2}) DESC, a.vec_id) = 1)"
        )
    chosen = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(m))
    return f"WITH {WIN_SQL}, " + ", ".join(steps) + f" SELECT frame, CAST(pick AS INT) AS pick, vec_id FROM ({chosen})"


@query("farthest_points", "G5", _fps_sql(4))
def _(t: Tables):
    points = t.windows.select(c("label").alias("frame"), "vec_id", "x", "y", "z")
    return ranking.farthest_points(points, 4, tie="vec_id").select("frame", "pick", "vec_id")


# ---- models --------------------------------------------------------------------------

_BINS = {"energy": (0.0, 0.4, 16), "k": (0.0, 100.0, 10)}
_BIN_SQL = (
    "CAST(least(greatest(floor((energy - 0.0) / ((0.4 - 0.0) / 16)), 0), 15) * 10 "
    "+ least(greatest(floor((k - 0.0) / ((100.0 - 0.0) / 10)), 0), 9) AS BIGINT)"
)
_BASE_SQL = f"""{OBS_SQL}, b AS (SELECT *, {_BIN_SQL} AS bin FROM obs),
    base AS (SELECT g.bin, CAST(count(b.bin) AS BIGINT) AS n, (count(b.bin) + 1.0) / (sum(count(b.bin)) OVER () + 160.0) AS p
      FROM (SELECT unnest(range(0, 160)) AS bin) g LEFT JOIN (SELECT bin FROM b WHERE layer <> 4) b ON g.bin = b.bin GROUP BY 1),
    after AS (SELECT g.bin, (count(b.bin) + 1.0) / (sum(count(b.bin)) OVER () + 160.0) AS p
      FROM (SELECT unnest(range(0, 160)) AS bin) g LEFT JOIN (SELECT bin FROM b WHERE layer = 4) b ON g.bin = b.bin GROUP BY 1)"""


@query("baseline_density", "E8", f"WITH {_BASE_SQL} SELECT bin, n, round(p, 8) AS p FROM base")
def _(t: Tables):
    return rounded(M.fit_baseline(t.obs.where("layer <> 4"), _BINS), 8)


@query(
    "baseline_anomaly_scores",
    "E9",
    f"WITH {_BASE_SQL} SELECT particle_id, bin, round(-ln(p), 6) AS anomaly_score FROM b JOIN base USING (bin) WHERE layer = 4",
)
def _(t: Tables):
    base = M.fit_baseline(t.obs.where("layer <> 4"), _BINS)
    out = M.score_baseline(t.obs.where("layer = 4"), base, _BINS)
    return rounded(out.select("particle_id", "bin", "anomaly_score"))


@query(
    "environment_divergence",
    "E10",
    f"WITH {_BASE_SQL} SELECT round(sum(after.p * ln(after.p / base.p)), 6) AS kl, CAST(count(*) AS BIGINT) AS bins FROM after JOIN base USING (bin)",
)
def _(t: Tables):
    base = M.fit_baseline(t.obs.where("layer <> 4"), _BINS)
    after = M.fit_baseline(t.obs.where("layer = 4"), _BINS)
    return rounded(M.kl_divergence(after, base))


@query(
    "contrastive_loss",
    "E25",
    f"""WITH {WIN_SQL}, p AS (SELECT vec_id, vec_id // 64 AS batch, label, embedding FROM win),
    s AS (SELECT a.batch, a.vec_id AS i, a.label = b.label AS pos, list_cosine_similarity(a.embedding, b.embedding) / 0.5 AS sim
      FROM p a JOIN p b ON a.batch = b.batch AND a.vec_id <> b.vec_id),
    l AS (SELECT batch, i, ln(sum(exp(sim))) AS lse FROM s GROUP BY 1, 2)
    SELECT p.batch, CAST(count(sim) FILTER (pos) AS BIGINT) AS pairs, round(avg(lse - sim) FILTER (pos), 6) AS loss
    FROM p LEFT JOIN s ON p.batch = s.batch AND p.vec_id = s.i LEFT JOIN l ON p.batch = l.batch AND p.vec_id = l.i GROUP BY 1""",
)
def _(t: Tables):
    emb = t.windows.select(F.floor(c("vec_id") / 64).cast("long").alias("batch"), "label", "embedding")
    return rounded(A.nt_xent(emb, 0.5))


@query("motif_candidates", "J8")
def _(t: Tables):
    _, gate = M.motifs(t.windows, 10)
    return rounded(gate)


@query(
    "motif_silhouettes",
    "J8",
    f"""WITH {WIN_SQL}, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(list_distance(a.embedding, b.embedding) ** 2) AS m
      FROM win a JOIN win b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, own, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM d GROUP BY 1, 2)
    SELECT own AS label, round(avg((b - a) / greatest(a, b)), 5) AS silhouette, CAST(count(*) AS BIGINT) AS n,
      avg((b - a) / greatest(a, b)) >= 0.6 AS accepted FROM s GROUP BY 1""",
)
def _(t: Tables):
    gate = M.gate_motifs(M.cluster_silhouettes(t.windows, "label", "embedding"))
    return rounded(gate.drop("log"), 5)


@query(
    "motif_sequences",
    "J9",
    f"""WITH {OBS_SQL}, n AS (SELECT sensor_id, layer, row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp_us, particle_id) - 1 AS i FROM obs),
    s AS (SELECT sensor_id, i // 8 AS win, i % 8 AS o, layer FROM n), q AS (SELECT DISTINCT sensor_id, win FROM s),
    one AS (SELECT CAST(layer AS VARCHAR) AS pattern, count(DISTINCT (sensor_id, win)) AS freq FROM s GROUP BY 1),
    two AS (SELECT a.layer || ',' || b.layer AS pattern, count(DISTINCT (a.sensor_id, a.win)) AS freq FROM s a JOIN s b
      ON a.sensor_id = b.sensor_id AND a.win = b.win AND a.o < b.o GROUP BY 1)
    SELECT pattern, CAST(freq AS BIGINT) AS freq FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
    WHERE freq >= ceil(0.4 * (SELECT count(*) FROM q))""",
)
def _(t: Tables):
    rows = t.obs.select("sensor_id", "particle_id", "timestamp_us", c("layer").alias("motif"))
    out = M.motif_sequences(rows, 0.4, ["sensor_id"], tie=TIE, length=8, max_pattern=2)
    return out.select(F.array_join(c("pattern").cast("array<string>"), ",").alias("pattern"), "freq")


@query(
    "motif_session_sequences",
    "J9",
    f"""WITH RECURSIVE {OBS_SQL}, g AS (SELECT *, CASE WHEN timestamp_us - lag(timestamp_us) OVER w > {3 * HOUR_US} THEN 1 ELSE 0 END AS cut
      FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_us, particle_id)),
    s AS (SELECT user_id, layer, sum(cut) OVER w AS session, row_number() OVER w AS i FROM g
      WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_us, particle_id ROWS UNBOUNDED PRECEDING)),
    p(user_id, session, i, pattern) AS (SELECT user_id, session, i, CAST(layer AS VARCHAR) FROM s
      UNION SELECT p.user_id, p.session, s.i, p.pattern || ',' || s.layer FROM p JOIN s
        ON p.user_id = s.user_id AND p.session = s.session AND s.i > p.i),
    n AS (SELECT count(DISTINCT (user_id, session)) AS n FROM s)
    SELECT pattern, CAST(count(DISTINCT (user_id, session)) AS BIGINT) AS freq FROM p GROUP BY 1
    HAVING count(DISTINCT (user_id, session)) >= ceil(0.002 * (SELECT n FROM n))""",
)
def _(t: Tables):
    rows = t.obs.select("user_id", "particle_id", "timestamp_us", c("layer").alias("motif"))
    out = M.motif_sequences(rows, 0.002, ["user_id"], tie=TIE, gap_us=3 * HOUR_US)
    return out.select(F.array_join(c("pattern").cast("array<string>"), ",").alias("pattern"), "freq")


@query(
    "approximate_neighbours",
    "I8",
    f"""WITH {WIN_SQL} SELECT DISTINCT a.vec_id AS a_id, b.vec_id AS b_id, round(list_distance(a.embedding, b.embedding), 5) AS distance
    FROM win a JOIN win b ON a.vec_id < b.vec_id WHERE list_distance(a.embedding, b.embedding) <= 1.2""",
)
def _(t: Tables):
    pairs = rounded(M.lsh_pairs(t.windows, 1.2, 64, tables=6, planes=3, bucket=1.5, each_copy=True), 5)
    # only an id of several rows can give a pair twice
    once = t.windows.groupBy("vec_id").count().where("count > 1").isEmpty()
    return pairs if once else pairs.distinct()


@query(
    "window_scoring",
    "J12",
    f"""WITH {WIN_SQL} SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v * v * v)), 6) AS score, 'cubic-1' AS model_version FROM win""",
)
def _(t: Tables):
    def score(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy()).astype(float)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "score": (x**3).sum(axis=1)})

    return rounded(M.score_windows(t.windows.select("vec_id", "embedding"), score, "vec_id long, score double", "cubic-1"))


_PROBE_SQL = f"""{OBS_SQL}, sc AS (SELECT layer AS probe, sensor_id AS domain, timestamp_us // {6 * HOUR_US} AS win, avg(energy) AS score,
        max(energy) AS peak FROM obs GROUP BY 1, 2, 3),
    base AS (SELECT probe, avg(score) AS m, stddev_pop(score) AS sd FROM sc WHERE probe = domain GROUP BY 1),
    an AS (SELECT DISTINCT win FROM sc WHERE peak > 0.2001),
    f AS (SELECT sc.*, score > m + 0.25 * sd AS fires, win IN (SELECT win FROM an) AS an FROM sc JOIN base USING (probe))"""


def _probe_scores(t: Tables):
    return t.obs.groupBy(
        c("layer").alias("probe"), c("sensor_id").alias("domain"), slice_of(c("timestamp_us"), 6 * HOUR_US).alias("window")
    ).agg(F.avg("energy").alias("score"), F.max("energy").alias("peak"))


@query(
    "promoted_probes",
    "J13 F5",
    f"""WITH {_PROBE_SQL}, i AS (SELECT *, fires AND an AS ok, row_number() OVER (PARTITION BY probe, domain ORDER BY win) AS i FROM f),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY probe, domain, ok ORDER BY win) AS run FROM i)
    SELECT probe, domain, min(win) AS start_us, max(win) AS end_us, CAST(count(*) AS BIGINT) AS rows FROM g WHERE ok
    GROUP BY probe, domain, run HAVING count(*) >= 3""",
)
def _(t: Tables):
    scores = _probe_scores(t)
    base = A.probe_baseline(scores.where("probe = domain"), ["probe"])
    return M.promote_probes(scores, base, scores.where("peak > 0.2001"), 0.25, 3)


@query(
    "probe_activation_mask",
    "J13 E23",
    f"""WITH {_PROBE_SQL} SELECT win, CAST(bit_or(CASE WHEN fires THEN 1 << probe ELSE 0 END) AS BIGINT) AS probe_activation_mask FROM f GROUP BY 1""",
)
def _(t: Tables):
    scores = _probe_scores(t)
    base = A.probe_baseline(scores.where("probe = domain"), ["probe"])
    return M.activation_mask(scores, base, 0.25).withColumnRenamed("window", "win")


