"""Sparse matrices, spectral vectors, tracks and the event graph."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafield.functions.color import freq_to_material_id
from chromafield.functions.vectors import cosine
from chromafield.operators.joins import relate
from chromafield.operators.spatial import POS, candidate_pairs, knn
from chromafield.session import cut_lineage


def spacetime_edges(
    points: DataFrame,
    k: int,
    sigma: float,
    frame: str = "frame",
    patch: str = "patch",
    id_col: str = "id",
    phase: str = "phase",
) -> DataFrame:
    """Weighted symmetric edges (src, dst, weight) over nearest neighbours and adjacent frames.

    Weight = exp(-d^2 / 2 sigma^2) times a temporal term.  Choice: the temporal term is
    (1 + cos(phase difference)) / 2, which keeps weights non-negative.
    """
    facts = points.select(id_col, frame, patch, *POS, phase)
    inside = knn(points, k, id_col, [frame]).select(
        F.col("id").alias("src"), F.col("neighbour").alias("dst"), "distance"
    )
    phases = facts.select(F.col(id_col), F.col(phase))
    inside = (
        inside.join(phases.toDF("src", "_ps"), "src")
        .join(phases.toDF("dst", "_pd"), "dst")
        .select("src", "dst", F.col("distance") ** 2, F.col("_ps") - F.col("_pd"))
        .toDF("src", "dst", "d2", "dphi")
    )
    now = facts.select(*[F.col(c).alias(f"a_{c}") for c in facts.columns])
    nxt = facts.select(*[F.col(c).alias(f"b_{c}") for c in facts.columns])
    across = now.join(
        nxt,
        (F.col(f"a_{patch}") == F.col(f"b_{patch}")) & (F.col(f"b_{frame}") == F.col(f"a_{frame}") + 1),
    ).select(
        F.col(f"a_{id_col}").alias("src"),
        F.col(f"b_{id_col}").alias("dst"),
        sum(((F.col(f"a_{p}") - F.col(f"b_{p}")) ** 2 for p in POS), start=F.lit(0.0)).alias("d2"),
        (F.col(f"a_{phase}") - F.col(f"b_{phase}")).alias("dphi"),
    )
    weight = F.exp(-F.col("d2") / F.lit(2 * sigma * sigma)) * (F.cos("dphi") + 1) / 2
    # one row per undirected edge, then both directions
    single = (
        inside.unionByName(across)
        .select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), weight.alias("weight"))
        .groupBy("u", "v")
        .agg(F.max("weight").alias("weight"))
    )
    return single.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").unionByName(
        single.select(F.col("v").alias("src"), F.col("u").alias("dst"), "weight")
    )


def spmv(edges: DataFrame, x: DataFrame, cols: Sequence[str] = ("value",)) -> DataFrame:
    """y = W x for one or more columns: join on dst, partial sums per src."""
    return (
        edges.select("src", F.col("dst").alias("id"), "weight")
        .join(x, "id")
        .groupBy("src")
        .agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in cols])
        .withColumnRenamed("src", "id")
    )


def orthogonalize(v: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Orthonormal columns: one aggregation for all dot products, one projection.

    The dot products are a matrix of (columns x columns) numbers; its Cholesky factor gives
    the same vectors as Gram-Schmidt, in order.
    """
    at = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    dots = v.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"_{i}_{j}") for i, j in at]).first()
    gram = np.zeros((len(cols), len(cols)))
    for (i, j), value in zip(at, dots):
        gram[i, j] = gram[j, i] = value
    inverse = np.linalg.inv(np.linalg.cholesky(gram))
    rest = [c for c in v.columns if c not in cols]
    return v.select(
        *rest,
        *[
            sum((F.lit(float(inverse[i, j])) * F.col(cols[j]) for j in range(i + 1)), start=F.lit(0.0)).alias(c)
            for i, c in enumerate(cols)
        ],
    )


def eigenvectors(edges: DataFrame, k: int = 4, steps: int = 10) -> DataFrame:
    """(id, v1..vk): orthogonal power iteration on I + D^-1/2 W D^-1/2.

    Choice of operator: its leading vectors are the smoothest of the normalised Laplacian.
    The identity enters as self-loops, so a step is one join and one aggregation; each
    step's vectors are checkpointed.
    """
    cols = [f"v{i + 1}" for i in range(k)]
    degree = edges.groupBy("src").agg(F.sum("weight").alias("d")).select(
        F.col("src").alias("id"), F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0).alias("s")
    )
    degree = cut_lineage(degree)
    scaled = (
        edges.join(degree.toDF("src", "_ss"), "src")
        .join(degree.toDF("dst", "_sd"), "dst")
        .select("src", "dst", (F.col("weight") * F.col("_ss") * F.col("_sd")).alias("weight"))
        .unionByName(
            degree.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
        )
        .repartition("dst")
    )
    scaled = cut_lineage(scaled)
    # fixed, id-based start so that a rerun gives the same vectors
    seed = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    v = degree.select("id", *[F.cos(seed * F.lit(math.pi * (i + 1))).alias(c) for i, c in enumerate(cols)])
    v = orthogonalize(v, cols)
    for _ in range(steps):
        v = orthogonalize(cut_lineage(spmv(scaled, v, cols)), cols)
    return _rotate(v, spmv(scaled, v, cols), cols)


def _rotate(v: DataFrame, mv: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Best vectors within the span (Rayleigh-Ritz), largest eigenvalue first.

    The span settles well before the single vectors do; a (columns x columns) matrix of
    dot products is all the driver sees.
    """
    images = mv.withColumnsRenamed({c: f"m_{c}" for c in cols})
    at = [(a, b) for a in cols for b in cols]
    dots = v.join(images, "id").agg(*[F.sum(F.col(a) * F.col(f"m_{b}")) for a, b in at]).first()
    small = np.array(dots).reshape(len(cols), len(cols))
    _, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return v.select(
        "id",
        *[
            sum((F.lit(float(turn[j, i])) * F.col(cols[j]) for j in range(len(cols))), start=F.lit(0.0)).alias(c)
            for i, c in enumerate(cols)
        ],
    )


def follow_parents(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) from (id, parent) pointers by pointer doubling; a root is its own parent.

    Rounds grow with the logarithm of the longest chain.  Rows whose pointer is known to
    be a root leave the join, so a root with very many members is looked up once per row.
    """
    state = cut_lineage(
        links.select("id", "parent", (F.col("id") == F.col("parent")).alias("fin"))
    )
    for _ in range(max_rounds):
        waiting = state.where(~F.col("fin"))
        if waiting.isEmpty():
            break
        up = state.select(
            F.col("id").alias("parent"), F.col("parent").alias("_next"), F.col("fin").alias("_fin")
        )
        moved = waiting.join(up, "parent", "left").select(
            "id",
            F.coalesce("_next", "parent").alias("parent"),
            F.coalesce("_fin", F.lit(True)).alias("fin"),
        )
        state = cut_lineage(state.where("fin").unionByName(moved))
    else:
        raise ValueError("parent pointers contain a cycle")
    return state.select("id", F.col("parent").alias("root"))


def tracks(
    emb: DataFrame,
    reach: float,
    min_similarity: float,
    max_dt: int,
    frame: str = "frame",
    id_col: str = "vec_id",
    vec: str = "embedding",
) -> DataFrame:
    """Entity tracks: (id, track).  Each window links to its best match in earlier frames.

    Candidates lie within ``reach`` in space and 1..max_dt frames back; the best by cosine
    (ties: nearer frame, lower id) with at least ``min_similarity`` is the parent.  Parents
    point back in time, so the links form trees and a track is a tree, named by its root.
    """
    facts = emb.select(id_col, frame, *POS, vec)
    best = None
    for back in range(1, max_dt + 1):
        later = facts.withColumn("_f", F.col(frame) - back)
        pairs = candidate_pairs(
            later.drop(frame).withColumnRenamed("_f", frame),
            facts,
            reach,
            [id_col, *POS, vec],
            [id_col, *POS, vec],
            [frame],
        )
        scored = pairs.select(
            F.col(f"a_{id_col}").alias("id"),
            F.col(f"b_{id_col}").alias("parent"),
            cosine(F.col(f"a_{vec}"), F.col(f"b_{vec}")).alias("sim"),
            F.lit(-back).alias("near"),
        ).where(F.col("sim") >= min_similarity)
        best = scored if best is None else best.unionByName(scored)
    parents = best.groupBy("id").agg(
        F.max_by("parent", F.struct("sim", "near", -F.col("parent"))).alias("parent")
    )
    links = facts.select(F.col(id_col).alias("id")).join(parents, "id", "left").select(
        "id", F.coalesce("parent", "id").alias("parent")
    )
    return follow_parents(links).withColumnRenamed("root", "track")


def pole_graph(
    particles: DataFrame,
    window_us: int,
    env: DataFrame | None = None,
    poses: DataFrame | None = None,
    cell: float = 1.0,
    width: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Person, Object, Location and Event from particles.

    An object is a (sensor, pitch class) source, a location a grid cell of the position.
    Events touch their object and person by ``CO_OCCURS_WITH`` and their location by
    ``SPATIAL_NEAR``; neighbouring occupied cells are ``SPATIAL_NEAR`` each other; events
    follow one another by ``PRECEDES``.
    """
    obj = F.concat_ws(":", F.lit("object"), F.col("sensor_id"), freq_to_material_id(F.col("frequency_hz")))
    grid = [F.floor(F.col(p) / F.lit(cell)).cast("long") for p in POS]
    loc = F.concat_ws(":", F.lit("location"), *grid)
    facts = particles.withColumns(
        {
            "_event": F.concat(F.lit("event:"), F.col("particle_id")),
            "_object": obj,
            "_location": loc,
            **{f"_g{p}": g for p, g in zip(POS, grid)},
        }
    )

    def node(frame: DataFrame, id_: Column, kind: str, props: Column) -> DataFrame:
        return frame.select(id_.alias("id"), F.lit(kind).alias("type"), props.alias("props"))

    places = facts.select("_location", *[f"_g{p}" for p in POS]).distinct()
    objects = facts.select("_object", "sensor_id").distinct()
    nodes = node(
        facts, F.col("_event"), "Event", F.to_json(F.struct("timestamp_us", "energy"))
    ).unionByName(node(objects, F.col("_object"), "Object", F.to_json(F.struct("sensor_id"))))
    nodes = nodes.unionByName(
        node(places, F.col("_location"), "Location", F.to_json(F.struct(*[F.col(f"_g{p}").alias(p) for p in POS])))
    )

    def edge(frame: DataFrame, src: Column, dst: Column, kind: str, ts: Column) -> DataFrame:
        return frame.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), ts.alias("ts"))

    ts = F.col("timestamp_us")
    edges = edge(facts, F.col("_event"), F.col("_object"), "CO_OCCURS_WITH", ts)
    edges = edges.unionByName(edge(facts, F.col("_event"), F.col("_location"), "SPATIAL_NEAR", ts))
    follow = relate(particles, window_us, width=width).where("type = 'PRECEDES'")
    edges = edges.unionByName(follow)
    steps = [(i, j, k) for i in (0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    hop = F.explode(
        F.array(
            *[
                F.struct(*[(F.col(f"_g{p}") + d).alias(f"_g{p}") for p, d in zip(POS, step)])
                for step in steps
            ]
        )
    )
    beside = places.select(F.col("_location").alias("_from"), hop.alias("_h")).select("_from", "_h.*")
    adjacent = beside.join(places, [f"_g{p}" for p in POS])
    edges = edges.unionByName(
        edge(adjacent, F.col("_from"), F.col("_location"), "SPATIAL_NEAR", F.lit(None).cast("long"))
    )
    if poses is not None:
        person = F.concat(F.lit("person:"), F.col("person_id"))
        nodes = nodes.unionByName(
            node(poses.select("person_id").distinct(), person, "Person", F.to_json(F.struct("person_id")))
        )
        seen = poses.select("person_id", "particle_id", "timestamp_us")
        edges = edges.unionByName(
            edge(seen, F.concat(F.lit("event:"), F.col("particle_id")), person, "CO_OCCURS_WITH", ts)
        )
    if env is not None:
        fixes = env.where("lat IS NOT NULL AND lon IS NOT NULL")
        fix = F.concat_ws(":", F.lit("location"), F.round("lat", 3), F.round("lon", 3))
        nodes = nodes.unionByName(
            node(fixes.select("lat", "lon").distinct(), fix, "Location", F.to_json(F.struct("lat", "lon"))).distinct()
        )
    return nodes, edges


def neighbourhood(edges: DataFrame, start: str, hops: int, directed: bool = False) -> DataFrame:
    """(id, hop): everything within ``hops`` of a node, at its smallest distance.

    Each hop joins the frontier with the edges and drops what was seen; the frontier is
    deduplicated with map-side combine, and lineage is cut every third hop.
    """
    spark = edges.sparkSession
    links = edges.select("src", "dst")
    if not directed:
        links = links.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    id_type = edges.schema["src"].dataType.simpleString()
    visited = spark.createDataFrame([(start, 0)], f"id {id_type}, hop int")
    frontier = visited.select("id")
    for hop in range(1, hops + 1):
        reached = links.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(
            F.col("dst").alias("id")
        ).distinct()
        fresh = reached.join(visited, "id", "left_anti")
        if hop % 3 == 0:
            fresh = cut_lineage(fresh)
        visited = visited.unionByName(fresh.withColumn("hop", F.lit(hop)))
        frontier = fresh
    return visited


__all__ = [
    "eigenvectors",
    "follow_parents",
    "neighbourhood",
    "orthogonalize",
    "pole_graph",
    "spacetime_edges",
    "spmv",
    "tracks",
]
