"""Baselines, motif clusters, sequences, neighbours by hashing, probes and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.fpm import PrefixSpan
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.functions.codec import mask_bits
from chromafield.functions.vectors import dot
from chromafield.operators.ordered import lag_rows, prefix_scan
from chromafield.operators.ranking import count_windows, query_semantic
from chromafield.operators.vector_index import VectorIndex
from chromafield.operators.windows import sustained
from chromafield.session import broadcast_if_small, store_table

Bins = dict[str, tuple[float, float, int]]


def bin_index(bins: Bins) -> Column:
    """One number for the joint bin of several columns; values outside go to the end bins."""
    index = F.lit(0).cast("long")
    for name, (lo, hi, n) in bins.items():
        at = F.floor((F.col(name) - F.lit(lo)) / F.lit((hi - lo) / n))
        index = index * F.lit(n) + F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("long")
    return index


def _n_bins(bins: Bins) -> int:
    total = 1
    for _, _, n in bins.values():
        total *= n
    return total


def fit_baseline(df: DataFrame, bins: Bins, alpha: float = 1.0) -> DataFrame:
    """Density of the quiet environment: (bin, n, p) over all bins, Laplace-smoothed."""
    total = _n_bins(bins)
    counts = df.groupBy(bin_index(bins).alias("bin")).agg(F.count("*").alias("n")).where("bin IS NOT NULL")
    full = df.sparkSession.range(total).toDF("bin").join(counts, "bin", "left").fillna(0, ["n"])
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_rows"))  # one row
    share = (F.col("n") + F.lit(alpha)) / (F.col("_rows") + F.lit(alpha * total))
    return full.join(F.broadcast(rows)).withColumn("p", share).drop("_rows")


def score_baseline(df: DataFrame, baseline: DataFrame, bins: Bins) -> DataFrame:
    """Anomaly score -ln p of each row under the baseline density."""
    density = baseline.select("bin", F.col("p"))
    return (
        df.withColumn("bin", bin_index(bins))
        .join(broadcast_if_small(density, 100_000), "bin", "left")
        .withColumn("anomaly_score", -F.ln("p"))
        .drop("p")
    )


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: divergence of two smoothed densities over the same bins, in nats."""
    a = p.select("bin", F.col("p").alias("_p"))
    b = q.select("bin", F.col("p").alias("_q"))
    both = a.join(b, "bin", "full")
    term = F.when(F.col("_p") > 0, F.col("_p") * F.ln(F.try_divide("_p", "_q")))
    return both.agg(F.sum(term).alias("kl"), F.count("*").alias("bins"))


#: values of the cluster sums that one pass over the rows holds
CLUSTER_VALUES = 2_000_000


def cluster_silhouettes(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """Mean silhouette (squared distance) and size per cluster, for any number of clusters.

    Mean distances to whole clusters come from each cluster's count, vector sum and
    squared-norm sum, so no two points are ever paired.  These sums come in blocks of bounded
    size, one pass over the rows for each; a row keeps its own distance and the least other.
    """
    rows = df.select(F.col(cluster).alias("_c"), F.col(vec).cast("array<double>").alias("_v")).where(
        "_c is not null and _v is not null"
    )
    size = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    sums = store_table(
        rows.groupBy("_c").agg(
            F.count("*").alias("n"),
            F.sum(dot(F.col("_v"), F.col("_v"))).alias("psi"),
            F.array(*[F.sum(F.col("_v")[i]) for i in range(size)]).cast("array<double>").alias("y"),
        ),
        "clusters",
    )
    blocks = max(1, -(-sums.count() * (size + 2) // CLUSTER_VALUES))
    none = F.lit(None).cast("double")
    scored = rows.withColumns({"_n": none, "_a": none, "_b": none})
    kind = rows.schema["_c"].dataType.simpleString()
    for number in range(blocks):
        known = sums.where(F.pmod(F.xxhash64("_c"), F.lit(blocks)) == number).toPandas()
        if not len(known):
            continue
        shared = df.sparkSession.sparkContext.broadcast(
            (
                known["_c"].to_numpy(),
                known["n"].to_numpy(float),
                known["psi"].to_numpy(float),
                np.array(known["y"].tolist(), float).reshape(len(known), size),
            )
        )
        if number:
            scored = store_table(scored, "silhouettes")

        def measure(batches, shared=shared):
            names, count, psi, total = shared.value
            at = {name: i for i, name in enumerate(names)}
            for pdf in batches:
                for start in range(0, len(pdf), 4096):
                    part = pdf.iloc[start : start + 4096].copy()
                    x = np.array(part["_v"].tolist(), float).reshape(len(part), size)
                    # count * mean squared distance of each row to each cluster
                    spread = count * (x**2).sum(axis=1)[:, None] + psi - 2 * (x @ total.T)
                    own = part["_c"].map(at).to_numpy(float)
                    here = np.flatnonzero(~np.isnan(own))
                    mine = own[here].astype(int)
                    kept = part["_a"].to_numpy(float).copy(), part["_n"].to_numpy(float).copy()
                    kept[0][here], kept[1][here] = spread[here, mine], count[mine]
                    mean = spread / count
                    mean[here, mine] = np.inf
                    least = np.fmin(mean.min(axis=1), part["_b"].to_numpy(float))
                    yield part.assign(_a=kept[0], _n=kept[1], _b=np.where(np.isinf(least), np.nan, least))

        scored = scored.mapInPandas(measure, f"_c {kind}, _v array<double>, _n double, _a double, _b double")
    a, b = F.try_divide("_a", F.col("_n") - 1), F.nanvl("_b", none)
    s = F.when(F.col("_n") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return scored.groupBy(F.col("_c").alias(cluster)).agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def gate_motifs(silhouettes: DataFrame, min_sil: float = 0.6) -> DataFrame:
    """Accept or reject each candidate; a rejected one carries its log line."""
    ok = F.col("silhouette") >= min_sil
    return silhouettes.withColumns(
        {
            "accepted": ok,
            "log": F.when(~ok, F.format_string("rejected: score %.2f", F.col("silhouette"))),
        }
    )


def motifs(
    emb: DataFrame, k: int, min_sil: float = 0.6, vec: str = "embedding", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(assigned rows, gate): KMeans candidates and their silhouette verdicts."""
    data = emb.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="motif").fit(data)
    assigned = model.transform(data).drop("_features")
    return assigned, gate_motifs(cluster_silhouettes(assigned, "motif", vec), min_sil)


def motif_sequences(
    df: DataFrame,
    min_support: float,
    keys: Sequence[str],
    motif: str = "motif",
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    gap_us: int | None = None,
    length: int | None = None,
    max_pattern: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """Frequent motif sequences (pattern, freq).

    A sequence is a session of a key, cut where nothing happened for more than ``gap_us``;
    with ``length`` it is a count window instead, so that a pattern never crosses a window's
    border.  Without both, a key is one sequence.  Patterns may be of any length unless
    ``max_pattern`` bounds them; they need not be contiguous, so their number grows with the
    power of the support's longest common sequences: choose ``min_support`` accordingly.
    """
    if length is not None:
        numbered = count_windows(df, length, keys, ts, tie, width).withColumnRenamed("window", "_session")
    elif gap_us is not None:
        gap = F.coalesce(F.col(ts) - F.col(f"prev_{ts}") > gap_us, F.lit(False))
        lagged = lag_rows(df, keys, ts, [ts], tie, width)
        numbered = prefix_scan(lagged, keys, ts, {"_session": gap.cast("long")}, tie, width)
    else:
        numbered = df.withColumn("_session", F.lit(0))
    sequences = numbered.groupBy(*keys, "_session").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(ts, *tie, F.col(motif).alias("m")))),
            lambda x: F.array(x["m"]),
        ).alias("sequence")
    )
    found = PrefixSpan(
        minSupport=min_support, maxPatternLength=max_pattern or 2**31 - 1, sequenceCol="sequence"
    ).findFrequentSequentialPatterns(sequences.select("sequence"))
    return found.select(F.flatten("sequence").alias("pattern"), "freq")


#: rows, and values, of a side of a tile of the distance matrix, about
TILE_ROWS = 16_384
TILE_VALUES = 1 << 20
#: smaller tables are still cut into ``SIDES`` such sides, so that no core waits, where each has ``SMALL_BUCKET`` rows
SIDES = 10
SMALL_BUCKET = 512
BLOCK_VALUES = 1 << 15  # values of the rows that are looked at together
FOUND_ROWS = 1 << 18  # pairs that are handed on together
SLACK = 1e-9  # room for rounding; what passes is measured again


def lsh_pairs(
    df: DataFrame,
    r: float,
    dims: int,
    tables: int = 8,
    planes: int = 4,
    bucket: float | None = None,
    id_col: str = "vec_id",
    vec: str = "embedding",
    seed: int = 7,
    each_copy: bool = False,
) -> DataFrame:
    """All near pairs (a_id, b_id, distance) with L2 distance at most ``r``; none is left out.

    Random projections say what lies together, not what may meet: rows are laid out by their hash of
    ``planes`` projections, and two tiles of rows are skipped only where all ``tables * planes``
    projections prove them further apart than ``r``.  All other tiles meet as a distance matrix, about
    ``TILE_ROWS`` by ``TILE_ROWS`` vectors per task, so the work is quadratic where nothing lies apart.

    Equal vectors are collapsed first and their copies hang on the lowest id, so a pile of copies adds
    one row, not all pairs; ``each_copy`` lists the pairs of every row instead.  Null ids and vectors,
    and vectors with a component that is null or not finite, are near nothing; nor are vectors of
    different length.
    """
    known = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & known).select(F.col(id_col).alias("_id"), F.col(vec).alias("_v"))
    heads = rows if each_copy else rows.groupBy("_v").agg(F.min("_id").alias("_id"))
    id_type, kind = rows.schema["_id"].dataType.simpleString(), rows.schema["_v"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"

    total, longest = heads.agg(F.count("*"), F.max(F.size("_v"))).first()
    most = max(1, min(TILE_ROWS, TILE_VALUES // max(longest or 1, 1)))
    sides = max(1, -(-total // most), min(SIDES, total // SMALL_BUCKET))
    order = ["_size", "_sig", "_id"]
    sig = lsh_signatures(F.col("_v"), dims, 1, planes, bucket or r or 1.0, seed)[0]
    laid = (
        heads.select("_id", "_v", F.size("_v").alias("_size"), sig.alias("_sig"))
        .repartitionByRange(2 * sides, *order)
        .sortWithinPartitions(*order)
        .select("_id", "_v", "_size", F.spark_partition_id().alias("_part"))
    )
    directions = lsh_planes(dims, tables, planes, seed)[..., :-1].reshape(-1, dims)
    basis = np.linalg.qr(directions.T)[0]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (part, size), same in pdf.groupby(["_part", "_size"], sort=False):
                step = max(1, BLOCK_VALUES // max(size, 1))
                for start in range(0, len(same), step):
                    some = same.iloc[start : start + step]
                    x = np.array(some["_v"].tolist(), float).reshape(len(some), size)
                    # a longer or shorter vector is projected as far as the directions go
                    at = x[:, :dims] @ basis[:size]
                    room = SLACK * size * np.abs(x).max(initial=0.0)
                    block = (part, size, len(some), some["_id"].to_numpy(), x.ravel(), at.min(axis=0) - room, at.max(axis=0) + room)
                    yield pd.DataFrame([block], columns=["_part", "_size", "_rows", "_ids", "_values", "_low", "_high"])

    blocks = store_table(
        laid.mapInPandas(
            pack,
            f"_part int, _size int, _rows int, _ids array<{id_type}>, _values array<{kind}>, _low array<double>, _high array<double>",
        ),
        "lsh-blocks",
    )
    # neighbouring parts fill a tile together; the running count is over one short row per part
    box = [
        F.array(*[outer(F.col(side)[k]) for k in range(basis.shape[1])]).alias(side)
        for side, outer in (("_low", F.min), ("_high", F.max))
    ]
    parts = blocks.groupBy("_size", "_part").agg(F.sum("_rows").alias("_rows"), *box)
    before = F.sum("_rows").over(Window.orderBy("_size", "_part")) - F.col("_rows")
    tile = F.floor(before / F.lit(max(1, -(-total // sides)))).cast("int")
    parts = store_table(parts.withColumn("_tile", tile), "lsh-parts")
    bounds = parts.groupBy("_size", "_tile").agg(*box)
    reach = r * r * (1 + SLACK)
    p, q = (bounds.select("_size", *[F.col(n).alias(n + s) for n in ("_tile", "_low", "_high")]) for s in "pq")
    gaps = F.zip_with(
        F.zip_with("_lowp", "_highq", lambda x, y: x - y),
        F.zip_with("_lowq", "_highp", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    meet = p.join(q, "_size").where("_tilep <= _tileq").where(dot(gaps, gaps) <= reach)
    meet = meet.select("_size", "_tilep", "_tileq", F.explode(F.array_distinct(F.array("_tilep", "_tileq"))).alias("_tile"))
    dealt = blocks.join(broadcast_if_small(parts.select("_size", "_part", "_tile")), ["_size", "_part"])
    met = dealt.join(broadcast_if_small(meet), ["_size", "_tile"])

    def compare(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, left, right = (int(k) for k in key)
        held = {left: [], right: []}
        for pdf in batches:
            for at, ids, values, low, high in zip(*(pdf[n] for n in ("_tile", "_ids", "_values", "_low", "_high"))):
                x = values.astype(float).reshape(len(ids), size)
                norm = (x * x).sum(axis=1)[:, None] * (1 - SLACK)
                held[at].append((ids, x.T.copy(), np.hstack([x, np.ones_like(norm), norm]), low, high))
        made, waiting = [], 0
        for m, (a_ids, a, a_all, a_low, a_high) in enumerate(held[left]):
            # the expanded square of the distance, as one product
            asked = np.hstack([-2.0 * a_all[:, :size], a_all[:, size + 1 :], a_all[:, size : size + 1]])
            for b_ids, b, b_all, b_low, b_high in held[right][m if left == right else 0 :]:
                if (np.maximum(0.0, np.maximum(a_low - b_high, b_low - a_high)) ** 2).sum() > reach:
                    continue
                # a product that is no number is for the exact measure, too
                i, j = np.nonzero(~(asked @ b_all.T > reach))
                if a is b:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                d2 = np.zeros(len(i))
                for k in range(size):  # in the order of the components, as SQL sums
                    d2 += (a[k][i] - b[k][j]) ** 2
                distance = np.sqrt(d2)
                near = (distance <= r) & (a_ids[i] != b_ids[j])
                one, other = a_ids[i[near]], b_ids[j[near]]
                turn = one > other
                made.append(
                    pd.DataFrame({"a_id": np.where(turn, other, one), "b_id": np.where(turn, one, other), "distance": distance[near]})
                )
                waiting += len(made[-1])
                if waiting >= FOUND_ROWS:
                    yield pd.concat(made)
                    made, waiting = [], 0
        if made:
            yield pd.concat(made)

    near = met.groupBy("_size", "_tilep", "_tileq").applyInPandas(compare, f"a_id {id_type}, b_id {id_type}, distance double")
    if each_copy:
        return near
    copies = (
        rows.withColumnRenamed("_id", "b_id")
        .join(heads.withColumnRenamed("_id", "a_id"), "_v")
        .where("b_id > a_id")
        .select("a_id", "b_id", F.lit(0.0).alias("distance"))
        .distinct()
    )
    return near.unionByName(copies)


def lsh_planes(dims: int, tables: int, planes: int, seed: int = 7) -> np.ndarray:
    """Projection directions and offsets, fixed by the seed: (tables, planes, dims + 1)."""
    return np.random.default_rng(seed).normal(size=(tables, planes, dims + 1))


def lsh_signatures(
    vec: Column, dims: int, tables: int, planes: int, bucket: float, seed: int = 7
) -> Column:
    """Array with one signature string per table."""
    directions = lsh_planes(dims, tables, planes, seed)

    def project(row: np.ndarray) -> Column:
        w = F.array(*[F.lit(float(v)) for v in row[:-1]])
        return F.floor((dot(vec, w) + F.lit(float(row[-1]))) / F.lit(bucket))

    return F.array(
        *[F.concat_ws("_", *[project(row).cast("string") for row in table]) for table in directions]
    )


def retrieve(
    query: Sequence[float],
    obs: DataFrame | VectorIndex,
    nodes: DataFrame,
    edges: DataFrame,
    k: int = 5,
    vec: str = "embedding",
    id_col: str = "vec_id",
    node_id: Column | None = None,
) -> DataFrame:
    """The k most similar observations (of a table or an index) with their node and its edges.

    Only k rows enter the joins, so the big sides are filtered, not shuffled.
    """
    node_id = F.concat(F.lit("event:"), F.col(id_col)) if node_id is None else node_id
    if isinstance(obs, VectorIndex):
        found = obs.search(query, k)
    else:
        found = query_semantic(query, obs, k, vec, id_col)
    top = found.select(id_col, "similarity", node_id.alias("id"))
    hits = F.broadcast(top)  # k rows
    linked = nodes.join(hits, "id").select("id", "similarity", id_col, "type", "props")
    return linked.join(
        edges.select(F.col("src").alias("id"), "dst", F.col("type").alias("relation"), "ts"),
        "id",
        "left",
    )


def query_temporal(obs: DataFrame, t0: int, t1: int, ts: str = "timestamp_us") -> DataFrame:
    from chromafield.operators.filters import scrub

    return scrub(obs, t0, t1, ts)


def analyze(
    particles: DataFrame, edges: DataFrame, obs_id: int, hops: int = 1, window_us: int = 3_600_000_000
) -> DataFrame:
    """One observation with its source's coherence, carrier variance and graph reach.

    The observation is looked up first; its sensor and hue then filter the scans.
    """
    from chromafield.functions.color import freq_to_material_id
    from chromafield.operators.aggregates import carrier_variance, phase_coherence
    from chromafield.operators.graph import neighbourhood

    hue = freq_to_material_id(F.col("frequency_hz"))
    one = particles.where(F.col("particle_id") == obs_id).withColumn("hue_class", hue)
    row = one.first()
    if row is None:
        raise ValueError(f"no observation {obs_id}")
    source = particles.where((F.col("sensor_id") == row["sensor_id"]) & (hue == row["hue_class"]))
    source = source.withColumn("hue_class", hue)
    keys = ["sensor_id", "hue_class"]
    reach = neighbourhood(edges, f"event:{obs_id}", hops).groupBy().agg((F.count("*") - 1).alias("related"))
    return (
        one.select("particle_id", "timestamp_us", "frequency_hz", "energy", *keys)
        .join(phase_coherence(source, keys), keys)
        .join(carrier_variance(source, keys, window_us, 0.0).drop("injected"), keys)
        .withColumn("_one", F.lit(1))
        .join(reach.withColumn("_one", F.lit(1)), "_one")
        .drop("_one")
    )


def score_windows(
    df: DataFrame, fn: Callable, schema: str, version: str
) -> DataFrame:
    """Score with the caller's batch function (iterator of pandas frames), tagging the version."""
    return df.mapInPandas(fn, schema).withColumn("model_version", F.lit(version))


def exceeds_baseline(
    scores: DataFrame, base: DataFrame, n_sigma: float = 2.0, probe: str = "probe"
) -> DataFrame:
    """Scores with ``fires``: more than n sigma over the probe's own-domain baseline."""
    own = base.select(probe, F.col("mean").alias("_mean"), F.col("sigma").alias("_sigma"))
    return (
        scores.join(broadcast_if_small(own), probe)
        .withColumn("fires", F.col("score") > F.col("_mean") + F.lit(n_sigma) * F.col("_sigma"))
        .drop("_mean", "_sigma")
    )


def promote_probes(
    scores: DataFrame,
    base: DataFrame,
    anomalies: DataFrame,
    n_sigma: float = 2.0,
    n_windows: int = 3,
    probe: str = "probe",
    domain: str = "domain",
    window: str = "window",
    width: int | None = None,
) -> DataFrame:
    """Probes to promote: firing in at least n consecutive windows that also hold an anomaly."""
    fired = exceeds_baseline(scores, base, n_sigma, probe)
    flagged = anomalies.select(window).distinct().withColumn("_anomaly", F.lit(True))
    joined = fired.join(flagged, window, "left")
    cond = F.col("fires") & F.coalesce(F.col("_anomaly"), F.lit(False))
    return sustained(joined, [probe, domain], cond, n_windows, window, (), width)


def activation_mask(
    scores: DataFrame, base: DataFrame, n_sigma: float = 2.0, probe: str = "probe", window: str = "window"
) -> DataFrame:
    """Bit mask of the probes that fire in each window."""
    fired = exceeds_baseline(scores, base, n_sigma, probe)
    bit = F.when(F.col("fires"), mask_bits(F.col(probe))).otherwise(F.lit(0).cast("long"))
    return fired.groupBy(window).agg(F.bit_or(bit).alias("probe_activation_mask"))


__all__ = [
    "activation_mask",
    "analyze",
    "bin_index",
    "cluster_silhouettes",
    "exceeds_baseline",
    "fit_baseline",
    "gate_motifs",
    "kl_divergence",
    "lsh_pairs",
    "lsh_planes",
    "lsh_signatures",
    "motif_sequences",
    "motifs",
    "promote_probes",
    "query_semantic",
    "query_temporal",
    "retrieve",
    "score_baseline",
    "score_windows",
]
