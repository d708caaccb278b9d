"""Spatial, signal, graph and model operators against numpy or brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromafield.operators import aggregates as A
from chromafield.operators import graph as G
from chromafield.operators import models as M
from chromafield.operators import ranking, signal, spatial
from chromafield.schemas import SPEED_OF_LIGHT


def cloud(seed, n, pile=0):
    """Clustered points with far outliers and a pile of copies."""
    rnd = random.Random(seed)
    pts = [(rnd.gauss(0, 0.05), rnd.gauss(0, 0.05), rnd.gauss(0, 0.05)) for _ in range(n)]
    pts += [(rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(n // 5)]
    pts += [(1.0, 1.0, 1.0)] * pile
    return [(i, *p) for i, p in enumerate(pts)]


SCHEMA = "id long, x double, y double, z double"


def test_knn_exact_with_copies_and_outliers(spark):
    data = cloud(1, 60, pile=30)
    pos = np.array([p[1:] for p in data])
    got = {}
    for r in spatial.knn(spark.createDataFrame(data, SCHEMA), 5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(len(data)):
        d2 = ((pos - pos[i]) ** 2).sum(axis=1)
        want = sorted((d, j) for j, d in enumerate(d2) if j != i)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def nearest_by_hand(data, k):
    pos = np.array([p[1:4] for p in data])
    out = {}
    for i in range(len(data)):
        d2 = ((pos - pos[i]) ** 2).sum(axis=1)
        out[data[i][0]] = [data[j][0] for _, j in sorted((d, j) for j, d in enumerate(d2) if j != i)[:k]]
    return out


def test_knn_descends_into_a_dense_cluster(spark, monkeypatch):
    """Outliers reach a cluster through its finer cells; few of its points are read for them."""
    rnd = random.Random(4)
    data = [(i, *(1 + rnd.gauss(0, 1e-3) for _ in "xyz")) for i in range(900)]
    data += [(1000 + i, *(rnd.uniform(-50, 50) for _ in "xyz")) for i in range(4)]
    data += [(2000 + i, 1.0, 1.0, 1.0) for i in range(9)] + [(3000, 50.0, 50.0, 50.0)]
    read = []
    keep = spatial.store_table
    monkeypatch.setattr(spatial, "store_table", lambda df, name: read.append((name, keep(df, name))) or read[-1][1])
    df = spark.createDataFrame(data + [(5000, float("nan"), 0.0, 0.0), (5001, None, 0.0, 0.0)], SCHEMA)
    rows = spatial.knn(df, 4, heavy=40).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == nearest_by_hand(data, 4)
    asked = [t for name, t in read if name == "knn-cells"]
    assert len(asked) > 2  # the outliers went down several levels
    far = asked[-1].where("abs(x) > 5 and abs(x) < 49.9").groupBy("x").agg(F.sum("_n").alias("n"))
    assert far.count() == 4 and far.agg(F.max("n")).first()[0] < 400


def test_knn_by_parts_of_any_size(spark):
    rnd = random.Random(9)
    data = [(i, *(rnd.gauss(0, 1 + i % 3) for _ in "xyz"), "abc"[min(i % 7, 2)]) for i in range(200)] + [(900, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(data, SCHEMA + ", part string")
    got = {}
    for r in spatial.knn(df, 30, by=["part"]).orderBy("rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = {}
    for part in "abc":
        want |= nearest_by_hand([d for d in data if d[4] == part], 30)
    assert got == want


def test_knn_fewer_points_than_k(spark):
    got = spatial.knn(spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0)], SCHEMA), 20).collect()
    assert {(r["id"], r["neighbour"]) for r in got} == {(1, 2), (2, 1)}


def test_density_of_uniform_ball(spark):
    """Unit mass spread evenly over a ball of radius 1: the density at its middle within 1 %."""
    step, h = 0.08, 0.5
    ticks = np.arange(-14, 15) * step
    grid = [(x, y, z) for x in ticks for y in ticks for z in ticks if x * x + y * y + z * z <= 1.0]
    data = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(grid)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("m", F.lit(1.0 / len(data)))
    middle = spatial.kernel_density(df, h, "m").where("x = 0 AND y = 0 AND z = 0").first()["density"]
    assert middle == pytest.approx(3 / (4 * math.pi), rel=0.01)
    slope = spatial.density_gradient(df, h, "m").where("x = 0 AND y = 0 AND z = 0").first()["gradient"]
    assert slope == pytest.approx(0.0, abs=1e-9)


def test_kernel_sums_of_dense_cells(spark, monkeypatch):
    """Cells of many tiles beside almost empty ones, with copies, against all pairs."""
    monkeypatch.setattr(spatial, "TILE_ROWS", 16)
    rng, h = np.random.default_rng(5), 0.5
    at = np.vstack([rng.normal(size=(150, 3)) * 0.2, rng.normal(size=(30, 3)) * 2, np.zeros((3, 3)), [[40.0, 0, 0]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], SCHEMA)
    d = at[None] - at[:, None]
    r = np.sqrt((d**2).sum(2))
    density = (315 / (64 * math.pi * h**9) * np.where(r <= h, h * h - r * r, 0) ** 3).sum(1)
    pull = np.where((r <= h) & (r > 0), 45 / (math.pi * h**6) * (h - r) ** 2 / np.where(r > 0, r, 1), 0)
    slope = np.sqrt(((pull[:, :, None] * d).sum(1) ** 2).sum(1))
    dense, steep = spatial.kernel_density(df, h), spatial.density_gradient(df, h)
    # no row per pair of a dense cell
    assert "FlatMapGroupsInPandas" in dense._jdf.queryExecution().toString()
    got = {r["id"]: r["density"] for r in dense.collect()}
    assert [got[i] for i in range(len(at))] == pytest.approx(density.tolist())
    got = {r["id"]: r["gradient"] for r in steep.collect()}
    assert [got[i] for i in range(len(at))] == pytest.approx(slope.tolist(), abs=1e-9)


def test_near_edges_star(spark):
    data = [(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 0.5, 0.0, 0.0), (5, 3.0, 0.0, 0.0)]
    got = {(r["src"], r["dst"]) for r in spatial.near_edges(spark.createDataFrame(data, SCHEMA), 1.0).collect()}
    assert got == {(1, 2), (1, 3), (1, 4)}


def test_rf_without_geometry(spark):
    rf = spark.createDataFrame([(i, *p[1:], 1.0) for i, p in enumerate(cloud(2, 80))], SCHEMA + ", energy double")
    video = spark.createDataFrame(cloud(3, 80), SCHEMA)
    got = {r["id"] for r in spatial.rf_without_geometry(rf, video, 0.04, 0.5).collect()}
    v = np.array([p[1:] for p in cloud(3, 80)])
    want = {i for i, p in enumerate(cloud(2, 80)) if ((v - np.array(p[1:])) ** 2).sum(axis=1).min() > 0.04**2}
    assert got == want


def test_standing_wave_null(spark):
    """Two equal waves in opposite phase: nulls repeat every half wavelength within 5 %."""
    f = 299_792_458.0 / 2.0  # wavelength 2 m
    wall = [(-40.0, 0.0, 0.0, 40.0**2, 0.0), (40.0, 0.0, 0.0, 40.0**2, math.pi)]
    paths = spark.createDataFrame(wall, "x double, y double, z double, amplitude double, phase double")
    xs = [i * 0.02 for i in range(-100, 101)]
    points = spark.createDataFrame([(i, x, 0.0, 0.0) for i, x in enumerate(xs)], "point_id int, x double, y double, z double")
    gamma = {r["point_id"]: r["gamma"] for r in A.field_at(points, paths, f, 1e6).collect()}
    nulls = [xs[i] for i in range(1, len(xs) - 1) if gamma[i] < gamma[i - 1] and gamma[i] < gamma[i + 1]]
    gaps = np.diff(nulls)
    assert SPEED_OF_LIGHT / f == 2.0 and len(gaps) >= 2 and np.all(np.abs(gaps - 1.0) <= 0.05)


def test_coherence_extremes(spark):
    df = spark.createDataFrame([("same", 1.0, 0.0), ("same", 2.0, 0.0), ("opp", 1.0, 0.0), ("opp", -1.0, 0.0), ("zero", 0.0, 0.0)], "k string, re double, im double")
    got = {r["k"]: r["gamma"] for r in A.phase_coherence(df, ["k"]).collect()}
    assert got == {"same": 1.0, "opp": 0.0, "zero": None}


def test_verdict_table(spark):
    votes = spark.createDataFrame(
        [(1, 0.9, 0.9, 0.9), (2, 0.9, 0.9, 0.1), (3, 0.1, 0.9, 0.1), (4, 0.9, None, 0.1), (5, 0.1, 0.1, 0.1)],
        "id int, gpu_score double, coral_score double, tdoa_confidence double",
    )
    got = {r["id"]: (r["anomalous"], r["dissenter"], r["jury_flags"]) for r in A.verdict(votes, (0.5, 0.5, 0.5)).collect()}
    assert got == {1: (True, None, 1), 2: (True, 2, 2 + 16), 3: (False, 1, 2 + 8), 4: (False, None, 32), 5: (False, None, 1)}


def test_spectrum_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=20) + 1j * rng.normal(size=20)
    df = spark.createDataFrame([(0, i, float(v.real), float(v.imag)) for i, v in enumerate(x)], "sensor_id int, timestamp_us long, re double, im double")
    out = signal.spectrum(df, 16, 16.0, width=3).collect()
    for window, part in ((0, x[:16]), (1, np.concatenate([x[16:], np.zeros(12)]))):
        bins = sorted((r["bin"], r["re"] + 1j * r["im"]) for r in out if r["window"] == window)
        assert np.allclose([v for _, v in bins], np.fft.fft(part), atol=1e-5)
    assert {r["frequency_hz"] for r in out if r["bin"] == 15} == {-1.0}


@pytest.mark.parametrize("taps", [4, 8])
def test_wavelet_keeps_energy(taps):
    x = np.random.default_rng(5).normal(size=(3, 128))
    e = signal.dwt_energies(x, taps, 6)
    assert np.allclose(e.sum(axis=1), (x**2).sum(axis=1), atol=1e-8)
    flat = signal.dwt_energies(np.ones((1, 128)), taps, 6)
    assert np.allclose(flat[0, :-1], 0, atol=1e-12)  # a constant has no detail


def warped(x, y, band=None):
    n, m = len(x), len(y)
    c = np.full((n + 1, m + 1), np.inf)
    c[0, 0] = 0
    for i in range(n):
        for j in range(m):
            if band is not None and n > 1:
                centre = math.floor(i * (m - 1) / (n - 1) + 0.5)
                if abs(j - centre) > max(band, math.ceil((m - 1) / (n - 1))):
                    continue
            c[i + 1, j + 1] = abs(x[i] - y[j]) + min(c[i, j + 1], c[i + 1, j], c[i, j])
    return c[-1, -1]


def vector_table(spark, name, rows):
    return spark.createDataFrame(rows, f"{name} int, embedding array<double>").repartition(3)


@pytest.mark.parametrize("band", [None, 1, 3])
def test_warping_brute_force(spark, band, monkeypatch):
    rng = np.random.default_rng(6)
    a = [rng.normal(size=n).tolist() for n in (9, 9, 9, 9, 5, 1, 0)] + [None]
    b = [rng.normal(size=n).tolist() for n in (7, 7, 7, 9, 1, 0)] + [None]
    w, t = vector_table(spark, "vec_id", list(enumerate(a))), vector_table(spark, "template_id", list(enumerate(b)))
    for values in (2_000_000, 9):  # one block of templates, and several
        monkeypatch.setattr(signal, "BLOCK_VALUES", values)
        got = {(r["vec_id"], r["template_id"]): r["dtw"] for r in signal.template_scores(w, t, band=band).collect()}
        assert len(got) == 7 * 6
        for (i, j), d in got.items():
            assert d == pytest.approx(warped(a[i], b[j], band)) or d == warped(a[i], b[j], band)
    pairs = w.crossJoin(t.withColumnRenamed("embedding", "other"))
    for r in pairs.select("vec_id", "template_id", signal.dtw(F.col("embedding"), F.col("other"), band).alias("d")).collect():
        x, y = a[r["vec_id"]], b[r["template_id"]]
        if x is None or y is None:
            assert r["d"] is None
        else:
            assert r["d"] == pytest.approx(warped(x, y, band)) or r["d"] == warped(x, y, band)


@pytest.mark.parametrize("band, values", [(None, 2_000_000), (2, 2_000_000), (2, 200)])
def test_nearest_templates_are_exact_and_few_are_scored(spark, band, values, monkeypatch):
    """Windows near one of 60 templates; ties between equal templates go to the smaller id."""
    monkeypatch.setattr(signal, "BLOCK_VALUES", values)
    rng = np.random.default_rng(8)
    b = [(4 * rng.normal() + np.cumsum(rng.normal(size=12))).tolist() for _ in range(60)]
    b[40], b[50] = b[7], b[7]
    a = [(np.array(b[rng.integers(60)]) + 0.1 * rng.normal(size=12)).tolist() for _ in range(30)] + [b[7], None, []]
    w, t = vector_table(spark, "vec_id", list(enumerate(a))), vector_table(spark, "template_id", list(enumerate(b)))
    rows = signal.template_matches(w, t, 3, band).collect()
    for i, x in enumerate(a[:31]):
        want = sorted((warped(x, y, band), j) for j, y in enumerate(b))[:3]
        got = sorted((r["rank"], r["template_id"], r["dtw"]) for r in rows if r["vec_id"] == i)
        assert [g[1] for g in got] == [j for _, j in want] and [g[0] for g in got] == [1, 2, 3]
        assert [g[2] for g in got] == pytest.approx([d for d, _ in want])
    assert not [r for r in rows if r["vec_id"] in (31, 32)]
    if values > 200:
        scored = {r["vec_id"]: r["scored"] for r in rows}
        assert sum(scored.values()) < (0.5 if band is None else 0.35) * 60 * 31
    assert signal.template_matches(w, t.limit(0)).count() == 0


def test_warping_gives_up_early():
    x, y = np.zeros((3, 50)), np.array([[0.0] * 50, [1.0] * 50, [9.0] * 50])
    got = signal.warp_pairs(x, y, 4, np.array([0.0, 50.0, 50.0]))
    assert got.tolist() == [0.0, 50.0, np.inf]


def test_eigenvectors_residual(spark):
    """A two-part graph: orthonormal vectors and a small residual on the leading one."""
    rnd = random.Random(7)
    links = {}
    for i in range(24):
        for j in range(i):
            if (i < 12) == (j < 12) or rnd.random() < 0.03:
                links[(i, j)] = links[(j, i)] = rnd.uniform(0.5, 1.0)
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in links.items()], "src long, dst long, weight double")
    v = np.array([tuple(r) for r in G.eigenvectors(edges, 2, 25).orderBy("id").select("v1", "v2").collect()])
    w = np.zeros((24, 24))
    for (i, j), x in links.items():
        w[i, j] = x
    s = 1 / np.sqrt(w.sum(axis=1))
    m = np.eye(24) + s[:, None] * w * s[None, :]
    assert np.allclose(v.T @ v, np.eye(2), atol=1e-8)
    for k in range(2):
        lam = v[:, k] @ m @ v[:, k]
        assert np.linalg.norm(m @ v[:, k] - lam * v[:, k]) < 1e-2
    assert len(set(np.sign(v[:12, 1]))) == 1 and np.sign(v[0, 1]) != np.sign(v[20, 1])


def test_follow_parents_long_chain(spark):
    chain = [(i, max(0, i - 1)) for i in range(300)] + [(1000, 1000), (1001, 1000)]
    got = {r["id"]: r["root"] for r in G.follow_parents(spark.createDataFrame(chain, "id long, parent long")).collect()}
    assert all(got[i] == 0 for i in range(300)) and got[1000] == got[1001] == 1000
    with pytest.raises(ValueError):
        G.follow_parents(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"), max_rounds=5)


def test_farthest_points_line(spark):
    df = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(11)], "frame int, particle_id long, x double, y double, z double")
    got = [r["particle_id"] for r in ranking.farthest_points(df, 4).orderBy("pick").collect()]
    assert got == [0, 10, 5, 2]


def test_motif_gate_logs_rejections(spark):
    rng = np.random.default_rng(8)
    pts = [(i, (rng.normal(size=4) * 0.01 + 5 * (i % 2)).tolist()) for i in range(20)]
    pts += [(100 + i, (rng.normal(size=4) * 2 - 10).tolist()) for i in range(10)]
    df = spark.createDataFrame(pts, "id long, embedding array<double>")
    assigned, gate = M.motifs(df, 5, 0.6, seed=1)
    rows = gate.collect()
    assert assigned.count() == 30 and any(r["accepted"] for r in rows)
    assert all((r["log"] is None) == r["accepted"] for r in rows)
    assert any(r["log"] and r["log"].startswith("rejected: score") for r in rows)


@pytest.mark.parametrize("tile_rows", [1024, 7, 1])
def test_contrastive_loss_of_tiles(spark, tile_rows):
    """Batches of many tiles, of one row, with lonely labels, zero vectors and nulls."""
    rng = np.random.default_rng(3)
    rows = [(0, int(rng.integers(3)), rng.normal(size=4).tolist()) for _ in range(40)]
    rows += [(1, 5, [1.0, 2.0, 3.0, 4.0])]
    rows += [(2, i, rng.normal(size=4).tolist()) for i in range(5)]
    rows += [(3, 1, [0.0] * 4), (3, 1, [1.0, 0.0, 0.0, 0.0]), (3, 2, [1.0, 1.0, 0.0, 0.0])]
    lost = [(0, None, [1.0] * 4), (0, 1, None)]
    df = spark.createDataFrame(rows + lost, "batch long, label int, embedding array<double>").repartition(3)
    got = {r["batch"]: r for r in A.nt_xent(df, 0.1, tile_rows=tile_rows).collect()}
    assert set(got) == {0, 1, 2, 3}
    for b in got:
        own = [(l, np.array(v)) for i, l, v in rows if i == b]
        unit = [v / (np.linalg.norm(v) or 1) for _, v in own]
        losses = []
        for i in range(len(own)):
            sims = {j: float(unit[i] @ unit[j]) / 0.1 for j in range(len(own)) if j != i}
            for j in sims:
                if own[i][0] == own[j][0]:
                    losses.append(math.log(sum(map(math.exp, sims.values()))) - sims[j])
        assert got[b]["pairs"] == len(losses)
        assert got[b]["loss"] == (pytest.approx(sum(losses) / len(losses)) if losses else None)


def test_contrastive_loss_of_a_large_batch(spark):
    df = spark.range(20_000).selectExpr(
        "0 as batch", "id % 10 as label",
        "transform(sequence(1, 16), i -> hash(id, i) / 4294967296D + if(i = id % 10, 2, 0)) as embedding",
    )
    row = A.nt_xent(df, 0.5, tile_rows=4096).first()
    assert row["pairs"] == 20_000 * 1_999 and 7 < row["loss"] < math.log(20_000)


def test_field_reaches_as_far_as_its_footprint(spark):
    rnd = random.Random(11)
    paths = [(rnd.uniform(-30, 30), rnd.uniform(-3, 3), 0.0, rnd.random(), rnd.random()) for _ in range(300)]
    paths += [(1.0, 1.0, 1.0, 0.5, 0.25 * i) for i in range(20)]
    points = [(i, rnd.uniform(-40, 40), 0.0, 0.5) for i in range(600)] + [(900, 1.0, 1.0, 1.0), (901, 500.0, 0.0, 0.0)]
    f, sigma = 1e8, 1.0
    reach = sigma * math.sqrt(2 * math.log(1e6))
    got = A.field_at(
        spark.createDataFrame(points, "point_id int, x double, y double, z double"),
        spark.createDataFrame(paths, "x double, y double, z double, amplitude double, phase double"),
        f, sigma, tolerance=1e-6,
    ).collect()
    assert len(got) == 602
    k = 2 * math.pi * f / SPEED_OF_LIGHT
    for r in got:
        at = next(p for p in points if p[0] == r["point_id"])
        near, every = [], 0j
        for x, y, z, a, phase in paths:
            d = math.dist(at[1:], (x, y, z))
            if d > 0:
                term = a * math.exp(-d * d / 2) / d**2 * np.exp(1j * (phase - k * d))
                every += term
                near += [term] if d <= reach else []
        assert r["n"] == len(near) and r["field"] == pytest.approx(abs(sum(near)), abs=1e-12)
        assert abs(abs(every) - r["field"]) <= r["left_out"] + 1e-12
        assert r["gamma"] == (pytest.approx(abs(sum(near)) / sum(map(abs, near))) if near else None)


def test_lsh_pairs_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8).tolist()
    rows = [(i, base) for i in range(20)] + [(50, [v + 1e-6 for v in base]), (60, [v + 9 for v in base])]
    got = {(r["a_id"], r["b_id"]) for r in M.lsh_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.1, 8).collect()}
    assert got == {(0, i) for i in range(1, 20)} | {(0, 50)}


def test_lsh_pairs_of_full_buckets(spark, monkeypatch):
    """Buckets of several tiles give the pairs that rows give, each once."""
    rng = np.random.default_rng(3)
    at = np.vstack([rng.normal(size=(200, 4)) * 0.3, rng.normal(size=(60, 4)) * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(at)] + [(900, at[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = []
    for small, size in ((10**6, 2048), (8, 16)):
        monkeypatch.setattr(M, "SMALL_BUCKET", small)
        monkeypatch.setattr(M, "TILE_ROWS", size)
        pairs = M.lsh_pairs(df, 0.4, 4, tables=5, planes=2, bucket=1.0)
        assert "FlatMapGroupsInPandas" in pairs._jdf.queryExecution().toString()
        got = [(r["a_id"], r["b_id"], r["distance"]) for r in pairs.collect()]
        assert len(got) == len({g[:2] for g in got}) and all(g[0] < g[1] for g in got)
        found.append(sorted(got))
    assert found[0] == found[1] and len(found[0]) > 500


def near_by_force(rows, r):
    """Pairs of rows with different ids, as often as the rows have them."""
    pairs = []
    for n, (i, v) in enumerate(rows):
        for j, w in rows[n + 1 :]:
            if i != j and len(v) == len(w) and math.dist(v, w) <= r:
                pairs.append((min(i, j), max(i, j), math.dist(v, w)))
    return sorted(pairs)


@pytest.mark.parametrize("tile, block", [(16_384, 1 << 15), (16, 64 * 5)])
def test_lsh_pairs_leave_none_out(spark, monkeypatch, tile, block):
    """Near vectors that share no bucket are pairs, too, whether in one tile or in several."""
    monkeypatch.setattr(M, "TILE_ROWS", tile)
    monkeypatch.setattr(M, "BLOCK_VALUES", block, raising=False)
    rng = np.random.default_rng(9)
    at = rng.normal(size=(150, 64))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    far = np.vstack([at[:60] + 50, at[40:90] - 50])
    rows = [(f"{n % 7}-{n}", v.tolist()) for n, v in enumerate(np.vstack([at, far]))]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    want = near_by_force(rows, 1.2)
    got = sorted(tuple(r) for r in M.lsh_pairs(df, 1.2, 64, tables=6, planes=3, bucket=1.5).collect())
    assert len(want) > 150 and [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


@pytest.mark.parametrize("tile", [16_384, 7])
def test_lsh_pairs_of_each_copy(spark, monkeypatch, tile):
    """Copies, repeated ids and lengths that mix; what is not finite is near nothing."""
    monkeypatch.setattr(M, "TILE_ROWS", tile)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(100 + i, rows[5][1]) for i in range(9)] + [(5, rows[6][1]), (5, rows[5][1])]
    rows += [(200 + i, rng.normal(size=size).tolist()) for i, size in enumerate([2, 2, 2, 5, 5, 5, 0, 0])]
    rows += [(300, [1e200, 0.0, 0.0]), (301, [1e200, 0.5, 0.0]), (302, [-1e200, 0.5, 0.0]), (303, [0.0] * 3), (304, [-0.0] * 3)]
    odd = [(400 + i, [v] * 3) for i, v in enumerate([math.nan, math.nan, math.inf, math.inf, None, None])]
    odd += [(500, None), (501, None), (None, rows[5][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in M.lsh_pairs(df, 1.5, 3, tables=2, planes=2, each_copy=True).collect())
    want = near_by_force(rows, 1.5)
    assert {(300, 301), (206, 207), (303, 304), (100, 101)} <= {w[:2] for w in want}
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    hung = {tuple(r)[:2] for r in M.lsh_pairs(df, 1.5, 3, tables=2, planes=2).collect()}
    assert hung < {w[:2] for w in want} and {(5, 100 + i) for i in range(9)} <= hung and (100, 101) not in hung


def test_approximate_neighbours_of_copies_and_repeated_ids(spark, tmp_path):
    """The query gives its SQL's rows where vectors or ids repeat."""
    import duckdb

    from chromafield.plans.catalog import ORACLES, QUERIES
    from tests.check import compare

    rng = np.random.default_rng(6)
    at = rng.normal(size=(80, 64))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(at)]
    rows += [(1000 + i, rows[3][1], 3) for i in range(12)] + [(7, rows[3][1], 3), (7, rows[3][1], 3), (7, rows[8][1], 8)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    problem, count = compare(QUERIES["approximate_neighbours"](spark, str(tmp_path)), con, ORACLES["approximate_neighbours"])
    assert problem is None and count > 13 * 12 / 2


def test_probe_promotion(spark):
    scores = spark.createDataFrame([(0, "rf", w, 5.0 if 2 <= w <= 4 else 0.0) for w in range(8)] + [(1, "rf", w, 5.0 if w == 3 else 0.0) for w in range(8)], "probe int, domain string, window long, score double")
    base = spark.createDataFrame([(0, 0.0, 1.0), (1, 0.0, 1.0)], "probe int, mean double, sigma double")
    flags = spark.createDataFrame([(w,) for w in range(2, 8)], "window long")
    got = M.promote_probes(scores, base, flags).collect()
    assert [(r["probe"], r["start_us"], r["end_us"], r["rows"]) for r in got] == [(0, 2, 4, 3)]
    masks = {r["window"]: r["probe_activation_mask"] for r in M.activation_mask(scores, base).collect()}
    assert masks[3] == 3 and masks[2] == 1 and masks[0] == 0


def test_baseline_covers_all_bins(spark):
    bins = {"v": (0.0, 1.0, 4)}
    df = spark.createDataFrame([(0.1,), (0.1,), (2.0,)], "v double")
    base = M.fit_baseline(df, bins)
    p = {r["bin"]: r["p"] for r in base.collect()}
    assert sum(p.values()) == pytest.approx(1.0) and p[0] == pytest.approx(3 / 7) and p[3] == pytest.approx(2 / 7)
    assert M.kl_divergence(base, base).first()["kl"] == pytest.approx(0.0)


def test_long_motif_sequences(spark):
    """Sessions are cut at gaps only, and a pattern may be as long as a session."""
    rows = [("k", s * 10_000 + i, i) for s in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, timestamp_us long, motif int")
    found = {tuple(r["pattern"]): r["freq"] for r in M.motif_sequences(df, 1.0, ["k"], gap_us=100).collect()}
    assert found[(0, 1, 2, 3, 4, 5)] == 4 and len(found) == 2**6 - 1
    assert (5, 0) not in found


def by_cosine(rows, query, k):
    q = np.array(query)
    unit = [(float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q))), i) for i, v in rows]
    return [(i, s) for s, i in sorted(unit, key=lambda r: (-round(r[0], 12), r[1]))[:k]]


@pytest.mark.parametrize("cells", [1, 12, 100])
def test_index_search_is_exact_and_opens_few_cells(spark, tmp_path, cells):
    from chromafield.operators import vector_index as X

    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 16)) * 5
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(2400)]
    rows += [(5000 + i, rows[7][1]) for i in range(8)]
    extra = [(9000, None), (9001, [0.0] * 16), (9002, [1.0] * 3), (9003, [float("nan")] * 16)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>").withColumn("note", F.lit("n"))
    X.build_index(df.repartition(4), str(tmp_path / "ix"), cells=cells)
    index = X.open_index(spark, str(tmp_path / "ix"))
    assert index.cells["n"].sum() == len(rows)
    for number, query in enumerate([rows[7][1], rows[100][1], centres[3].tolist(), rng.normal(size=16).tolist(), [1.0] + [0.0] * 15]):
        for k in (1, 5, 40):
            got = [(r["vec_id"], r["similarity"]) for r in index.search(query, k).collect()]
            want = by_cosine(rows, query, k)
            assert [g[1] for g in got] == pytest.approx([w[1] for w in want])
            if number != 0:
                assert [g[0] for g in got] == [w[0] for w in want]
        if number < 3 and cells == 12:
            assert index.last_cells < 12
    assert index.search(rows[7][1], 3).columns == ["vec_id", "embedding", "note", "similarity"]
    assert index.search([0.0] * 16, 3).count() == 0
    assert index.search(rows[7][1], 9999).count() == len(rows)


def test_retrieve_through_an_index(spark, tmp_path):
    from chromafield.operators import vector_index as X

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes = df.selectExpr("concat('event:', vec_id) as id", "'Event' as type", "'' as props")
    edges = nodes.selectExpr("id as src", "'x' as dst", "'IN' as type", "0L as ts")
    index = X.build_index(df, str(tmp_path / "ix"), cells=4)
    plain, through = (M.retrieve(rows[3][1], source, nodes, edges, 5) for source in (df, index))
    key = lambda r: (r["id"], round(r["similarity"], 9))
    assert sorted(map(key, plain.collect())) == sorted(map(key, through.collect()))


def test_silhouettes_of_many_clusters(spark, monkeypatch):
    """Blocks of clusters give the same rows as one; over a thousand clusters are fine."""
    rng = np.random.default_rng(1)
    rows = [(int(i % 1500), (rng.normal(size=3) + i % 1500).tolist()) for i in range(4000)] + [(7000, [1.0] * 3), (None, [0.0] * 3)]
    df = spark.createDataFrame(rows, "c int, v array<double>").repartition(2)
    one = {r["c"]: r for r in M.cluster_silhouettes(df, "c", "v").collect()}
    monkeypatch.setattr(M, "CLUSTER_VALUES", 3000)
    many = {r["c"]: r for r in M.cluster_silhouettes(df, "c", "v").collect()}
    assert set(one) == set(many) and len(one) == 1501 and one[7000]["silhouette"] == 0.0
    assert all(one[c]["silhouette"] == pytest.approx(many[c]["silhouette"]) for c in one)
    x, own = np.array([v for _, v in rows[:-1]]), np.array([c for c, _ in rows[:-1]])
    for c in (0, 3, 1499):
        values = []
        for i in np.flatnonzero(own == c):
            d = ((x - x[i]) ** 2).sum(axis=1)
            a = d[own == c].sum() / ((own == c).sum() - 1)
            b = min(d[own == o].mean() for o in set(own.tolist()) - {c})
            values.append((b - a) / max(a, b))
        assert one[c]["silhouette"] == pytest.approx(sum(values) / len(values))


def test_baseline_of_any_number_of_bins(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (0.25,), (None,)], "v double")
    bins = {"v": (0.0, 1.0, 3_000_000)}
    p = M.fit_baseline(df, bins)
    assert p.count() == 3_000_000 and p.agg(F.sum("p")).first()[0] == pytest.approx(1.0)
    assert p.agg(F.max("p")).first()[0] == pytest.approx(3 / 3_000_003)
