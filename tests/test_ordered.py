"""Sliced operators against plain windows, with slices small enough to cross borders."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chromafield.operators import windows as W
from chromafield.operators.joins import asof_join, clock_pairs, corroborated, relate
from chromafield.operators.ordered import (
    lag_rows,
    nearest_before,
    plan_width,
    prefix_scan,
    row_index,
    running_moments,
    slice_of,
)
from chromafield.operators.ranking import count_windows, traversals


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(400):
        # one hot key, ties in time, negative times and a null key
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        data.append((i, key, rnd.randint(-50, 300), rnd.choice([None, 1.0, 2.5, -3.0, rnd.random()])))
    return spark.createDataFrame(data, "id long, k string, t long, v double").cache()


def as_dict(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def close(a, b, tol=1e-9):
    assert a.keys() == b.keys()
    for k, x in a.items():
        y = b[k]
        if isinstance(x, float) and isinstance(y, float):
            assert math.isclose(x, y, rel_tol=tol, abs_tol=tol), (k, x, y)
        else:
            assert x == y, (k, x, y)


W_ALL = lambda: Window.partitionBy("k").orderBy("t", "id")


@pytest.mark.parametrize("width", [1, 7, 50, None])
def test_lag(rows, width):
    got = lag_rows(rows, ["k"], "t", ["v", "t"], ["id"], width)
    want = rows.withColumn("prev_v", F.lag("v").over(W_ALL())).withColumn("prev_t", F.lag("t").over(W_ALL()))
    close(as_dict(got, "prev_v"), as_dict(want, "prev_v"))
    close(as_dict(got, "prev_t"), as_dict(want, "prev_t"))


@pytest.mark.parametrize("kind,exclusive", [("sum", False), ("sum", True), ("max", False), ("min", False), ("first", False)])
def test_prefix(rows, kind, exclusive):
    w = W_ALL().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    x = F.coalesce("v", F.lit(0.0)) if kind == "sum" else F.col("v")
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "first": F.first}[kind]
    got = prefix_scan(rows, ["k"], "t", {"s": x}, ["id"], 13, kind, exclusive)
    want = rows.withColumn("s", fold(x).over(w))
    if kind == "sum":
        want = want.withColumn("s", F.coalesce("s", F.lit(0.0)))
    close(as_dict(got, "s"), as_dict(want, "s"))


def test_product_any_and_totals(rows):
    x = 1 + F.coalesce("v", F.lit(0.0)) / 100
    w = W_ALL().rowsBetween(Window.unboundedPreceding, -1)
    got = W.scan(rows, x, "exclusive_product", ["k"], "t", ["id"], 9)
    want = rows.withColumn("scan", F.coalesce(F.product(x).over(w), F.lit(1.0)))
    close(as_dict(got, "scan"), as_dict(want, "scan"))
    got = W.scan(rows, F.col("v") > 2, "ballot", ["k"], "t", ["id"], 9)
    want = rows.withColumn(
        "scan", F.coalesce(F.bool_or(F.col("v") > 2).over(W_ALL().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    )
    close(as_dict(got, "scan"), as_dict(want, "scan"))
    got = row_index(rows, ["k"], "t", ["id"], 9, "i", {"n": ("sum", F.lit(1).cast("long")), "last": ("max", F.col("t"))})
    whole = Window.partitionBy("k")
    want = rows.withColumns({"i": F.row_number().over(W_ALL()), "n": F.count("*").over(whole), "last": F.max("t").over(whole)})
    for col in ("i", "n", "last"):
        close(as_dict(got, col), as_dict(want, col))


def test_running_moments(rows):
    w = W_ALL().rowsBetween(Window.unboundedPreceding, -1)
    got = running_moments(rows, ["k"], "t", "v", ["id"], 11)
    want = rows.withColumns({"past_n": F.count("v").over(w), "past_mean": F.avg("v").over(w), "past_sd": F.stddev_pop("v").over(w)})
    for col in ("past_n", "past_mean", "past_sd"):
        close(as_dict(got, col), as_dict(want, col), 1e-7)


@pytest.mark.parametrize("width", [1, 20, None])
def test_rolling_and_history(rows, width):
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-40, -1)
    got = W.rolling_z(rows, ["k"], "v", 40, "t", width)
    want = rows.withColumns({"base_n": F.count("v").over(w), "base_mean": F.avg("v").over(w)})
    close(as_dict(got, "base_n"), as_dict(want, "base_n"))
    close(as_dict(got, "base_mean"), as_dict(want, "base_mean"))
    got = W.history(rows, ["k"], "id", rows=5, ts="t", tie=["id"], width=width)
    want = rows.withColumn("history", F.collect_list("id").over(W_ALL().rowsBetween(-4, 0)))
    close(as_dict(got, "history"), as_dict(want, "history"))


@pytest.mark.parametrize("width", [1, 30, None])
def test_decay_matches_recurrence(rows, width):
    tau = 10
    data = rows.where("v IS NOT NULL")
    got = as_dict(W.decay_smooth(data, ["k"], "v", tau, "t", ["id"], width), "smoothed")
    state = {}
    for r in sorted(data.collect(), key=lambda r: (r["t"], r["id"])):
        last = state.get(r["k"])
        keep = 0.0 if last is None else math.exp(-(r["t"] - last[0]) / tau)
        x = (0.0 if last is None else last[1]) * keep + (1 - keep) * r["v"]
        state[r["k"]] = (r["t"], x)
        assert math.isclose(got[r["id"]], x, rel_tol=1e-9, abs_tol=1e-12)


def test_decay_with_dropped_steps(spark):
    """With 30 % of the steps dropped the true intervals keep the error within 15 %."""
    rnd = random.Random(3)
    truth = [(1, i, i * 100, math.sin(i / 40)) for i in range(1000)]
    kept = [r for r in truth if rnd.random() > 0.3]

    def error(data):
        df = spark.createDataFrame(data, "k long, id long, t long, v double")
        out = W.decay_smooth(df, ["k"], "v", 500, "t", ["id"]).collect()
        return math.sqrt(sum((r["smoothed"] - r["v"]) ** 2 for r in out) / len(out))

    assert error(kept) <= 1.15 * error(truth)


def test_islands_cross_slices(spark):
    flags = [1, 1, 1, 0, 1, 1, 0, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate(flags)], "k string, t long, f int")
    got = {(r["start_us"], r["end_us"], r["rows"]) for r in W.sustained(df, ["k"], F.col("f") == 1, 3, "t", (), 2).collect()}
    assert got == {(0, 2, 3), (8, 11, 4)}


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("width", [1, 25, None])
def test_nearest(rows, forward, width):
    left = rows.select("id", "k", "t")
    right = rows.where("v IS NOT NULL AND k IS NOT NULL").select("k", "t", F.col("id").alias("rid"))
    got = nearest_before(left, right, "t", ["k"], ["rid"], ["rid"], width, forward)
    table = {}
    for r in right.collect():
        table.setdefault(r["k"], []).append((r["t"], r["rid"]))
    for r in got.select("id", "k", "t", "_match").collect():
        near = [x for x in table.get(r["k"], []) if (x[0] >= r["t"] if forward else x[0] <= r["t"])]
        want = None if not near else (min(near) if forward else max(near))
        assert (None if r["_match"] is None else (r["_match"]["t"], r["_match"]["rid"])) == want


def test_asof_tolerance_and_ties(spark):
    left = spark.createDataFrame([(1, 100), (2, 150), (3, 5)], "id long, ts long")
    env = spark.createDataFrame([(100, 1.0), (100, 2.0), (90, 9.0)], "ts long, temp double")
    got = {r["id"]: (r["env_ts"], r["env_temp"]) for r in asof_join(left, env, "ts", tolerance=20, tie=["temp"], width=16).collect()}
    # a right row at the same instant counts; of two, the larger tie value; too old is null
    assert got == {1: (100, 2.0), 2: (None, None), 3: (None, None)}


def test_clock_pairs_prefer_earlier(spark):
    a = spark.createDataFrame([(1, 100), (2, 200), (3, 900)], "particle_id long, timestamp_us long")
    b = spark.createDataFrame([(7, 95), (8, 105), (9, 201)], "particle_id long, timestamp_us long")
    got = {(r["a_id"], r["b_id"], r["divergence_us"]) for r in clock_pairs(a, b, 10, width=8).collect()}
    assert got == {(1, 7, -5), (2, 9, 1)}
    assert {r["particle_id"] for r in corroborated(a, b, 5, width=8).collect()} == {1, 2}


def test_relate_keeps_supplied_causes(spark):
    ev = spark.createDataFrame([(1, 0, 1), (2, 5, 2), (3, 50, 1)], "particle_id long, timestamp_us long, sensor_id int")
    causes = spark.createDataFrame([("event:1", "event:3", "CAUSED_BY", 50), ("x", "y", "OTHER", 1)], "src string, dst string, type string, ts long")
    got = {(r["src"], r["dst"], r["type"]) for r in relate(ev, 10, width=3, supplied=causes).collect()}
    assert got == {
        ("event:1", "event:2", "PRECEDES"),
        ("entity:1", "entity:2", "CO_OCCURS_WITH"),
        ("event:1", "event:3", "CAUSED_BY"),
    }


def test_count_windows_and_traversals(spark, rows):
    got = count_windows(rows, 10, ["k"], "t", ["id"], 17)
    sizes = got.groupBy("k", "window").count().collect()
    assert all(r["count"] <= 10 for r in sizes)
    assert sum(r["count"] == 10 for r in sizes) >= len(sizes) - 4
    p = spark.createDataFrame([(0, i, float(i % 5), -float(i), 0.0, i * 0.1) for i in range(20)], "frame long, patch long, v1 double, v2 double, v3 double, v4 double")
    out = traversals(p, width=10**9).collect()
    places = {(r["stream"], r["patch"]): r["place"] for r in out}
    order = sorted(range(20), key=lambda i: (i % 5, i))
    assert all(places[(0, patch)] == n + 1 for n, patch in enumerate(order))
    assert all(places[(1, i)] == 21 - places[(0, i)] for i in range(20))


@pytest.mark.parametrize("width", [1, 40, None])
def test_ranked(spark, width):
    rnd = random.Random(9)
    data = [(i, i % 2, round(rnd.random(), 1)) for i in range(120)]
    df = spark.createDataFrame(data, "id long, g int, e double")
    got = W.ranked(df, ["g"], "e", "id", 4, width=width)
    w = Window.partitionBy("g").orderBy(F.desc("e"))
    t = Window.partitionBy("g").orderBy(F.desc("e"), "id")
    want = df.withColumns(
        {
            "row_number": F.row_number().over(t),
            "rank": F.rank().over(w),
            "dense_rank": F.dense_rank().over(w),
            "percent_rank": F.percent_rank().over(w),
            "ntile": F.ntile(4).over(t),
        }
    )
    for col in ("row_number", "rank", "dense_rank", "percent_rank", "ntile"):
        close(as_dict(got, col), as_dict(want, col))


def test_chain_blocks_and_tampering(spark):
    import hashlib

    df = spark.createDataFrame([("s", i, f"p{i}") for i in range(23)] + [("u", 0, "x")], "s string, t long, p string")
    built = W.build_chain(df, ["s"], "p", "t", block_rows=3, width=5)
    rows = {(r["s"], r["t"]): r for r in built.collect()}
    first = hashlib.sha256(b"p0").hexdigest()
    assert rows[("s", 0)]["chain_hash"] == first
    assert rows[("s", 1)]["chain_hash"] == hashlib.sha256((first + "p1").encode()).hexdigest()
    assert rows[("u", 0)]["chain_hash"] == hashlib.sha256(b"x").hexdigest()
    assert rows[("s", 22)]["block"] == 7
    assert built.select("chain_hash").distinct().count() == 24
    ok = W.verify_chain(built, ["s"], "p", "t", width=5, block_rows=3)
    assert ok.where("NOT chain_ok").count() == 0
    forged = built.withColumn("p", F.when((F.col("s") == "s") & (F.col("t") == 4), "evil").otherwise(F.col("p")))
    bad = W.verify_chain(forged, ["s"], "p", "t", width=5, block_rows=3).where("NOT chain_ok")
    # the forged row breaks, and so does the start of every later block
    assert {r["t"] for r in bad.collect()} == {4, 6, 9, 12, 15, 18, 21}


def test_chain_of_short_blocks_is_verified_many_at_a_time(spark):
    df = spark.createDataFrame([("s", i, None if i == 9 else f"p{i}") for i in range(23)], "s string, t long, p string")
    built = W.build_chain(df, ["s"], "p", "t", block_rows=4, width=5)
    heads = W._checked_heads(built, ["s"], "p", "t", [], 4)
    # no call of Python per block
    assert "FlatMapGroupsInPandas" not in heads._jdf.queryExecution().toString()
    assert heads.count() == 6
    # a row without a payload has no hash, which ends its chain
    bad = W.verify_chain(built, ["s"], "p", "t", width=5, block_rows=4).where("NOT chain_ok")
    assert min(r["t"] for r in bad.collect()) == 9


def test_plan_width(spark):
    even = spark.range(10_000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"))
    assert plan_width(even, ["k"], "t", 100_000) > 99_000
    width = plan_width(even, ["k"], "t", 100)
    peak = even.groupBy(slice_of(F.col("t"), width)).count().agg(F.max("count")).first()[0]
    assert peak <= 400
    burst = even.unionByName(spark.range(10_000).select(F.lit(1).alias("k"), (F.col("id") % 5000).alias("t")))
    width = plan_width(burst, ["k"], "t", 100)
    peak = burst.groupBy(slice_of(F.col("t"), width)).count().agg(F.max("count")).first()[0]
    assert peak <= 400
    assert plan_width(even.where("t < 0"), ["k"], "t") == 1


def test_rolling_survives_nan(spark):
    data = [(i, "a", i, float("nan") if i == 5 else float(i)) for i in range(12)]
    df = spark.createDataFrame(data, "id long, k string, t long, v double")
    got = as_dict(W.rolling_z(df, ["k"], "v", 3, "t", 4), "base_mean")
    assert math.isnan(got[6]) and math.isnan(got[8]) and got[9] == pytest.approx(7.0) and got[0] is None


def test_step_change_with_and_without_weather(spark):
    from chromafield.operators.aggregates import step_changes

    data = [(i, i * 10, (5.0 if i >= 50 else 1.0) + (i % 2) * 0.1) for i in range(100)]
    df = spark.createDataFrame(data, "id long, timestamp_us long, v double")
    env = df.select("timestamp_us", F.col("v").alias("temp"))
    got = step_changes(df, "v", 200, 20.0, env=env, env_col="temp", width=70).collect()
    assert {r["id"] for r in got} and all(abs(r["id"] - 50) <= 20 for r in got)
    at = next(r for r in got if r["id"] == 50)
    assert at["mean_before"] == pytest.approx(1.05) and at["mean_after"] == pytest.approx(5.05)
    assert at["env_corr"] == pytest.approx(1.0)


@pytest.mark.parametrize("rows", [7, 8, 9, 16, 17, 40])
def test_chain_of_many_levels(spark, rows):
    """Blocks of two: the chain never starts anew, whatever the length."""
    import hashlib

    def link(prev, text):
        return hashlib.sha256((prev + text).encode()).hexdigest()

    def chained(texts):
        """Chain values, and the digest of every full or partial block of two."""
        if len(texts) <= 2:
            heads = [""]
        else:
            digests = [link(link("", a), b) for a, b in zip(texts[::2], texts[1::2])]
            if len(texts) % 2:
                digests.append(link("", texts[-1]))
            heads = ["", *chained(digests)[:-1]]
        out = []
        for b, head in enumerate(heads):
            for text in texts[2 * b : 2 * b + 2]:
                head = link(head, text)
                out.append(head)
        return out

    df = spark.createDataFrame([("s", i, f"p{i}") for i in range(rows)], "s string, t long, p string")
    built = W.build_chain(df, ["s"], "p", "t", block_rows=2, width=5)
    got = [r["chain_hash"] for r in built.orderBy("t").collect()]
    assert got == chained([f"p{i}" for i in range(rows)])
    heads = built.where("block > 0").select("block_head").distinct().collect()
    assert "" not in {r["block_head"] for r in heads}
    assert W.verify_chain(built, ["s"], "p", "t", width=5, block_rows=2).where("NOT chain_ok").count() == 0


def test_rolling_deviation_of_large_values(spark):
    data = [(i, "k", i, 1e8 + i % 2) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, k string, t long, v double")
    rows = W.rolling_z(df, ["k"], "v", 10, "t", 97).where("t >= 10").collect()
    assert all(r["base_sd"] == pytest.approx(0.5) and r["base_mean"] == pytest.approx(1e8 + 0.5) for r in rows)


def test_step_from_a_constant_level(spark):
    from chromafield.operators.aggregates import step_changes

    data = [(i, i * 10, 5.0 if i >= 50 else 1.0) for i in range(100)]
    df = spark.createDataFrame(data, "id long, timestamp_us long, v double")
    got = {r["id"]: r["sigmas"] for r in step_changes(df, "v", 200, 3.0, width=70).collect()}
    assert got[50] == math.inf and min(got) >= 30 and max(got) <= 70


@pytest.mark.parametrize("width", [97, None])
def test_moments_of_two_distant_bands(spark, width):
    """Small deviations at 433 MHz and at 2.4 GHz, in one key; constant stretches have none."""
    import statistics

    from chromafield.operators.aggregates import step_changes

    band = lambda i: 433e6 if i // 50 % 2 else 2.4e9
    values = [band(i) + (0 if i % 50 > 30 else (i * 7 % 5) * 10.0) for i in range(1000)]
    df = spark.createDataFrame([(i, "k", i, v) for i, v in enumerate(values)], "id long, k string, t long, v double")
    got = {r["id"]: r for r in W.rolling_z(df, ["k"], "v", 10, "t", width).collect()}
    assert got[0]["base_n"] == 0 and got[0]["base_sd"] is None
    for i in range(1, 1000):
        frame = values[max(0, i - 10) : i]
        sd = statistics.pstdev(frame)
        assert got[i]["base_n"] == len(frame)
        assert got[i]["base_mean"] == pytest.approx(statistics.fmean(frame), rel=1e-14)
        assert got[i]["base_sd"] == pytest.approx(sd, rel=1e-6) and (got[i]["base_sd"] == 0) == (sd == 0)
    rows = step_changes(df, "v", 10, 3.0, ["k"], "t", width=width).collect()
    assert all(math.isfinite(r["sigmas"]) == (r["sd_before"] > 0) for r in rows)
    endless = {r["id"] for r in rows if r["sigmas"] == math.inf}
    want = {i for i in range(2, 1000) if statistics.pstdev(values[max(0, i - 10) : i]) == 0}
    assert endless <= want


def test_last_rows_are_found_without_a_sort_of_the_table(spark):
    from chromafield.operators.filters import as_of

    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *range(6)]), rnd.choice([None, 1, 2])) for i in range(300)]
    rows += [(900, "lonely", None, None), (901, "z", 3, 1), (901, "z", 3, 1)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v int").repartition(3)

    def order(r):
        return (r[2] is not None, r[2] or 0), (r[3] is not None, r[3] or 0), r[0]

    for limit in (None, 3):
        kept = [r for r in rows if limit is None or (r[2] is not None and r[2] <= limit)]
        want = {r[1]: r for r in sorted(kept, key=order)}
        found = W.latest(df, ["k"], "t", ["v", "id"]) if limit is None else as_of(df, ["k"], limit, "t", ["v", "id"])
        got = found.collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.values()))
        assert found.columns == df.columns
    plan = W.latest(df, ["k"], "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert W.latest(df.limit(0), ["k"], "t").count() == 0


@pytest.mark.parametrize("span, count", [(25, None), (None, 7), (10**6, None)])
def test_shared_history_reads_as_the_copied_one(spark, span, count):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.randrange(120), rnd.choice([None, 1.0, 2.5])) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v double").repartition(3)
    refs, blocks = W.shared_history(df, ["k"], "v", span, count, "t", ["id"], 30, block_rows=8)
    assert refs.count() == 250 and blocks.agg(F.sum(F.size("values"))).first()[0] == 250
    got = {r["id"]: r["history"] for r in W.read_history(refs, blocks, ["k"], ["id"], 8).collect()}
    for i, k, t, _ in rows:
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        if span is not None:
            want = [r[3] for r in own if t - span <= r[2] <= t]
        else:
            upto = [r for r in own if (r[2], r[0]) <= (t, i)]
            want = [r[3] for r in upto[-count:]]
        assert got[i] == [v for v in want if v is not None]


@pytest.mark.parametrize("width", [3, 30, 1000, None])
def test_moments_of_frames_against_brute_force(spark, monkeypatch, width):
    """Cut and whole panes, groups that share rows, ties, null keys and orders, NaN and infinities."""
    import statistics

    from chromafield.operators import ordered

    monkeypatch.setattr(ordered, "MOMENT_ROWS", 20)
    rnd = random.Random(8)
    odd = [None, float("nan"), float("inf"), 2.0]
    rows = []
    for i in range(400):
        t = rnd.choice([None, *range(90, 95)]) if i % 9 == 0 else rnd.randrange(-150, 150)
        v, e = (rnd.choice(odd) if rnd.random() < 0.03 else rnd.uniform(-5, 5) for _ in range(2))
        rows.append((i, rnd.choice(["a", "b", None]), t, 3.0 if t is not None and t > 110 else v, e))
    schema = "id long, k string, t long, v double, `e.x` double"
    df = spark.createDataFrame(rows, schema).withColumn("e", F.col("`e.x`")).repartition(3)
    frames = {"past": (-10, -1), "next": (0, 9), "off": (-7, 5), "far": (53, 62), "one": (0, 0)}
    out = ordered.with_moments(df, ["k"], "t", "v", frames, width, "e")
    assert out.columns[:6] == ["id", "k", "t", "v", "e.x", "e"]
    got = {r["id"]: r.asDict() for r in out.collect()}
    assert len(got) == 400 and out.count() == 400
    for i, k, t, _, _ in rows:
        for name, (lo, hi) in frames.items():
            near = [r for r in rows if t is not None and r[1] == k and r[2] is not None and t + lo <= r[2] <= t + hi]
            vs = [r[3] for r in near if r[3] is not None]
            r = got[i]
            assert r[f"{name}_n"] == len(vs)
            if not vs:
                assert r[f"{name}_mean"] is None and r[f"{name}_sd"] is None
            elif not all(map(math.isfinite, vs)):
                assert math.isnan(r[f"{name}_mean"]) and math.isnan(r[f"{name}_sd"])
            else:
                sd = statistics.pstdev(vs)
                assert r[f"{name}_mean"] == pytest.approx(statistics.fmean(vs), abs=1e-12)
                assert r[f"{name}_sd"] == pytest.approx(sd, abs=1e-12) and (r[f"{name}_sd"] == 0) == (sd == 0)
            pairs = [(r[3], r[4]) for r in near if r[3] is not None and r[4] is not None]
            fine = [p for p in pairs if all(map(math.isfinite, p))]
            assert (r[f"{name}_pairs"], r[f"{name}_pn"]) == (len(pairs), len(fine))
            if fine:
                mx, me = (statistics.fmean(c) for c in zip(*fine))
                assert r[f"{name}_px"] == pytest.approx(mx, abs=1e-12) and r[f"{name}_pe"] == pytest.approx(me, abs=1e-12)
                assert r[f"{name}_xx"] == pytest.approx(sum((x - mx) ** 2 for x, _ in fine), abs=1e-9)
                assert r[f"{name}_ee"] == pytest.approx(sum((e - me) ** 2 for _, e in fine), abs=1e-9)
                assert r[f"{name}_xe"] == pytest.approx(sum((x - mx) * (e - me) for x, e in fine), abs=1e-9)


def test_groups_of_panes_stay_small_under_recurring_bursts(spark, monkeypatch):
    from chromafield.operators import ordered

    monkeypatch.setattr(ordered, "MOMENT_ROWS", 100)
    # bursts at the same place of every pane
    df = spark.range(8000).select((F.col("id") % 40 * 1000 + F.floor(F.col("id") / 40) % 20).alias("t"))
    frames = {"past": (-1000, -1)}
    group, cut = ordered._layout(1000, ordered.pane_width(df, [], "t", frames))
    place = [slice_of(F.col("t"), 1000 * group), ordered._strip(F.col("t"), 1000, cut)]
    assert df.groupBy(*place).count().agg(F.max("count")).first()[0] <= 400


@pytest.mark.parametrize("width, most", [(10_000, 4), (300, 9)])
def test_step_changes_shuffle_rows_once_per_step(spark, width, most):
    """Two frames with correlations: one exchange of rows, not one per frame and pane."""
    from chromafield.operators.aggregates import step_changes

    df = spark.range(200).selectExpr("id", "id * 10 AS timestamp_us", "id % 7 * 1.0 AS v")
    env = df.selectExpr("timestamp_us", "v AS temp").where("timestamp_us % 20 = 0")
    out = step_changes(df, "v", 200, 0.5, env=env, env_col="temp", width=width)
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= most
