"""Neighbour search and density sums on a cell grid.

Points sharing one position are collapsed before anything is paired, so a pile of
copies costs one row.  Pairs are formed only between neighbouring cells, are reduced
(top-k or sums) straight after the join, and a hot cell is split by AQE's skew join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.session import store_table

POS = ("x", "y", "z")
_CELL = ("_cx", "_cy", "_cz")


def _cells(size: float, pos: Sequence[str] = POS) -> dict[str, Column]:
    return {c: F.floor(F.col(p) / F.lit(size)).cast("long") for c, p in zip(_CELL, pos)}


def _around(size: float, pos: Sequence[str] = POS) -> Column:
    """The 27 cells that can hold a point within ``size`` of the row."""
    cx, cy, cz = _cells(size, pos).values()
    return F.explode(
        F.array(
            *[
                F.struct((cx + i).alias("_cx"), (cy + j).alias("_cy"), (cz + k).alias("_cz"))
                for i in (-1, 0, 1)
                for j in (-1, 0, 1)
                for k in (-1, 0, 1)
            ]
        )
    )


def _dist2(a: Sequence[str], b: Sequence[str]) -> Column:
    return sum(((F.col(p) - F.col(q)) ** 2 for p, q in zip(a, b)), start=F.lit(0.0))


def with_position(df: DataFrame, array_col: str, names: Sequence[str] = POS) -> DataFrame:
    """First three entries of an array column as x, y, z."""
    return df.withColumns({n: F.col(array_col)[i].cast("double") for i, n in enumerate(names)})


def candidate_pairs(
    a: DataFrame, b: DataFrame, r: float, a_cols: Sequence[str], b_cols: Sequence[str], by=()
) -> DataFrame:
    """Rows of both sides within ``r``: columns ``a_*``, ``b_*`` and ``d2``.

    ``a`` is the side copied into 27 cells, so pass the smaller one first.
    """
    left = a.select(
        *[F.col(k) for k in by],
        *[F.col(c).alias(f"a_{c}") for c in a_cols],
        _around(r).alias("_c"),
    ).select("*", "_c.*").drop("_c")
    right = b.select(
        *[F.col(k) for k in by],
        *[F.col(c).alias(f"b_{c}") for c in b_cols],
        *[c.alias(n) for n, c in _cells(r).items()],
    )
    pairs = left.join(right, [*by, *_CELL])
    d2 = _dist2([f"a_{p}" for p in POS], [f"b_{p}" for p in POS])
    return pairs.withColumn("d2", d2).where(F.col("d2") <= r * r).drop(*_CELL)


def radius_join(
    a: DataFrame, b: DataFrame, r: float, a_id: str = "id", b_id: str = "id", by=()
) -> DataFrame:
    """(a_id, b_id, distance) for every pair within ``r``."""
    pairs = candidate_pairs(a, b, r, [a_id, *POS], [b_id, *POS], by)
    return pairs.select(
        *by,
        F.col(f"a_{a_id}").alias("a_id"),
        F.col(f"b_{b_id}").alias("b_id"),
        F.sqrt("d2").alias("distance"),
    )


def near_edges(points: DataFrame, r: float, id_col: str = "id") -> DataFrame:
    """``SPATIAL_NEAR`` edges within ``r``: (src, dst, distance) with src < dst.

    Copies at one position hang on their lowest id as a star (distance 0), and only that
    id takes part in the pairs; the graph stays connected without all-pairs in a pile.
    """
    heads = points.groupBy(*POS).agg(F.min(id_col).alias("id"))
    pairs = (
        candidate_pairs(heads, heads, r, ["id", *POS], ["id", *POS])
        .where("a_id < b_id")
        .select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.sqrt("d2").alias("distance"))
    )
    copies = (
        points.join(heads.withColumnRenamed("id", "src"), list(POS))
        .where(F.col(id_col) > F.col("src"))
        .select("src", F.col(id_col).alias("dst"), F.lit(0.0).alias("distance"))
    )
    return pairs.unionByName(copies)


#: levels of the pyramid below its root: a cell of level l is the extent / 2^l wide
LEVELS = 19
_GRID = ("_ix", "_iy", "_iz")


# Expressions of the pyramid are SQL text: a few hundred terms are cheaper to parse than to
# build one by one.


def _key(level: str | int, at: Sequence[str]) -> str:
    """A cell of a level as one number; ``at`` are its coordinates there."""
    x, y, z = at
    return (
        f"(shiftleft(cast({level} as bigint), {3 * LEVELS}) | shiftleft(cast({x} as bigint), {2 * LEVELS})"
        f" | shiftleft(cast({y} as bigint), {LEVELS}) | cast({z} as bigint))"
    )


def _up(column: str, level: str | int) -> str:
    """A coordinate of the finest level on another level."""
    return f"shiftright({column}, {LEVELS} - {level})"


def _on_levels(spots: DataFrame, levels: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """``columns`` and the cell ``_key`` of every spot on each of the levels."""
    keys = ", ".join(_key(level, [_up(i, level) for i in _GRID]) for level in levels)
    return spots.select(*columns, F.expr(f"explode(array({keys}))").alias("_key"))


class Pyramid:
    """Distinct positions on a pyramid of cells, with the number of points in each cell."""

    def __init__(self, spots: DataFrame, by: Sequence[str]):
        """``spots``: ``by``, position and ``ids`` (as many as a search can need)."""
        self.by = list(by)
        box = spots.agg(*[F.min(p) for p in POS], *[F.max(p) for p in POS]).first()
        low, high = box[:3], box[3:]
        self.low = low if low[0] is not None else (0.0, 0.0, 0.0)
        width = max((h - o for o, h in zip(low, high)), default=0.0) if low[0] is not None else 0.0
        # a little more than the points need, so that the last one is inside
        self.extent = max(width, 1e-300) * (1 + 1e-9)
        fine = [
            F.expr(f"least(cast(floor((`{p}` - ({o!r}D)) / {self.extent!r}D * {2**LEVELS}) as bigint), {2**LEVELS - 1}L)")
            for p, o in zip(POS, self.low)
        ]
        self.spots = spots.withColumns(dict(zip(_GRID, fine))).withColumn("_n", F.size("ids").cast("long"))

    def counts(self, levels: Sequence[int]) -> DataFrame:
        cells = _on_levels(self.spots, levels, [*self.by, "_n"])
        return cells.groupBy(*self.by, "_key").agg(F.sum("_n").alias("_n"))

    def useful_levels(self, least: int) -> tuple[int, int]:
        """The finest level on which every cell holds ``least`` points, and on which any does."""
        level = F.call_function("shiftright", F.col("_key"), F.lit(3 * LEVELS)).alias("_l")
        rows = (
            self.counts(range(LEVELS + 1))
            .groupBy(level)
            .agg(F.min("_n").alias("low"), F.max("_n").alias("high"))
            .collect()
        )
        all_, some = [r["_l"] for r in rows if r["low"] >= least], [r["_l"] for r in rows if r["high"] >= least]
        return max(all_, default=0), max(some, default=0)

    def box(self) -> dict[str, Column]:
        """Squared least and greatest distance from a row's position to its cell (_l, _x, _y, _z)."""
        near, far = [], []
        for name, low, cell in zip(POS, self.low, ("_x", "_y", "_z")):
            size = f"({self.extent!r}D / pow(2D, _l))"
            left = f"(`{name}` - ({low!r}D) - cast({cell} as double) * {size})"
            near.append(f"pow(greatest(-{left}, {left} - {size}, 0D), 2D)")
            far.append(f"pow(greatest(abs({left}), abs({size} - {left})), 2D)")
        return {"_near": F.expr(" + ".join(near)), "_far": F.expr(" + ".join(far))}


def _cells_of(parts: Iterable[tuple[str, str, str, str]]) -> Column:
    """Cells (_l, _x, _y, _z), one row each."""
    listed = ", ".join(f"struct({l} as _l, {x} as _x, {y} as _y, {z} as _z)" for l, x, y, z in parts)
    return F.expr(f"inline(array({listed}))")


def _around_radius() -> Column:
    """The 27 cells of level ``_l`` around a position."""
    x, y, z = (_up(i, "_l") for i in _GRID)
    near = (-1, 0, 1)
    return _cells_of(
        ("_l", f"{x} + {i}", f"{y} + {j}", f"{z} + {m}") for i in near for j in near for m in near
    )


def _children() -> Column:
    """The eight cells below (_l, _x, _y, _z)."""
    return _cells_of(
        ("_l + 1", f"2 * _x + {i}", f"2 * _y + {j}", f"2 * _z + {m}")
        for i in (0, 1) for j in (0, 1) for m in (0, 1)
    )


def _reach(distance2: str, extent: float) -> str:
    """A squared distance with room for the rounding of cell borders."""
    return f"({distance2} * {1 + 1e-9!r}D + {(1e-12 * extent) ** 2!r}D)"


def knn(
    points: DataFrame,
    k: int = 20,
    id_col: str = "id",
    by: Sequence[str] = (),
    heavy: int | None = None,
) -> DataFrame:
    """Exact k nearest neighbours: (id, neighbour, rank, distance); ties go to the lower id.

    1. A pyramid counts the points of every cell on all levels.  A position starts at the finest
       level where its own cell holds k + 1 points; the k + 1 nearest of that cell alone bound its
       search radius.
    2. It asks for the cells around it on the level whose cells are just as wide as that radius.
       A cell of more than ``heavy`` points (a dense place, seen from afar) is not read but
       replaced by those of its eight children that are near enough, while the counts of all its
       cells lower the radius; so an outlier descends into a cluster instead of reading it.
    3. One join gives every position the points of its cells, and k + 1 of them are kept before
       the exchange.

    Cells of a part of ``by`` with k points or fewer are read whole.  Rows without a finite position
    have no neighbours.
    """
    by = list(by)
    place, least = [*by, *POS], k + 1
    heavy = 32 * least if heavy is None else heavy
    finite = [F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")) for p in POS]
    points = points.where(reduce(Column.__and__, finite))
    first_ids = Window.partitionBy(*place).orderBy(id_col)
    spots = store_table(
        points.select(*place, id_col)
        .withColumn("_r", F.row_number().over(first_ids))
        .where(F.col("_r") <= least)
        .groupBy(*place)
        .agg(F.sort_array(F.collect_list(id_col)).alias("ids")),
        "knn-spots",
    )
    pyramid = Pyramid(spots, by)
    coarse, fine = pyramid.useful_levels(least)

    # where each position starts, and its radius there
    full = pyramid.counts(range(coarse, fine + 1)).where(F.col("_n") >= least).select(*by, "_key")
    start = (
        _on_levels(pyramid.spots, range(coarse, fine + 1), [*place, *_GRID])
        .join(full, [*by, "_key"])
        .groupBy(*place, *_GRID)
        .agg(F.max("_key").alias("_key"))
    )
    # in a part with too few points there is no full cell: its root holds them all
    start = (
        pyramid.spots.select(*place, *_GRID)
        .join(start.select(*place, "_key"), place, "left")
        .withColumn("_key", F.expr(f"coalesce(_key, {_key(0, '000')})"))
    )
    levels = sorted({0, *range(coarse, fine + 1)})
    others = pyramid.spots.withColumnsRenamed({p: f"b_{p}" for p in POS})
    own = _on_levels(others, levels, [*by, "_n", *[f"b_{p}" for p in POS]])
    apart = F.expr(" + ".join(f"pow(`{p}` - `b_{p}`, 2D)" for p in POS))
    nth = F.expr(
        f"""aggregate(sort_array(collect_list(struct(d2, _n))), struct(0L as c, 0D as r),
            (a, x) -> case when a.c >= {least} then a else struct(a.c + x._n as c, x.d2 as r) end,
            a -> a.r)"""
    )
    bounded = (
        start.join(own, [*by, "_key"]).withColumn("d2", apart).groupBy(*place, *_GRID).agg(nth.alias("_r2"))
    )

    # cells around a position that are as wide as its radius
    wide = f"greatest(sqrt({_reach('_r2', pyramid.extent)}), 1e-300D)"
    level = F.expr(f"cast(greatest(least(floor(log2({pyramid.extent!r}D / {wide})), {fine}), 0) as int)")
    placed = bounded.withColumn("_l", level).select(*place, "_r2", "_l", *_GRID)
    asked = placed.select(*place, "_r2", _around_radius()).where(
        " and ".join(f"{n} >= 0 and {n} < pow(2D, _l)" for n in ("_x", "_y", "_z"))
    )
    counts = pyramid.counts(range(fine + 1))
    near_enough = f"_near <= {_reach('_r2', pyramid.extent)}"
    key = F.expr(_key("_l", ("_x", "_y", "_z")))
    columns = [*place, "_r2", "_l", "_x", "_y", "_z", "_key", "_n"]

    def counted(cells: DataFrame) -> DataFrame:
        """Cells near enough that hold points, with their number."""
        close = cells.withColumns(pyramid.box()).where(near_enough).withColumn("_key", key)
        return close.join(counts, [*by, "_key"]).select(columns)

    asked = store_table(counted(asked), "knn-cells")
    too_many = f"(_n > {heavy} and _l < {fine})"
    while True:
        seen = asked.agg(F.collect_set("_l"), F.expr(f"max({too_many})")).first()
        if not seen[1]:
            break
        opened = asked.where(too_many).select(*place, "_r2", _children())
        cells = asked.where(f"not {too_many}").unionByName(counted(opened)).withColumns(pyramid.box())
        # points that cells hold for certain within a distance lower the radius
        window = Window.partitionBy(*place)
        upto = F.sum("_n").over(window.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0))
        sure = F.min(F.when(F.col("_upto") >= least, F.col("_far"))).over(window)
        cells = cells.withColumn("_upto", upto).withColumn("_sure", sure)
        cells = cells.withColumn(
            "_r2", F.expr(f"least(_r2, coalesce({_reach('_sure', pyramid.extent)}, _r2))")
        )
        asked = store_table(cells.where(near_enough).select(columns), "knn-cells")
    held = _on_levels(others, sorted(seen[0]) or [0], [*by, "ids", *[f"b_{p}" for p in POS]])
    order = Window.partitionBy(*place).orderBy("d2", "nid")
    near = (
        asked.select(*place, "_key", "_r2")
        .join(held, [*by, "_key"])
        .withColumn("d2", apart)
        .where(f"d2 <= {_reach('_r2', pyramid.extent)}")
        .select(*place, "d2", F.explode("ids").alias("nid"))
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= least)
        .groupBy(*place)
        .agg(F.sort_array(F.collect_list(F.struct("d2", "nid"))).alias("near"))
    )
    mine = (
        points.select(*place, id_col)
        .join(near, place)
        .withColumn("near", F.slice(F.filter("near", lambda n: n["nid"] != F.col(id_col)), 1, k))
    )
    return mine.select(*by, F.col(id_col).alias("id"), F.posexplode("near").alias("_p", "_n")).select(
        *by,
        "id",
        F.col("_n.nid").alias("neighbour"),
        (F.col("_p") + 1).alias("rank"),
        F.sqrt("_n.d2").alias("distance"),
    )


def _masses(points: DataFrame, mass: str | None) -> DataFrame:
    m = F.lit(1.0) if mass is None else F.col(mass)
    return points.groupBy(*POS).agg(F.sum(m).alias("m"))


#: cells of up to this many positions are paired row by row, fuller ones in tiles of ``TILE_ROWS``
LIGHT_CELL = 32
TILE_ROWS = 2048
_STRIP = 32  # rows of a tile that are looked at together


def _kernel_sums(
    spots: DataFrame,
    h: float,
    sums: dict[str, Column],
    block: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]],
) -> DataFrame:
    """Position and ``sums`` over all spots within ``h``, itself included.

    ``sums`` are the summands as expressions of a row of ``candidate_pairs``; ``block`` gives the same
    sums for each row of a matrix of pairs: squared distances, which of them are near, differences by
    axis, and the masses of its columns.  A pair of cells of many spots costs a matrix per pair of
    tiles instead of a row per pair of spots, so memory is bounded by a tile however dense a cell is.
    """
    placed = store_table(spots.withColumns(_cells(h)), "kernel-spots")
    cells = placed.groupBy(*_CELL).agg(F.count("*").alias("_rows"))
    cells = store_table(
        cells.withColumn("_tiles", F.ceil(F.col("_rows") / F.lit(float(TILE_ROWS))).cast("int")), "kernel-cells"
    )
    heavy = cells.where(F.col("_rows") > LIGHT_CELL)
    light = placed.join(heavy, list(_CELL), "left_anti")
    apart = (
        candidate_pairs(light, spots, h, list(POS), [*POS, "m"])
        .groupBy(*[F.col(f"a_{p}").alias(p) for p in POS])
        .agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    )

    # tiles of a heavy cell and those of the cells around it
    other = [f"_o{c}" for c in _CELL]
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    around = heavy.select(*_CELL, "_tiles")
    for c, o in zip(_CELL, other):
        around = around.withColumn("_step", step).withColumn(o, F.col(c) + F.col("_step")).drop("_step")
    there = cells.select(*[F.col(c).alias(o) for c, o in zip(_CELL, other)], "_rows", F.col("_tiles").alias("_others"))
    pairs = (
        around.join(there, other)
        .withColumn("_t", F.explode(F.expr("sequence(0, _tiles - 1)")))
        .withColumn("_u", F.explode(F.expr("sequence(0, _others - 1)")))
    )
    # small tiles around one are looked at together, up to about ``TILE_ROWS`` rows
    met = F.sum(F.col("_rows") / F.col("_others")).over(
        Window.partitionBy(*_CELL, "_t").orderBy(*other, "_u").rowsBetween(Window.unboundedPreceding, 0)
    )
    group, tile_of = [*_CELL, "_t", "_chunk"], [*other, "_u"]
    pairs = pairs.withColumn("_chunk", F.floor(met / F.lit(float(TILE_ROWS))).cast("int")).select(*group, *tile_of)
    dealt = placed.join(cells, list(_CELL)).select(
        *_CELL, F.expr(f"cast(pmod(xxhash64({', '.join(POS)}), _tiles) as int)").alias("_t"), *POS, "m"
    )
    own = pairs.select(*group).distinct().join(dealt, [*_CELL, "_t"]).select(*group, F.lit(0).alias("_side"), *POS, "m")
    theirs = dealt.withColumnsRenamed(dict(zip([*_CELL, "_t"], tile_of)))
    both = own.unionByName(pairs.join(theirs, tile_of).select(*group, F.lit(1).alias("_side"), *POS, "m"))
    names = list(sums)

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["_side"] == side] for side in (0, 1))
        a, b = left[list(POS)].to_numpy(float), right[list(POS)].to_numpy(float)
        m, found = right["m"].to_numpy(float), []
        if len(b):
            for start in range(0, len(a), _STRIP):
                d = [b[:, i] - a[start : start + _STRIP, i, None] for i in range(3)]
                d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                found.append(np.stack(block(d2, d2 <= h * h, d, m), axis=1))
        out = left[list(POS)].iloc[: len(a) if found else 0]
        return out.assign(**dict(zip(names, np.concatenate(found).T))) if found else out.reindex(columns=[*POS, *names])

    schema = ", ".join(f"{n} double" for n in [*POS, *names])
    tiled = both.groupBy(*group).applyInPandas(tile, schema)
    tiled = tiled.groupBy(*POS).agg(*[F.sum(n).alias(n) for n in sums])
    return apart.unionByName(tiled)


def kernel_density(points: DataFrame, h: float, mass: str | None = None) -> DataFrame:
    """Poly6 density at every point, itself included.  One partial sum per position."""
    coef = 315.0 / (64.0 * math.pi * h**9)
    summand = F.col("b_m") * F.pow(F.lit(h * h) - F.col("d2"), F.lit(3.0))

    def block(d2, near, d, m):
        w = np.where(near, h * h - d2, 0.0)
        return [(w * w * w) @ m]

    dens = _kernel_sums(_masses(points, mass), h, {"density": summand}, block)
    return points.join(dens.withColumn("density", F.lit(coef) * F.col("density")), list(POS))


def density_gradient(points: DataFrame, h: float, mass: str | None = None) -> DataFrame:
    """Magnitude of the density gradient with the spiky kernel."""
    coef = 45.0 / (math.pi * h**6)
    r = F.sqrt("d2")
    pull = F.lit(coef) * F.col("b_m") * F.pow(F.lit(h) - r, F.lit(2.0)) / r
    sums = {
        f"_g{p}": F.when(F.col("d2") > 0, pull * (F.col(f"b_{p}") - F.col(f"a_{p}"))).otherwise(0.0) for p in POS
    }

    def block(d2, near, d, m):
        near = near & (d2 > 0)
        r = np.sqrt(np.where(near, d2, 1.0))
        w = np.where(near, coef * m * (h - r) ** 2 / r, 0.0)
        return [(w * np.where(near, x, 0.0)).sum(axis=1) for x in d]

    grads = _kernel_sums(_masses(points, mass), h, sums, block)
    size = F.sqrt(sum((F.col(f"_g{p}") ** 2 for p in POS), start=F.lit(0.0)))
    return points.join(grads.select(*POS, size.alias("gradient")), list(POS), "left").withColumn(
        "gradient", F.coalesce("gradient", F.lit(0.0))
    )


def rf_without_geometry(
    rf: DataFrame, video: DataFrame, r: float, min_energy: float, energy: str = "energy"
) -> DataFrame:
    """Strong radio points with no optical geometry within ``r``.

    Two points in one cell of side r / sqrt(3) are always within r, so most points are
    settled by a semi-join on that cell; only the rest is paired.
    """
    strong = rf.where(F.col(energy) >= min_energy)
    spots = strong.select(*POS).distinct().withColumns(_cells(r / math.sqrt(3.0) * (1 - 1e-12)))
    geometry = video.select(*POS).distinct()
    taken = geometry.select(*[c.alias(n) for n, c in _cells(r / math.sqrt(3.0) * (1 - 1e-12)).items()]).distinct()
    open_spots = spots.join(taken, list(_CELL), "left_anti").select(*POS)
    near = (
        candidate_pairs(open_spots, geometry, r, list(POS), list(POS))
        .select(*[F.col(f"a_{p}").alias(p) for p in POS])
        .distinct()
    )
    lonely = open_spots.join(near, list(POS), "left_anti")
    return strong.join(lonely, list(POS), "left_semi")
