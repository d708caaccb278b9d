"""Window transforms: numpy inside Arrow batches, windows grouped by Spark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafield.operators.ranking import count_windows
from chromafield.session import store_table

# Daubechies low-pass taps.  Keys count the taps.
DAUBECHIES = {
    4: (
        0.48296291314469025,
        0.836516303737469,
        0.22414386804185735,
        -0.12940952255092145,
    ),
    8: (
        0.23037781330885523,
        0.7148465705525415,
        0.6308807679295904,
        -0.02798376941698385,
        -0.18703481171888114,
        0.030841381835986965,
        0.032883011666982945,
        -0.010597401784997278,
    ),
}


def sample_windows(
    df: DataFrame,
    n: int,
    keys: Sequence[str],
    values: Sequence[str],
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """One row per (key, window) with each value as an array in time order (n at most)."""
    numbered = count_windows(df, n, keys, ts, tie, width)
    packed = numbered.groupBy(*keys, "window").agg(
        F.min(ts).alias("start_us"),
        F.sort_array(F.collect_list(F.struct("offset", *values))).alias("_rows"),
    )
    return packed.select(
        *keys,
        "window",
        "start_us",
        *[F.col("_rows")[v].cast("array<double>").alias(v) for v in values],
    )


def _matrix(series: pd.Series, n: int) -> np.ndarray:
    """Stack ragged rows, zero-padded to n samples."""
    out = np.zeros((len(series), n))
    for row, values in enumerate(series):
        out[row, : len(values)] = values
    return out


def spectrum(
    df: DataFrame,
    n: int,
    rate: float,
    keys: Sequence[str] = ("sensor_id",),
    re: str = "re",
    im: str = "im",
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Discrete Fourier transform per count window: one row per bin.

    The last, short window of a key is zero-padded, so no sample is lost.
    """

    @F.pandas_udf("struct<re: array<double>, im: array<double>>")
    def transform(re_s: pd.Series, im_s: pd.Series) -> pd.DataFrame:
        out = np.fft.fft(_matrix(re_s, n) + 1j * _matrix(im_s, n), axis=1)
        return pd.DataFrame({"re": list(out.real), "im": list(out.imag)})

    packed = sample_windows(df, n, keys, [re, im], ts, tie, width)
    bins = packed.withColumn("_f", transform(F.col(re), F.col(im))).select(
        *keys, "window", F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias("bin", "_z")
    )
    signed = F.when(F.col("bin") < (n + 1) // 2, F.col("bin")).otherwise(F.col("bin") - n)
    return bins.select(
        *keys,
        "window",
        "bin",
        (signed * F.lit(rate / n)).alias("frequency_hz"),
        F.col("_z.re").alias("re"),
        F.col("_z.im").alias("im"),
        (F.col("_z.re") ** 2 + F.col("_z.im") ** 2).alias("power"),
    )


def dwt_energies(x: np.ndarray, taps: int, levels: int) -> np.ndarray:
    """Detail energy per level and the final approximation energy, for rows of x.

    Periodic extension keeps the transform orthogonal: the energies add up to the input's.
    """
    low = np.array(DAUBECHIES[taps])
    high = low[::-1] * np.where(np.arange(taps) % 2, -1.0, 1.0)
    energies = []
    for _ in range(levels):
        half = x.shape[1] // 2
        at = (2 * np.arange(half)[:, None] + np.arange(taps)) % x.shape[1]
        windows = x[:, at]
        energies.append((windows @ high) ** 2)
        x = windows @ low
    return np.stack([e.sum(axis=1) for e in energies] + [(x**2).sum(axis=1)], axis=1)


def wavelet_energy(
    df: DataFrame,
    taps: int = 8,
    levels: int = 6,
    n: int = 4096,
    keys: Sequence[str] = ("sensor_id",),
    value: str = "energy",
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Daubechies energy per level and window; level ``levels + 1`` is the approximation."""
    if n % 2**levels:
        raise ValueError("the window must divide by 2 ** levels")

    @F.pandas_udf("array<double>")
    def energies(values: pd.Series) -> pd.Series:
        return pd.Series(list(dwt_energies(_matrix(values, n), taps, levels)))

    packed = sample_windows(df, n, keys, [value], ts, tie, width)
    return packed.select(*keys, "window", F.posexplode(energies(F.col(value))).alias("_l", "energy")).select(
        *keys, "window", (F.col("_l") + 1).alias("level"), "energy"
    )


#: templates of one pass over the windows, in values
BLOCK_VALUES = 2_000_000
PAIR_VALUES = 2_000_000


def _path_band(n: int, m: int, band: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last partner of each of n samples among m: ``band`` around the diagonal.

    The band is at least as wide as the diagonal is steep, so that there always is a path.
    """
    if band is None or n < 2:
        return np.zeros(n, int), np.full(n, m - 1)
    centre = (2 * np.arange(n) * (m - 1) + n - 1) // (2 * (n - 1))
    reach = max(band, -(-(m - 1) // (n - 1)))
    return np.maximum(centre - reach, 0), np.minimum(centre + reach, m - 1)


def warp_pairs(
    a: np.ndarray, b: np.ndarray, band: int | None = None, limit: np.ndarray | None = None
) -> np.ndarray:
    """Warping distance of each row of a (k, n) to the same row of b (k, m).

    A pair is given up (infinity) as soon as every way to go on costs more than its ``limit``.
    """
    (k, n), m = a.shape, b.shape[1]
    out = np.full(k, np.inf)
    if n == 0 or m == 0:
        return np.zeros(k) if n == m else out
    low, high = _path_band(n, m, band)
    x, y, at = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.arange(k)
    cost = np.full((m + 1, k), np.inf)
    cost[0] = 0.0
    for i in range(n):
        row = np.full(cost.shape, np.inf)
        for j in range(low[i], high[i] + 1):
            best = np.minimum(np.minimum(cost[j], cost[j + 1]), row[j])
            row[j + 1] = np.abs(x[i] - y[j]) + best
        cost = row
        if limit is not None:
            alive = cost[low[i] + 1 : high[i] + 2].min(axis=0) <= limit[at]
            if alive.mean() < 0.8:
                x, y, at, cost = x[:, alive], y[:, alive], at[alive], cost[:, alive]
                if not len(at):
                    return out
    out[at] = cost[m]
    return out


def envelope(rows: np.ndarray, n: int, band: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest partner that each of n samples can have in rows (q, m): two (q, n)."""
    low, high = _path_band(n, rows.shape[1], band)
    least = np.stack([rows[:, i : j + 1].min(axis=1) for i, j in zip(low, high)], axis=1)
    most = np.stack([rows[:, i : j + 1].max(axis=1) for i, j in zip(low, high)], axis=1)
    return least, most


def warp_bounds(a: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lower bounds (p, q) of the distance of rows a (p, n) to rows with envelopes (q, n):
    every sample costs at least its distance to what it can be matched with."""
    out = np.zeros((len(a), len(least)))
    for i in range(a.shape[1]):
        x = a[:, i, None]
        out += np.maximum(np.maximum(least[None, :, i] - x, x - most[None, :, i]), 0.0)
    # sums in another order than the distance's
    return out * (1 - 1e-12)


def dtw(a: Column, b: Column, band: int | None = None) -> Column:
    """Warping distance of two array columns, absolute difference as the local cost."""

    @F.pandas_udf("double")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), np.nan)
        given = np.flatnonzero(left.notna().to_numpy() & right.notna().to_numpy())
        sizes: dict[tuple[int, int], list[int]] = {}
        for i in given:
            sizes.setdefault((len(left.iloc[i]), len(right.iloc[i])), []).append(i)
        for (n, m), rows in sizes.items():
            step = max(1, PAIR_VALUES // max(1, n + m))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                x = np.array([left.iloc[i] for i in part], float).reshape(len(part), n)
                y = np.array([right.iloc[i] for i in part], float).reshape(len(part), m)
                out[part] = warp_pairs(x, y, band)
        return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("Float64")

    return distance(a, b)


class _Library:
    """A block of templates, by length, in the order of their ids."""

    def __init__(self, rows: list):
        rows = sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0])
        by_size: dict[int, list] = {}
        for name, values in rows:
            by_size.setdefault(len(values), []).append((name, values))
        self.parts = [
            (np.array([r[0] for r in part]), np.array([r[1] for r in part], float).reshape(len(part), size))
            for size, part in sorted(by_size.items())
        ]


def _libraries(templates: DataFrame, template_id: str, vec: str) -> Iterator[_Library]:
    """The templates in blocks of about ``BLOCK_VALUES`` values, one after the other."""
    rows = templates.select(template_id, F.col(vec).cast("array<double>").alias(vec))
    total = rows.agg(F.sum(F.size(vec).cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_VALUES))
    for number in range(blocks):
        part = rows.where(F.pmod(F.xxhash64(template_id), F.lit(blocks)) == number)
        yield _Library([tuple(r) for r in part.collect()])


def _stacked(pdf: pd.DataFrame, vec: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, values) of the rows of each length."""
    given = pdf[vec].notna().to_numpy()
    sizes = np.where(given, pdf[vec].map(lambda v: -1 if v is None else len(v)).to_numpy(), -1)
    for size in np.unique(sizes[given]):
        at = np.flatnonzero(sizes == size)
        yield at, np.array([pdf[vec].iloc[i] for i in at], float).reshape(len(at), size)


def template_scores(
    windows: DataFrame,
    templates: DataFrame,
    id_col: str = "vec_id",
    template_id: str = "template_id",
    vec: str = "embedding",
    band: int | None = None,
) -> DataFrame:
    """Warping distance of every window to every template; vectors that are null have none.

    The templates come in blocks of bounded size, one pass over the windows for each; windows
    stay where they are.  ``template_matches`` finds the nearest few without scoring all.
    """
    w_type = windows.schema[id_col].dataType.simpleString()
    t_type = templates.schema[template_id].dataType.simpleString()
    rows = windows.select(id_col, F.col(vec).cast("array<double>").alias(vec))
    out = None
    for library in _libraries(templates, template_id, vec):
        shared = windows.sparkSession.sparkContext.broadcast(library)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at, x in _stacked(pdf, vec):
                    for names, block in shared.value.parts:
                        step = max(1, PAIR_VALUES // (len(names) * max(1, x.shape[1] + block.shape[1])))
                        for k in range(0, len(at), step):
                            some = x[k : k + step]
                            pairs = np.repeat(some, len(names), axis=0), np.tile(block, (len(some), 1))
                            yield pd.DataFrame(
                                {
                                    id_col: np.repeat(pdf[id_col].to_numpy()[at[k : k + step]], len(names)),
                                    template_id: np.tile(names, len(some)),
                                    "dtw": warp_pairs(*pairs, band),
                                }
                            )

        part = rows.mapInPandas(run, f"{id_col} {w_type}, {template_id} {t_type}, dtw double")
        out = part if out is None else out.unionByName(part)
    return out


def nearest_templates(
    x: np.ndarray, library: _Library, size: int, band: int | None, known: list[list[tuple]]
) -> tuple[list[list[tuple]], np.ndarray]:
    """Per row of x its ``size`` best of ``known`` and the library as (distance, id), and the number
    of distances that were begun for it."""
    best, scored = [sorted(k)[:size] for k in known], np.zeros(len(x), np.int64)
    for names, block in library.parts:
        if x.shape[1] and block.shape[1]:
            bound = warp_bounds(x, *envelope(block, x.shape[1], band))
        else:
            bound = np.zeros((len(x), len(block)))
        order = np.argsort(bound, axis=1, kind="stable")
        active, at, step = np.arange(len(x)), 0, size
        while at < len(names):
            limit = np.array([best[i][-1][0] if len(best[i]) == size else np.inf for i in active])
            going = bound[active, order[active, at]] <= limit
            active, limit = active[going], limit[going]
            if not len(active):
                break
            tried = order[active, at : at + step]
            who, which = np.repeat(np.arange(len(active)), tried.shape[1]), tried.ravel()
            near = bound[active[who], which] <= limit[who]
            who, which = who[near], which[near]
            found = warp_pairs(x[active[who]], block[which], band, limit[who])
            scored += np.bincount(active[who], minlength=len(x))
            there = np.isfinite(found)
            for i, name, d in zip(active[who[there]].tolist(), names[which[there]].tolist(), found[there].tolist()):
                best[i] = sorted([*best[i], (d, name)])[:size]
            at, step = at + step, min(2 * step, 64)
    return best, scored


def template_matches(
    windows: DataFrame,
    templates: DataFrame,
    size: int = 3,
    band: int | None = None,
    id_col: str = "vec_id",
    template_id: str = "template_id",
    vec: str = "embedding",
) -> DataFrame:
    """``id_col, rank, template_id, dtw, scored``: the ``size`` nearest templates of each window by
    warping within ``band`` samples of the diagonal (None: any), ties by the smaller id.

    A template's envelope gives a lower bound of its distance.  A window tries templates by
    rising bound, gives a distance up once it exceeds the worst of its best, and stops where the
    next bound does; ``scored`` counts the distances that were begun.  Templates come in blocks
    of bounded size; each further pass starts from the best so far, so it prunes harder.
    """
    w_type = windows.schema[id_col].dataType.simpleString()
    t_type = templates.schema[template_id].dataType.simpleString()
    best_type = f"array<struct<d: double, t: {t_type}>>"
    rows = windows.select(
        F.col(id_col).alias("_id"),
        F.col(vec).cast("array<double>").alias("_vec"),
        F.array().cast(best_type).alias("_best"),
        F.lit(0).cast("long").alias("_scored"),
    )
    passes = 0
    for library in _libraries(templates, template_id, vec):
        shared = windows.sparkSession.sparkContext.broadcast(library)
        if passes:
            rows = store_table(rows, "template-best")
        passes += 1

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                best = [[(b["d"], b["t"]) for b in known] for known in pdf["_best"]]
                scored = pdf["_scored"].to_numpy().copy()
                for at, x in _stacked(pdf, "_vec"):
                    found, counts = nearest_templates(x, shared.value, size, band, [best[i] for i in at])
                    for i, own, n in zip(at, found, counts):
                        best[i] = own
                        scored[i] += n
                lists = [[{"d": d, "t": t} for d, t in b] for b in best]
                yield pdf.assign(_best=lists, _scored=scored)

        rows = rows.mapInPandas(run, f"_id {w_type}, _vec array<double>, _best {best_type}, _scored long")
    return rows.select(
        F.col("_id").alias(id_col), F.posexplode("_best").alias("_rank", "_hit"), F.col("_scored").alias("scored")
    ).select(
        id_col,
        (F.col("_rank") + 1).alias("rank"),
        F.col("_hit.t").alias(template_id),
        F.col("_hit.d").alias("dtw"),
        "scored",
    )
