"""Ordered per-key computation that never puts a whole key into one task.

A plain ``Window.partitionBy(sensor).orderBy(ts)`` sorts one sensor in one task.
Here a key's rows are cut into *slices* of the order column; the window runs per
(key, slice), and what a slice needs from its neighbours comes either from

* a **carry**: a one-row-per-slice summary scanned at slice level, or
* a **halo**: copies of the rows within reach of the slice border.

The slice width is an argument.  ``None`` measures the data: one or two
aggregations over the key and order columns find a width at which the fullest
slice holds about ``TARGET_ROWS`` rows.  The order column is an integer (usually
microseconds), so rows sharing one value of it for one key stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.session import broadcast_if_small

TARGET_ROWS = 1_000_000
# frame moments: rows of a group in one task, panes per group and strips per pane where panes are cut
MOMENT_ROWS = 200_000
PANES = 8
STRIPS = 100_000
# counts among the moments, and their means and sums of products of deviations
COUNTS = ("all", "n", "pairs", "pn")
CENTRAL = (
    ("n", ("mean",), {"ss": ("mean", "mean")}),
    ("pn", ("px", "pe"), {"xx": ("px", "px"), "ee": ("pe", "pe"), "xe": ("px", "pe")}),
)
SLICE = "_slice"
KEY = "_key"


def slice_of(order: Column, width: int) -> Column:
    """Exact floor division of an integer column."""
    wide = order.cast("long")
    return ((wide - F.pmod(wide, F.lit(width))) / F.lit(width)).cast("long")


def plan_width(
    df: DataFrame, keys: Sequence[str], order: str, target_rows: int = TARGET_ROWS
) -> int:
    """Slice width at which no (key, slice) holds much more than ``target_rows`` rows."""
    lean = df.select(*keys, F.col(order).cast("long").alias(order)).where(F.col(order).isNotNull())
    per_key = lean.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")
    )
    row = per_key.agg(
        F.max("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min((F.col("hi") - F.col("lo") + 1) * F.lit(float(target_rows)) / F.col("n")).alias("w"),
    ).first()
    if row["n"] is None:
        return 1
    whole = max(abs(row["lo"]), abs(row["hi"])) + 1
    if row["n"] <= target_rows:
        return whole
    width = max(1, int(row["w"]))
    for _ in range(6):  # bursts: shrink until the fullest slice fits
        peak = (
            lean.groupBy(*keys, slice_of(F.col(order), width).alias(SLICE))
            .count()
            .agg(F.max("count"))
            .first()[0]
        )
        if peak <= 4 * target_rows or width == 1:
            break
        width = max(1, int(width * target_rows / peak))
    return width


def with_slice(df: DataFrame, keys: Sequence[str], order: str, width: int | None) -> DataFrame:
    """Add the slice number and the key columns packed into one struct.

    The struct is never null itself, so a plain equi-join keeps rows with null keys, and
    the join with the carry and the window above it share one exchange.
    """
    if width is None:
        width = plan_width(df, keys, order)
    packed = F.struct(*keys) if keys else F.lit(0)
    return df.withColumns({SLICE: slice_of(F.col(order), width), KEY: packed})


def in_slice() -> Window:
    return Window.partitionBy(KEY, SLICE)


def across() -> Window:
    """Over a key's slices, at one row per slice."""
    return Window.partitionBy(KEY).orderBy(SLICE)


def before() -> Window:
    """All earlier slices of the key."""
    return across().rowsBetween(Window.unboundedPreceding, -1)


def whole_key() -> Window:
    return across().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _join_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    return rows.join(carry, [KEY, SLICE], "left")


def lag_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Sequence[str],
    tie: Sequence[str] = (),
    width: int | None = None,
    prefix: str = "prev_",
) -> DataFrame:
    """Previous row's values per key as ``prev_<col>``; null on a key's first row."""
    sliced = with_slice(df, keys, order, width)
    payload = F.struct(*[F.col(c).alias(c) for c in cols])
    carry = (
        sliced.groupBy(KEY, SLICE)
        .agg(F.max_by(payload, F.struct(order, *tie)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across()))
        .drop("_last")
    )
    w = in_slice().orderBy(order, *tie)
    out = _join_carry(sliced, carry)
    previous = F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag(payload).over(w))
    return (
        out.withColumn("_prev", previous)
        .withColumns({f"{prefix}{c}": F.col("_prev")[c] for c in cols})
        .drop("_prev", "_carry", SLICE, KEY)
    )


def last_rows(
    df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()
) -> DataFrame:
    """The last row per key by ``order``, then ``tie``; null orders come first.

    The greatest order per key is one fixed-width number, so it is found by hashing with map-side
    combine, without a sort.  The rows that have it are picked where they lie (the list of keys
    is broadcast if its checked size allows), and only these few are shuffled and ranked.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    tops = df.groupBy(*named).agg(F.max(order).alias("_top"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    picked = df.join(broadcast_if_small(tops), [*on, F.col(order).eqNullSafe(F.col("_top"))]).select(df.columns)
    ranked = Window.partitionBy(*keys).orderBy(*[F.desc(t) for t in tie] or [F.lit(0)])
    return picked.withColumn("_last", F.row_number().over(ranked)).where("_last = 1").drop("_last")


FOLDS = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "min": F.min,
    "any": F.bool_or,
}


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    tie: Sequence[str] = (),
    width: int | None = None,
    kind: str = "sum",
    exclusive: bool = False,
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Running aggregate per key: ``kind`` is sum, product, max, min, any or first.

    ``totals`` maps a name to (fold, expression): that aggregate over the whole key, which
    rides along with the carry and needs no join of its own.
    """
    totals = totals or {}
    sliced = with_slice(df, keys, order, width)
    # evaluate the expressions once, so both branches aggregate plain columns
    sliced = sliced.withColumns({f"_x_{name}": expr for name, expr in values.items()})

    def part(name: str) -> Column:
        if kind == "first":
            # wrapped, so that a null first value still differs from "no earlier slice"
            return F.min_by(F.struct(F.col(f"_x_{name}").alias("v")), F.struct(order, *tie))
        return FOLDS[kind](F.col(f"_x_{name}"))

    def earlier(name: str) -> Column:
        if kind == "first":
            return F.first(f"_t_{name}").over(before())
        return FOLDS[kind](F.col(f"_t_{name}")).over(before())

    carry = sliced.groupBy(KEY, SLICE).agg(
        *[part(n).alias(f"_t_{n}") for n in values],
        *[FOLDS[fold](expr).alias(f"_w_{n}") for n, (fold, expr) in totals.items()],
    )
    carry = carry.select(
        KEY,
        SLICE,
        *[earlier(n).alias(f"_b_{n}") for n in values],
        *[FOLDS[fold](F.col(f"_w_{n}")).over(whole_key()).alias(n) for n, (fold, _) in totals.items()],
    )
    end = -1 if exclusive else 0
    w = in_slice().orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, end)
    out = _join_carry(sliced, carry)

    def combined(name: str) -> Column:
        base = F.col(f"_b_{name}")
        if kind == "first":
            return F.when(base.isNotNull(), base["v"]).otherwise(F.first(F.col(f"_x_{name}")).over(w))
        local = FOLDS[kind](F.col(f"_x_{name}")).over(w)
        if kind == "sum":
            zero = F.lit(0)
            return F.coalesce(base, zero) + F.coalesce(local, zero)
        if kind == "product":
            return F.coalesce(base, F.lit(1.0)) * F.coalesce(local, F.lit(1.0))
        if kind == "any":
            return F.coalesce(base, F.lit(False)) | F.coalesce(local, F.lit(False))
        return F.greatest(base, local) if kind == "max" else F.least(base, local)

    out = out.withColumns({n: combined(n) for n in values})
    return out.drop(SLICE, KEY, *[f"_x_{n}" for n in values], *[f"_b_{n}" for n in values])


def running_moments(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Count, mean and population deviation of all earlier rows: ``past_n/_mean/_sd``.

    Slice moments are pooled around the key's first slice mean, so that no large squares
    cancel, and then merged with the moments inside the slice.
    """
    sliced = with_slice(df, keys, order, width)
    x = F.col(value)
    carry = sliced.groupBy(KEY, SLICE).agg(
        F.count(x).alias("_n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v")
    )
    carry = carry.withColumn("_m0", F.first("_m", ignorenulls=True).over(whole_key()))
    d = F.col("_m") - F.col("_m0")
    carry = carry.select(
        KEY,
        SLICE,
        "_m0",
        F.coalesce(F.sum("_n").over(before()), F.lit(0)).alias("_cn"),
        F.coalesce(F.sum(F.col("_n") * d).over(before()), F.lit(0.0)).alias("_c1"),
        F.coalesce(F.sum(F.col("_n") * (F.col("_v") + d * d)).over(before()), F.lit(0.0)).alias("_c2"),
    )
    w = in_slice().orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    out = _join_carry(sliced, carry).withColumns(
        {
            "_n": F.count(x).over(w),
            "_m": F.coalesce(F.avg(x).over(w), F.lit(0.0)),
            "_v": F.coalesce(F.var_pop(x).over(w), F.lit(0.0)),
        }
    )
    n1, n2 = F.col("_cn"), F.col("_n")
    m1 = F.coalesce(F.col("_m0") + F.try_divide("_c1", "_cn"), F.lit(0.0))
    ss1 = F.col("_c2") - F.coalesce(F.try_divide(F.col("_c1") ** 2, n1), F.lit(0.0))
    gap = F.when((n1 > 0) & (n2 > 0), F.col("_m") - m1).otherwise(0.0)
    total = n1 + n2
    ss = ss1 + n2 * F.col("_v") + gap * gap * F.coalesce(F.try_divide(n1 * n2, total), F.lit(0.0))
    return out.withColumns(
        {
            "past_n": total,
            "past_mean": F.try_divide(n1 * m1 + n2 * F.col("_m"), total),
            "past_sd": F.when(total > 0, F.sqrt(F.greatest(ss / total, F.lit(0.0)))),
        }
    ).drop(SLICE, KEY, "_m0", "_cn", "_c1", "_c2", "_n", "_m", "_v")


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: Sequence[str] = (),
    width: int | None = None,
    name: str = "row_index",
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """1-based position of each row within its key."""
    return prefix_scan(df, keys, order, {name: F.lit(1).cast("long")}, tie, width, totals=totals)


def rolling_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    frames: dict[str, tuple[int, int]],
    values: dict[str, Column],
    width: int | None = None,
) -> DataFrame:
    """Sums over sliding range frames, at constant cost per row whatever the frame holds.

    ``frames`` maps a prefix to (lo, hi), offsets on the order column; the result has one
    column ``<prefix>_<value>`` per pair.  A row enters the frames of the rows from
    order - hi on and leaves them after order - lo, so two marks per row and frame turn the
    sliding sum into a running one, which is sliced like any other scan.  Values must be
    finite (a NaN would never leave the running sum again); null counts as zero.
    """
    names = [f"{prefix}_{name}" for prefix in frames for name in values]
    clean = {f"_v_{name}": F.coalesce(expr.cast("double"), F.lit(0.0)) for name, expr in values.items()}
    valued = df.withColumns(clean)
    o = F.col(order).cast("long")
    row = F.struct(*[F.col(c) for c in df.columns])

    def mark(at: Column, probe: int, own: str | None, sign: float) -> Column:
        return F.struct(
            at.alias("_o"),
            F.lit(probe).alias("_probe"),
            (row if probe else F.when(F.lit(False), row)).alias("_row"),
            *[
                (F.col(f"_v_{name}") * sign if prefix == own else F.lit(0.0)).alias(f"_m_{prefix}_{name}")
                for prefix in frames
                for name in values
            ],
        )

    # one pass over the input: every row yields its marks and itself as a probe
    marks = [mark(o, 1, None, 0.0)]
    for prefix, (lo, hi) in frames.items():
        marks += [mark(o - hi, 0, prefix, 1.0), mark(o + 1 - lo, 0, prefix, -1.0)]
    both = valued.select(*keys, F.inline(F.array(*marks)))
    if width is None:
        width = plan_width(df, keys, order)
    scanned = prefix_scan(
        both, keys, "_o", {n: F.col(f"_m_{n}") for n in names}, ["_probe"], width
    )
    return scanned.where("_probe = 1").select("_row.*", *names)


def pane_width(
    df: DataFrame, keys: Sequence[str], order: str, frames: dict[str, tuple[int, int]]
) -> int:
    """Width for ``with_moments`` at which no group holds much more than ``MOMENT_ROWS`` rows."""
    width = plan_width(df, keys, order, MOMENT_ROWS)
    lean = df.select(*keys, F.col(order).cast("long").alias("_at")).where("_at IS NOT NULL")
    for span, _ in _families(frames):
        for _ in range(6):  # recurring bursts may meet in one group: shrink until the fullest fits
            group, cut = _layout(span, width)
            at = F.col("_at")
            place = [slice_of(at, span * group).alias("_group"), _strip(at, span, cut).alias("_strip")]
            peak = lean.groupBy(*keys, *place).count().agg(F.max("count")).first()[0] or 0
            if peak <= 4 * MOMENT_ROWS or _layout(span, width // 2) == (group, cut):
                break
            width = max(1, int(width * MOMENT_ROWS / peak))
    return width


def _families(frames: dict[str, tuple[int, int]]) -> list[tuple[int, dict[str, int]]]:
    """Frames that can share their panes: equal spans, starts whole spans apart and near."""
    found: list[tuple[int, dict[str, int]]] = []
    for prefix, (lo, hi) in sorted(frames.items(), key=lambda item: item[1]):
        span = hi - lo + 1
        for other, starts in found:
            gap = lo - min(starts.values())
            if span == other and gap % span == 0 and gap <= 2 * span:
                starts[prefix] = lo
                break
        else:
            found.append((span, {prefix: lo}))
    return found


def _layout(span: int, width: int) -> tuple[int, int]:
    """Panes per group, and the width of the strips that panes are cut into."""
    if width >= 4 * span:
        return width // span, span
    return PANES, min(span, max(1, width // PANES, -(-span // STRIPS)))


def _strip(at: Column, span: int, cut: int) -> Column:
    return slice_of(F.pmod(at, F.lit(span)), cut)


def _pool(a: dict, b: dict) -> dict:
    """Moments of two sets of rows together, for arrays of such sets; an empty set has zeros."""
    out = {k: a[k] + b[k] for k in ("all", "n", "pairs", "pn") if k in a}
    out |= {"lo": np.minimum(a["lo"], b["lo"]), "hi": np.maximum(a["hi"], b["hi"])}
    for n, means, products in CENTRAL:
        if n not in a:
            continue
        share = b[n] / np.maximum(out[n], 1)
        both = (a[n] > 0) & (b[n] > 0)
        gap = {m: np.where(both, b[m] - a[m], 0.0) for m in means}
        for m in means:
            out[m] = np.where(a[n] > 0, a[m] + gap[m] * share, b[m])
        for p, (left, right) in products.items():
            out[p] = a[p] + b[p] + gap[left] * gap[right] * (a[n] * share)
    return out


def _running(state: dict, place: np.ndarray) -> dict:
    """Moments from the start of its run up to each row; ``place`` is a row's place in its run.

    Neighbouring results over 1, 2, 4, ... rows are pooled: no loop over rows, no subtraction.
    """
    step = 1
    while step <= place.max(initial=0):
        to = np.flatnonzero(place >= step)
        merged = _pool({k: v[to - step] for k, v in state.items()}, {k: v[to] for k, v in state.items()})
        state = {k: v.copy() for k, v in state.items()}
        for k, v in merged.items():
            state[k][to] = v
        step *= 2
    return state


def _both_ways(state: dict, run: np.ndarray) -> tuple[dict, dict]:
    """Running moments from the start and from the end of each run of equal ``run`` values."""

    def place(run):
        index = np.arange(len(run))
        begins = np.append(True, run[1:] != run[:-1])[: len(run)]
        return index - np.maximum.accumulate(np.where(begins, index, 0))

    back = _running({k: v[::-1] for k, v in state.items()}, place(run[::-1]))
    return _running(state, place(run)), {k: v[::-1] for k, v in back.items()}


def _picked(state: dict, index: np.ndarray, found: np.ndarray) -> dict:
    """The moments at ``index``, those of no rows where nothing was found."""
    none = {"lo": np.inf, "hi": -np.inf}
    out = {}
    for k, v in state.items():
        out[k] = np.full(len(index), none.get(k, 0), v.dtype)
        out[k][found] = v[index[found]]
    return out


def _of_rows(x: pa.ChunkedArray, e: pa.ChunkedArray | None) -> dict:
    """Moments of single rows; null counts as no row."""
    v, given = x.to_numpy().astype(float), x.is_valid().to_numpy()
    fine, zero = np.isfinite(v), np.zeros(len(v))
    v = np.where(fine, v, 0.0)
    state = {"all": given.astype("int64"), "n": fine.astype("int64"), "mean": v, "ss": zero}
    state |= {"lo": np.where(fine, v, np.inf), "hi": np.where(fine, v, -np.inf)}
    if e is not None:
        w = e.to_numpy().astype(float)
        both = fine & np.isfinite(w)
        state |= {"pairs": (given & e.is_valid().to_numpy()).astype("int64"), "pn": both.astype("int64")}
        state |= {"px": np.where(both, v, 0.0), "pe": np.where(both, w, 0.0), "xx": zero, "ee": zero, "xe": zero}
    return state


def _cell_moments(paired: bool) -> dict[str, Column]:
    """The same moments as aggregates of ``_x`` and ``_e``."""

    def finite(name: str) -> Column:
        return F.when(~F.isnan(name) & (F.abs(name) < float("inf")), F.col(name))

    x, e = finite("_x"), finite("_e")
    parts = {
        "all": F.count("_x"),
        "n": F.count(x),
        "mean": F.avg(x),
        "ss": F.var_pop(x) * F.count(x),
        "lo": F.coalesce(F.min(x), F.lit(float("inf"))),
        "hi": F.coalesce(F.max(x), F.lit(float("-inf"))),
    }
    if paired:
        px, pe = F.when(e.isNotNull(), x), F.when(x.isNotNull(), e)
        parts |= {
            "pairs": F.count(F.when(F.col("_x").isNotNull(), F.col("_e"))),
            "pn": F.count(px),
            "px": F.avg(px),
            "pe": F.avg(pe),
            "xx": F.var_pop(px) * F.count(px),
            "ee": F.var_pop(pe) * F.count(px),
            "xe": F.covar_pop(px, pe) * F.count(px),
        }
    return {k: F.coalesce(f, F.lit(0.0)) if k not in COUNTS else f for k, f in parts.items()}


def _types(names: Sequence[str], prefix: str = "") -> list[str]:
    return [f"`{prefix}{n}` {'long' if n in COUNTS else 'double'}" for n in names]


def _strip_carries(marks: DataFrame, key: list[str], reach: int, paired: bool) -> DataFrame:
    """Moments of what lies before and behind a strip in its pane, where frames begin or end.

    ``marks`` has the pane and strip of every value, and of every border with the first pane that
    it cuts.  They are summed per strip before any exchange.
    """
    names = list(_cell_moments(paired))
    parts = [f.alias(n) for n, f in _cell_moments(paired).items()]
    cells = marks.groupBy(*key, "_pane", "_strip").agg(*parts, F.bool_or("_border").alias("_border"))
    # a strip without values has to be answered as well
    uses = [F.struct(F.col("_pane").alias("_in"), F.lit(False).alias("_asked"), F.lit(True).alias("_own"))]
    uses += [
        F.struct((F.col("_pane") + p).alias("_in"), F.col("_border").alias("_asked"), F.lit(False).alias("_own"))
        for p in range(reach + 1)
    ]
    used = cells.select(*key, "_strip", *names, F.inline(F.array(*uses))).where("_own OR _asked")

    def scan(table: pa.Table) -> pa.Table:
        own = table.filter(table["_own"]).sort_by("_strip")
        state = {n: own[n].to_numpy() for n in names}
        past, ahead = _both_ways(state, np.zeros(own.num_rows))
        strips = np.unique(table.filter(table["_asked"])["_strip"].to_numpy())
        at = own["_strip"].to_numpy()
        first, end = np.searchsorted(at, strips), np.searchsorted(at, strips, "right")
        same = np.zeros(len(strips), "int64")
        columns = {k: table[k].take(same) for k in [*key, "_in"]} | {"_strip": pa.array(strips)}
        columns |= {f"b_{n}": v for n, v in _picked(past, first - 1, first > 0).items()}
        columns |= {f"f_{n}": v for n, v in _picked(ahead, end, end < len(at)).items()}
        return pa.table(columns)

    kinds = [f"{k} {used.schema[k].dataType.simpleString()}" for k in key]
    schema = ", ".join([*kinds, "_in long", "_strip long", *_types(names, "b_"), *_types(names, "f_")])
    return used.groupBy(*key, "_in").applyInArrow(scan, schema)


def _pane_moments(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    span: int,
    starts: dict[str, int],
    width: int,
    other: str | None,
) -> DataFrame:
    """Moments over frames of one span.

    Panes are as wide as a frame, so a frame is the end of one pane and the beginning of the
    next, cut at the same place of both.  Panes that are too full are cut into strips, and the
    same strip of neighbouring panes is one group.  A row moves once as the row that asks and
    once as a lean value (twice, where two groups need it), and is answered in one task.
    """
    group, cut = _layout(span, width)
    base = min(starts.values())
    reach = (max(starts.values()) - base) // span + 1
    paired, cutting = other is not None, cut < span
    names, key = list(_cell_moments(paired)), [KEY] if keys else []
    packed = [F.struct(*keys).alias(KEY)] if keys else []
    o = F.col(order).cast("long")
    x = F.col(value).cast("double")
    e = F.col(other).cast("double") if paired else F.lit(None).cast("double")
    pair = F.struct(x.alias("_x"), e.alias("_e"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])

    def record(to: Column, at: Column, asks: bool) -> Column:
        # rows without an order have no frame, so any group will do
        strip = F.coalesce(_strip(at, span, cut), F.pmod(F.xxhash64(x), F.lit(1024)))
        given, none = (row, pair) if asks else (pair, row)
        none = F.when(F.lit(False), none)
        parts = {"_group": to, "_strip": strip, "_at": at, "_pair": none if asks else given, "_row": given if asks else none}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    homes = F.sequence(slice_of(o - reach * span, span * group), slice_of(o, span * group))
    values = F.when(o.isNotNull(), F.transform(homes, lambda to: record(to, o, False)))
    asking = F.array(record(slice_of(o + base, span * group), o + base, True))
    records = df.select(*packed, F.inline(F.concat(F.coalesce(values, F.slice(asking, 1, 0)), asking)))
    if cutting:

        def mark(at: Column, border: bool) -> Column:
            parts = {"_pane": slice_of(at, span), "_strip": _strip(at, span, cut), "_border": F.lit(border)}
            given = [F.when(F.lit(not border), c).alias(n) for n, c in {"_x": x, "_e": e}.items()]
            return F.struct(*[c.alias(n) for n, c in parts.items()], *given)

        marks = df.where(o.isNotNull()).select(*packed, F.inline(F.array(mark(o, False), mark(o + base, True))))
        pane = F.col("_in")
        carries = _strip_carries(marks, key, reach, paired).select(
            *key,
            F.explode(F.sequence(slice_of(pane - reach, group), slice_of(pane, group))).alias("_group"),
            "_strip",
            (pane * F.lit(span)).alias("_at"),
            F.struct(*[f"{side}{n}" for side in ("b_", "f_") for n in names]).alias("_carry"),
        )
        records = records.unionByName(carries, allowMissingColumns=True)

    def solve(table: pa.Table) -> pa.Table:
        rows = table.filter(table["_row"].is_valid())
        valued = table.filter(table["_pair"].is_valid()).sort_by("_at")
        at = valued["_at"].to_numpy()
        x, e = pc.struct_field(valued["_pair"], "_x"), pc.struct_field(valued["_pair"], "_e")
        past, ahead = _both_ways(_of_rows(x, e if paired else None), at // span)
        if cutting:
            carry = table.filter(table["_carry"].is_valid()).sort_by("_at")
            carry_at = carry["_at"].to_numpy()
            sides = [{n: pc.struct_field(carry["_carry"], s + n).to_numpy() for n in names} for s in ("f_", "b_")]
        framed = rows["_at"].is_valid().to_numpy()
        begin = pc.fill_null(rows["_at"], 0).to_numpy()
        columns = {"_row": rows["_row"]}
        for prefix, lo in starts.items():
            start = begin + (lo - base)
            border = (start // span + 1) * span
            i, mid, j = (np.searchsorted(at, edge) for edge in (start, border, start + span))
            found = _pool(_picked(ahead, i, (i < mid) & framed), _picked(past, j - 1, (mid < j) & framed))
            if cutting:
                for side, edge in zip(sides, (border - span, border)):
                    k = np.searchsorted(carry_at, edge)
                    here = framed & (np.searchsorted(carry_at, edge, "right") > k)
                    found = _pool(found, _picked(side, k, here))
            n, lo, hi, whole = (found.pop(k) for k in ("n", "lo", "hi", "all"))
            level, odd = lo == hi, whole > n
            mean = np.where(odd, np.nan, np.where(level, lo, found.pop("mean")))
            sd = np.where(odd, np.nan, np.where(level, 0.0, np.sqrt(found.pop("ss") / np.maximum(n, 1))))
            columns[f"{prefix}_mean"] = pa.array(mean, mask=whole == 0)
            columns[f"{prefix}_sd"] = pa.array(sd, mask=whole == 0)
            columns[f"{prefix}_n"] = pa.array(whole)
            columns |= {f"{prefix}_{k}": pa.array(v) for k, v in found.items()}
        return pa.table(columns)

    fields = [T.StructField("_row", records.schema["_row"].dataType)]
    for prefix in starts:
        kept = ["mean", "sd", "n", *[n for n in ("pairs", "pn", "px", "pe", "xx", "ee", "xe") if paired]]
        fields += [T.StructField(f"{prefix}_{n}", T.LongType() if n in COUNTS else T.DoubleType()) for n in kept]
    solved = records.groupBy(*key, "_group", "_strip").applyInArrow(solve, T.StructType(fields))
    return solved.select("_row.*", *[f"`{f.name}`" for f in fields[1:]])


def with_moments(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    frames: dict[str, tuple[int, int]],
    width: int | None = None,
    other: str | None = None,
) -> DataFrame:
    """``<prefix>_n``, ``_mean`` and ``_sd`` (population) of a column over sliding frames.

    A frame that holds a NaN or infinite value has NaN moments, as a direct average would.
    Moments are pooled from (n, mean, squared deviations) of the parts of the two panes that a
    frame touches; nothing is subtracted, so that distant levels of a key do not blur the
    deviations at one of them.  A frame of equal values has deviation 0, and no other has.
    With a column ``other`` its co-moments with the value ride along, over the rows that have
    both: ``<prefix>_pairs`` (rows) and ``_pn`` (finite ones), means ``_px`` and ``_pe``, and sums
    of products of deviations ``_xx``, ``_ee`` and ``_xe``.
    """
    if width is None:
        width = pane_width(df, keys, order, frames)
    for span, starts in _families(frames):
        df = _pane_moments(df, keys, order, value, span, starts, width, other)
    return df


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    back: int,
    forward: int = 0,
    width: int | None = None,
) -> DataFrame:
    """Copy rows into every slice whose frames reach them; ``_own`` marks the original.

    ``back`` and ``forward`` are the reach of a range frame around a row.  The width
    is kept at least as large as the reach, so a row gets at most two extra copies.
    """
    if width is None:
        width = plan_width(df, keys, order)
    width = max(width, back, forward, 1)
    o = F.col(order)
    own = slice_of(o, width)
    first = slice_of(o - F.lit(forward), width)
    last = slice_of(o + F.lit(back), width)
    return (
        df.withColumn("_home", own)
        .withColumn(SLICE, F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_home") == F.col(SLICE))
        .drop("_home")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", SLICE)


def halo_window(keys: Sequence[str], order: str) -> Window:
    """Window over one slice, for range frames on the integer order column."""
    return Window.partitionBy(*keys, SLICE).orderBy(order)


def nearest_before(
    left: DataFrame,
    right: DataFrame,
    order: str,
    by: Sequence[str],
    right_cols: Sequence[str],
    tie: Sequence[str] = (),
    width: int | None = None,
    forward: bool = False,
    name: str = "_match",
) -> DataFrame:
    """Left rows plus the last right row at or before (``forward``: first at or after).

    Both sides are unioned and scanned in slices; a slice starts from the last right
    row of the earlier slices.  Nothing is paired, so the cost is linear.  The match is
    a struct column ``name`` holding ``order`` and ``right_cols``; null if there is none.
    """
    sign = -1 if forward else 1
    payload = F.struct(F.col(order).alias(order), *[F.col(c).alias(c) for c in right_cols if c != order])
    r = right.select(
        *by,
        (F.col(order) * sign).alias("_o"),
        F.lit(0).alias("_side"),
        payload.alias(name),
        *[F.col(t).alias(f"_tie_{t}") for t in tie],
    )
    l = left.select(
        *by,
        (F.col(order) * sign).alias("_o"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"),
    )
    both = with_slice(r.unionByName(l, allowMissingColumns=True), by, "_o", width)
    ties = [f"_tie_{t}" for t in tie]
    # going back the largest tie value wins, going forward the smallest
    rank = F.struct(F.col("_o"), *[(-F.col(t) if forward else F.col(t)) for t in ties])
    carry = (
        both.groupBy(KEY, SLICE)
        .agg(F.max_by(F.col(name), F.when(F.col("_side") == 0, rank)).alias("_best"))
        .withColumn("_carry", F.last("_best", ignorenulls=True).over(before()))
        .drop("_best")
    )
    tie_order = [F.desc(t) if forward else F.asc(t) for t in ties]
    w = (
        in_slice().orderBy("_o", "_side", *tie_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = _join_carry(both, carry).withColumn(
        name, F.coalesce(F.last(name, ignorenulls=True).over(w), F.col("_carry"))
    )
    return scanned.where("_side = 1").select("_left.*", name)
