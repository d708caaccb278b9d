"""Ordered operators per sensor or entity, built on slices, carries and halos."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.operators.ordered import (
    KEY,
    SLICE,
    across,
    drop_halo,
    halo_window,
    in_slice,
    lag_rows,
    last_rows,
    plan_width,
    prefix_scan,
    rolling_sums,
    row_index,
    with_halo,
    with_moments,
    with_slice,
)
from chromafield.session import cut_lineage, store_table


def temporal_diff(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """First difference of the carrier per key (``d_<col>``); the static term cancels."""
    out = lag_rows(df, keys, ts, cols, tie, width)
    return out.withColumns({f"d_{c}": F.col(c) - F.col(f"prev_{c}") for c in cols}).drop(
        *[f"prev_{c}" for c in cols]
    )


def delta_t(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """True time since the previous observation (``dt_us``); never assumed uniform."""
    out = lag_rows(df, keys, ts, [ts], tie, width)
    return out.withColumn("dt_us", F.col(ts) - F.col(f"prev_{ts}")).drop(f"prev_{ts}")


# exp(-x) underflows to zero in double arithmetic beyond this many time constants
_UNDERFLOW = 746
# time constants per slice: exp(+-40) keeps the in-slice sums far from overflow
_PER_SLICE = 40


def decay_smooth(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tau_us: int,
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """State x <- x e^(-dt/tau) + (1 - e^(-dt/tau)) u over irregular intervals.

    The first observation starts the state.  The recurrence is linear, so inside a slice
    it is a running sum of scaled inputs, and a slice starts from the end states of the
    earlier slices that have not decayed to zero in double arithmetic.  The slice is at
    most 40 tau wide; ``width`` can only make it smaller.
    """
    span = max(1, min(_PER_SLICE * tau_us, width or _PER_SLICE * tau_us))
    reach = -(-_UNDERFLOW * tau_us // span)
    rows = delta_t(df, keys, ts, tie, width)
    tau = F.lit(float(tau_us))
    gain = F.when(F.col("dt_us").isNull(), 1.0).otherwise(1.0 - F.exp(-F.col("dt_us") / tau))
    sliced = with_slice(rows, keys, ts, span).withColumns(
        {
            "_age": (F.col(ts) - F.col(SLICE) * F.lit(span)) / tau,
            "_b": gain * F.col(value),
        }
    )
    grown = F.col("_b") * F.exp("_age")
    ends = sliced.groupBy(KEY, SLICE).agg(F.sum(grown).alias("_sum"))
    # end state of each slice, referred to the slice's start; slices per key are few and
    # a frame of at most `reach` of them is folded
    frame = across().rangeBetween(-reach, -1)
    step = F.lit(span / tau_us)
    carry = ends.withColumn(
        "_prior", F.collect_list(F.struct(F.col(SLICE).alias("s"), F.col("_sum").alias("v"))).over(frame)
    ).select(
        KEY,
        SLICE,
        F.aggregate(
            "_prior",
            F.lit(0.0),
            lambda acc, p: acc + p["v"] * F.exp((p["s"] - F.col(SLICE)) * step),
        ).alias("_carry"),
    )
    w = in_slice().orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = sliced.join(carry, [KEY, SLICE], "left")
    state = (F.sum(grown).over(w) + F.coalesce("_carry", F.lit(0.0))) * F.exp(-F.col("_age"))
    return joined.withColumn("smoothed", state).drop(
        SLICE, KEY, "_age", "_b", "_carry", "dt_us"
    )


def rolling_z(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    span_us: int,
    ts: str = "timestamp_us",
    width: int | None = None,
) -> DataFrame:
    """Mean, deviation and z-score against the span before each row (the row itself excluded)."""
    out = with_moments(df, keys, ts, value, {"base": (-span_us, -1)}, width)
    z = F.try_divide(F.col(value) - F.col("base_mean"), F.col("base_sd"))
    return out.withColumn("z", z)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    cond: Column,
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Runs of consecutive rows that meet the condition: start, end and length.

    The run number is the running count of rows that break it; runs are then aggregated,
    so a run of any length combines map-side.
    """
    marked = df.withColumn("_ok", F.coalesce(cond, F.lit(False)))
    numbered = prefix_scan(
        marked, keys, ts, {"_run": F.when(F.col("_ok"), 0).otherwise(1).cast("long")}, tie, width
    )
    return (
        numbered.where("_ok")
        .groupBy(*keys, "_run")
        .agg(F.min(ts).alias("start_us"), F.max(ts).alias("end_us"), F.count("*").alias("rows"))
        .drop("_run")
    )


def sustained(
    df: DataFrame,
    keys: Sequence[str],
    cond: Column,
    n: int = 3,
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Runs in which the condition holds for at least ``n`` consecutive windows."""
    return islands(df, keys, cond, ts, tie, width).where(F.col("rows") >= n)


def motif_events(
    df: DataFrame,
    motif: str = "motif",
    ts: str = "timestamp_us",
    freq: str = "frequency_hz",
    confidence: str = "confidence",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Progress within each motif: phase of phase_total, and seconds to the next event.

    The expected gap is the mean gap of the motif so far seen in the table; the ETA of an
    occurrence is that gap, less the time already passed at the motif's latest row.  A
    motif seen once has no gap and a null ETA.
    """
    from chromafield.functions.text import motif_name

    phased = row_index(
        df,
        [motif],
        ts,
        tie,
        width,
        "phase",
        {
            "phase_total": ("sum", F.lit(1).cast("long")),
            "_first": ("min", F.col(ts)),
            "_last": ("max", F.col(ts)),
        },
    )
    gap = F.try_divide(F.col("_last") - F.col("_first"), (F.col("phase_total") - 1) * F.lit(1e6))
    elapsed = (F.col("_last") - F.col(ts)) / F.lit(1e6)
    return phased.select(
        motif,
        motif_name(F.col(motif)).alias("name"),
        "phase",
        "phase_total",
        F.col(confidence).alias("confidence"),
        (gap - elapsed).alias("next_event_eta_secs"),
        F.col(freq).alias("freq_hz"),
        ts,
    )


SCANS = {
    "inclusive_sum": ("sum", False),
    "exclusive_sum": ("sum", True),
    "exclusive_product": ("product", True),
    "leader": ("first", False),
    "ballot": ("any", False),
}


def scan(
    df: DataFrame,
    value: Column,
    kind: str,
    keys: Sequence[str],
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
    name: str = "scan",
) -> DataFrame:
    """Running scan per key: sums, product, first value, or any-so-far of a predicate."""
    fold, exclusive = SCANS[kind]
    return prefix_scan(df, keys, ts, {name: value}, tie, width, fold, exclusive)


def _link(prev: Column, text: Column) -> Column:
    return F.sha2(F.concat(prev, text).cast("binary"), 256)


def _fold(texts: Column, start: Column) -> Column:
    """Chain value after all texts."""
    return F.aggregate(texts, start, _link)


def _unfold(texts: Column, start: Column) -> Column:
    """Chain value after each text, as an array (blocks are small, see ``block_rows``)."""
    empty = F.struct(start.alias("h"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, text: Column) -> Column:
        value = _link(acc["h"], text)
        return F.struct(value.alias("h"), F.concat(acc["out"], F.array(value)).alias("out"))

    return F.aggregate(texts, empty, step, lambda acc: acc["out"])


def _block_heads(digests: DataFrame, block_rows: int, levels: int) -> DataFrame:
    """(_key, block, _head): the chain value each block but the first starts from.

    Digests are chained like rows: in groups of ``block_rows``, where a group starts from the
    value after the group before it, a level above.  ``levels`` must reach the level on which
    every session has one group.
    """
    group = F.floor(F.col("block") / block_rows).cast("long")
    packed = digests.groupBy(KEY, group.alias("_group")).agg(
        F.sort_array(F.collect_list(F.struct("block", "_d"))).alias("_b")
    )
    start = F.lit("")
    if levels > 1:
        upper = packed.select(
            KEY, F.col("_group").alias("block"), _fold(F.col("_b")["_d"], F.lit("")).alias("_d")
        )
        heads = _block_heads(upper, block_rows, levels - 1).withColumnsRenamed(
            {"block": "_group", "_head": "_start"}
        )
        packed = packed.join(heads, [KEY, "_group"], "left")
        start = F.coalesce("_start", start)
    after = _unfold(F.col("_b")["_d"], start)
    # the value after a block is where the next one starts, in whichever group that is
    zipped = F.explode(F.arrays_zip(F.col("_b")["block"].alias("block"), after.alias("_head")))
    return packed.select(KEY, zipped.alias("_z")).select(
        KEY, (F.col("_z.block") + 1).alias("block"), "_z._head"
    )


def _packed_blocks(
    df: DataFrame, session: Sequence[str], payload: str, ts: str, tie: Sequence[str], block_rows: int,
    width: int | None,
) -> DataFrame:
    """One row per session and block, with the block's rows in order."""
    indexed = row_index(df, session, ts, tie, width, "_i")
    return (
        indexed.withColumns(
            {
                KEY: F.struct(*session) if session else F.lit(0),
                "block": F.floor((F.col("_i") - 1) / block_rows).cast("long"),
            }
        )
        .groupBy(KEY, "block")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("_i", F.col(payload).cast("string").alias("p"), F.struct(*df.columns).alias("r"))
                )
            ).alias("_rows")
        )
    )


def _levels(blocks: int, block_rows: int) -> int:
    levels = 1
    while blocks > block_rows:
        blocks, levels = -(-blocks // block_rows), levels + 1
    return levels


def build_chain(
    df: DataFrame,
    session: Sequence[str],
    payload: str,
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    block_rows: int = 4096,
    width: int | None = None,
) -> DataFrame:
    """Tamper-evident hash chain per session, built in parallel blocks.

    Let ``C(x)`` be the chain of a list ``x``, and ``D(x)`` the list of its digests: the last
    value of h = sha2(prev || x_i), from an empty start, over every ``block_rows`` entries.  Then
    ``C(x)`` continues h = sha2(prev || x_i) inside a block; the first block starts empty, and
    block b starts from entry b - 1 of ``C(D(x))``, the chain of the digests, which is built in
    the same way.  A list of one block is the plain chain.  A row's hash depends on the rows
    before it and on ``block_rows`` alone, however long the session becomes.

    A plain chain over all rows could be built only row after row, by one task per session;
    give a larger ``block_rows`` to have longer plain stretches.
    """
    packed = _packed_blocks(df, session, payload, ts, tie, block_rows, width)
    # one short row per block; cut here, so that the levels above do not pack the rows again
    digests = cut_lineage(
        packed.select(KEY, "block", _fold(F.col("_rows")["p"], F.lit("")).alias("_d"))
    )
    most = (digests.agg(F.max("block")).first()[0] or 0) + 1
    heads = _block_heads(digests, block_rows, _levels(most, block_rows))
    blocks = packed.join(heads, [KEY, "block"], "left").withColumn("_head", F.coalesce("_head", F.lit("")))
    hashes = _unfold(F.col("_rows")["p"], F.col("_head"))
    zipped = F.arrays_zip(F.col("_rows").alias("x"), hashes.alias("h"))
    return blocks.select("block", "_head", F.explode(zipped).alias("_z")).select(
        "_z.x.r.*",
        F.col("_z.x._i").alias("position"),
        "block",
        F.col("_head").alias("block_head"),
        F.col("_z.h").alias("chain_hash"),
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _chained(texts: list[str | None], start: str | None) -> list[str | None]:
    """Chain value after each text; there is none from a null text on."""
    value, made = start or "", []
    for text in texts:
        value = None if value is None or text is None else _sha(value + text)
        made.append(value)
    return made


def _checked_heads(
    df: DataFrame, session: Sequence[str], payload: str, ts: str, tie: Sequence[str], block_rows: int
) -> DataFrame:
    """(session, block, _head) from the payloads and stored ``block`` numbers, for verification.

    Built apart from ``build_chain``: level by level over tables of one row per list entry, with
    plain hashing of each group of ``block_rows`` entries.  A task has many groups, so that short
    blocks cost no more per row than long ones.
    """
    keys = [f"_s{i}" for i in range(len(session))]
    chained = F.udf(_chained, "array<string>", useArrow=False)
    digest = F.udf(lambda texts: _chained(texts, None)[-1], "string", useArrow=False)

    def packed(entries: DataFrame) -> DataFrame:
        """One row per group ``_g``, with its entries ``_l`` (_n, _x) in the order of ``_n``."""
        listed = F.sort_array(F.collect_list(F.struct("_n", "_x")))
        return entries.groupBy(*keys, "_g").agg(listed.alias("_l"))

    def digests(entries: DataFrame) -> DataFrame:
        return cut_lineage(packed(entries).select(*keys, F.col("_g").alias("_i"), digest("_l._x").alias("_x")))

    def grouped(level: DataFrame) -> DataFrame:
        return level.select(*keys, F.expr(f"_i div {block_rows}").alias("_g"), F.col("_i").alias("_n"), "_x")

    # rows of a block are in their order, entries of a level in that of their block
    levels = [
        digests(
            df.select(
                *[F.col(c).alias(k) for k, c in zip(keys, session)],
                F.col("block").alias("_g"),
                F.struct(F.col(ts), *[F.col(t) for t in tie]).alias("_n"),
                F.col(payload).cast("string").alias("_x"),
            )
        )
    ]
    while (levels[-1].agg(F.max("_i")).first()[0] or 0) >= block_rows:
        levels.append(digests(grouped(levels[-1])))
    starts = None
    for level in reversed(levels):
        groups = packed(grouped(level))
        if starts is None:
            groups = groups.withColumn("_start", F.lit(None).cast("string"))
        else:
            on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_g") == F.col("_i")]
            known = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_i", F.col("_x").alias("_start"))
            groups = groups.join(known, on, "left")
        zipped = F.arrays_zip(F.col("_l._n").alias("n"), chained("_l._x", "_start").alias("x"))
        starts = groups.select(*keys, F.explode(zipped).alias("_z")).select(
            *keys, (F.col("_z.n") + 1).alias("_i"), F.col("_z.x").alias("_x")
        )
    return starts.select(*keys, F.col("_i").alias("_block"), F.col("_x").alias("_head"))


def verify_chain(
    df: DataFrame,
    session: Sequence[str],
    payload: str,
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """Check a stored chain: adds ``chain_ok``.

    Inside a block each row is checked against its predecessor's stored hash, in parallel;
    a block's first row is checked against its stored head, and the head against the
    digests of all earlier payloads, by a second implementation.
    """
    if width is None:
        width = plan_width(df, session, ts)
    out = lag_rows(df, session, ts, ["chain_hash", "block"], tie, width)
    inside = F.coalesce(F.col("prev_block") == F.col("block"), F.lit(False))
    prev = F.when(inside, F.col("prev_chain_hash")).otherwise(F.col("block_head"))
    link_ok = _link(prev, F.col(payload).cast("string")) == F.col("chain_hash")
    heads = _checked_heads(df, session, payload, ts, tie, block_rows)
    on = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(session)]
    head_ok = F.coalesce(F.coalesce("_head", F.lit("")) == F.col("block_head"), F.lit(False))
    return (
        out.join(heads, [*on, F.col("block") == F.col("_block")], "left")
        .withColumn("chain_ok", F.coalesce(link_ok, F.lit(False)) & (inside | head_ok))
        .select(*df.columns, "chain_ok")
    )


def latest(
    df: DataFrame, keys: Sequence[str], ts: str = "timestamp_us", tie: Sequence[str] = ()
) -> DataFrame:
    """Last row per key, found without a sort of the table (see ``last_rows``)."""
    return last_rows(df, keys, ts, tie)


def history(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    span_us: int | None = None,
    rows: int | None = None,
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Bounded history per row: the last ``span_us`` of time or the last ``rows`` rows.

    Every row gets an array of its own, so the output grows with rows times frame: for long
    frames use ``shared_history``.  The row form numbers the rows first and then uses the number as its order column.
    """
    if span_us is not None:
        w = halo_window(keys, ts).rangeBetween(-span_us, 0)
        haloed = with_halo(df, keys, ts, span_us, 0, width)
    else:
        numbered = row_index(df, keys, ts, tie, width, "_i")
        block = max(rows, min(100_000, width or 100_000))
        haloed = with_halo(numbered, keys, "_i", rows - 1, 0, block)
        w = halo_window(keys, "_i").rowsBetween(-(rows - 1), 0)
    out = haloed.withColumn("history", F.collect_list(value).over(w))
    return drop_halo(out).drop("_i")


def shared_history(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    span_us: int | None = None,
    rows: int | None = None,
    ts: str = "timestamp_us",
    tie: Sequence[str] = (),
    width: int | None = None,
    block_rows: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """Bounded history without copies: ``(refs, blocks)``, both linear in the rows.

    ``blocks`` holds each key's values once, in order: ``(keys, block, values)`` with ``block_rows``
    values a block.  ``refs`` are the rows of ``df`` with ``history_from`` and ``history_to``, the
    first and last position (from 1, over all blocks of the key) of the last ``span_us`` of time,
    peers included, or of the last ``rows`` rows.  ``read_history`` gives the values of chosen rows.
    """
    if width is None:
        width = plan_width(df, keys, ts)
    numbered = row_index(df, keys, ts, tie, width, "_i")
    if span_us is None:
        last = F.col("_i")
        first = F.greatest(F.col("_i") - F.lit(rows - 1), F.lit(1))
    else:
        numbered = rolling_sums(numbered, keys, ts, {"_h": (-span_us, 0)}, {"n": F.lit(1).cast("long")}, width)
        # rows of a key at one time stay together in all ordered operators
        last = F.max("_i").over(Window.partitionBy(*keys, ts))
        first = last - F.col("_h_n") + 1
    numbered = store_table(
        numbered.select(*df.columns, "_i", last.alias("history_to"), first.cast("long").alias("history_from")), "history"
    )
    blocks = (
        numbered.groupBy(*keys, F.expr(f"(_i - 1) div {block_rows}").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("_i", F.col(value).alias("v")))).alias("_x"))
        .select(*keys, "block", F.col("_x")["v"].alias("values"))
    )
    return numbered.select(*df.columns, "history_from", "history_to"), blocks


def read_history(
    refs: DataFrame, blocks: DataFrame, keys: Sequence[str], ident: Sequence[str], block_rows: int = 4096
) -> DataFrame:
    """``(ident, history)``: the values, in order and without nulls, that chosen ``refs`` point to."""
    place = [F.expr(f"(history_from - 1) div {block_rows}"), F.expr(f"(history_to - 1) div {block_rows}")]
    asked = refs.select(*keys, *[c for c in ident if c not in keys], "history_from", "history_to", F.explode(F.sequence(*place)).alias("_b"))
    known = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "block", "values")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    start = F.greatest(F.col("history_from") - F.col("_b") * block_rows, F.lit(1)).cast("int")
    end = F.least(F.col("history_to") - F.col("_b") * block_rows, F.lit(block_rows)).cast("int")
    part = F.slice("values", start, end - start + 1)
    joined = asked.join(known, [*on, F.col("_b") == F.col("block")])
    return (
        joined.groupBy(*ident)
        .agg(F.sort_array(F.collect_list(F.struct("_b", part.alias("p")))).alias("_x"))
        .select(*ident, F.filter(F.flatten(F.col("_x")["p"]), lambda v: v.isNotNull()).alias("history"))
    )


def edge_stability(
    edges: DataFrame, frame: str = "frame", src: str = "src", dst: str = "dst"
) -> DataFrame:
    """Per frame: share of edges still present in the next frame, and edges that flip.

    A flip is an edge that vanishes for one frame and returns.  An equi-join on
    (src, dst, frame) keeps every key unique, so nothing is skewed.
    """
    e = edges.select(src, dst, frame).distinct()
    marks = e.withColumn("_m", F.lit(1)).unionByName(
        e.withColumn(frame, F.col(frame) - 1).withColumn("_m", F.lit(2))
    ).unionByName(e.withColumn(frame, F.col(frame) - 2).withColumn("_m", F.lit(4)))
    seen = marks.groupBy(src, dst, frame).agg(F.bit_or("_m").alias("_m")).where("_m % 2 = 1")
    return seen.groupBy(frame).agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("_m").bitwiseAND(2) > 0).alias("kept"),
        F.count_if(F.col("_m") == 5).alias("flips"),
        F.avg(F.when(F.col("_m").bitwiseAND(2) > 0, 1.0).otherwise(0.0)).alias("stability"),
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie: str,
    tiles: int = 4,
    scale: float = 1e6,
    width: int | None = None,
) -> DataFrame:
    """row_number, rank, dense_rank, percent_rank and ntile, highest ``by`` first.

    Ranks come from running counts over the distinct values, sliced on the fixed-point
    value (``scale``); a group of any size is ranked by many tasks.  ``tie`` is an integer
    id that orders equal values.
    """
    work = df.withColumns(
        {"_desc": -F.col(by), "_at": F.floor(-F.col(by) * F.lit(scale)).cast("long")}
    )
    values = work.groupBy(*keys, "_at", "_desc").agg(F.count("*").alias("_same"))
    values = prefix_scan(
        values,
        keys,
        "_at",
        {"_above": F.col("_same"), "dense_rank": F.lit(1).cast("long")},
        ["_desc"],
        width,
        totals={"_total": ("sum", F.col("_same"))},
    )
    placed = row_index(work, [*keys, "_desc"], tie, (), width, "_nth")
    on = [*keys, "_at", "_desc"]
    right = values.select(*[F.col(k).alias(f"_r{k}") for k in on], "_above", "_same", "dense_rank", "_total")
    same = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in on]
    joined = placed.join(right, same).drop(*[f"_r{k}" for k in on])
    rank = F.col("_above") - F.col("_same") + 1
    base, extra = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
    wide = extra * (base + 1)
    nth = F.col("row_number")
    tile = F.when(nth <= wide, F.floor((nth - 1) / (base + 1))).otherwise(
        extra + F.floor(F.try_divide(nth - 1 - wide, base))
    )
    return (
        joined.withColumns({"row_number": rank - 1 + F.col("_nth"), "rank": rank})
        .withColumns(
            {
                "percent_rank": F.coalesce(
                    F.try_divide(F.col("rank") - 1, F.col("_total") - 1), F.lit(0.0)
                ),
                "ntile": (tile + 1).cast("long"),
            }
        )
        .drop("_desc", "_at", "_nth", "_above", "_same", "_total")
    )


__all__ = [
    "build_chain",
    "decay_smooth",
    "delta_t",
    "edge_stability",
    "history",
    "islands",
    "latest",
    "motif_events",
    "ranked",
    "rolling_z",
    "scan",
    "sustained",
    "temporal_diff",
    "verify_chain",
]
