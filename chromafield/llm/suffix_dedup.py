"""Passages of 50 bytes and more that an earlier document holds as well, by suffix sorting.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller
id.  Matches never cross documents, and all strings are judged on the input.

1. Every 50-byte window is assigned to the smallest hash of the 16-byte strings inside it.
   Equal windows have equal hashes, whatever surrounds them.  Successive windows with one hash
   make a run, on average 20 windows long.
2. A filter of the hashes that occur in two documents or more leaves out the runs that cannot
   match.  It has eight bits per expected run up to ``MAX_CELLS`` bits (64 MB, the bound of what
   the driver merges and broadcasts).  Above ten gigabytes of text it fills up and passes more:
   at most 3.5 bytes are then shuffled per byte of text.  Results are the same at any filling.
3. Equal runs of one task are decided there; one of each goes on, so a passage in a third of
   all documents is a row per task.
4. Runs of one hash meet in one task.  Their windows are suffixes that are sorted as in the
   deep-shallow suffix sort: a multikey quicksort, eight bytes as one character, down to
   ``SHALLOW`` bytes, then blind tries for the groups with longer common prefixes.  Equal
   neighbours are equal windows; the smallest id of each group keeps it.
5. A hash with more than ``MAX_GROUP`` bytes of different runs is not sorted in one task: its
   windows are grouped by their 50 bytes over all tasks.

Defined results: a null text is empty; a row with a null id loses nothing and takes nothing from
others; rows that repeat an id take nothing from each other; an empty table gives an empty result.  Names that
begin with ``__`` are reserved.  Result columns replace input
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.llm.rows import prepare, with_text_columns
from chromafield.session import store_table

LENGTH = 50
GRAM = 16
SHALLOW = 16
# where eight bytes are compared below the shallow depth, the deepest first
DEEP = [LENGTH - 8, *reversed(range(SHALLOW, LENGTH - 8, 8))]
BLOCK = 1 << 16
MAX_CELLS = 1 << 29
RUN_BYTES = 19  # text per run, as expected for random hashes
FLUSH_RUNS = 2_000_000
FLUSH_BYTES = 48 << 20
SORT_BYTES = 4 << 20
MAX_GROUP = 64 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts as the bytes do."""
    count = max(len(data) - 7, 0)
    word = np.zeros(count, np.uint64)
    for i in range(8):
        word |= data[i : i + count].astype(np.uint64) << np.uint64(56 - 8 * i)
    return word


def window_keys(data: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` bytes the smallest hash of its strings of ``GRAM`` bytes."""
    count = len(data) - LENGTH + 1
    if count < 1:
        return np.empty(0, np.uint64)
    word, grams = words_at(data), len(data) - GRAM + 1
    least = np.zeros(grams, np.uint64)
    for i in range(0, GRAM, 8):
        least = (least ^ word[i : i + grams]) * _MIX
        least ^= least >> np.uint64(32)
    least *= _MIX
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[:count], least[width - step : width - step + count])


def runs(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, and for each run its hash, first window and the window after its last."""
    raw = (text or "").encode()
    keys = window_keys(np.frombuffer(raw, np.uint8))
    if not len(keys):
        return raw, keys, np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return raw, keys[starts], starts, np.append(starts[1:], len(keys))


def _cell(keys: np.ndarray, cells: int) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def repeat_filter(rows: DataFrame, cells: int) -> bytes:
    """A bit for each cell that is hit by two documents of ``rows (text)``."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(parts):
            found, count = np.unique(np.concatenate(parts), return_counts=True)
            blocks = np.unique(found // BLOCK)
            cuts = np.append(np.searchsorted(found, blocks * BLOCK), len(found))
            once, more = [], []
            for a, b in zip(cuts, cuts[1:]):
                low, many = (found[a:b] % BLOCK).astype(np.uint16), count[a:b] > 1
                once.append(low[~many].tobytes())
                more.append(low[many].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                names=["block", "once", "more"],
            )

        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                found = np.unique(_cell(runs(text.as_py())[1], cells))
                parts.append(found)
                held += len(found)
                if held > FLUSH_RUNS:
                    yield flushed(parts)
                    parts, held = [], 0
        if held:
            yield flushed(parts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}  # 2 bits' worth per cell: hit never, once, twice
        for batch in batches:
            for block, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                count = seen.setdefault(block, np.zeros(BLOCK, np.uint8))
                low = np.frombuffer(once, np.uint16)
                count[low] = np.minimum(count[low] + 1, 2)
                count[np.frombuffer(more, np.uint16)] = 2
        for block, count in seen.items():
            bits = np.packbits(count > 1, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([bits], pa.binary())], names=["block", "bits"]
            )

    blocks = (
        rows.mapInArrow(hits, "block long, once binary, more binary")
        .repartition("block")
        .mapInArrow(merged, "block long, bits binary")
    )
    whole = bytearray(max(cells, BLOCK) // 8)
    for row in blocks.collect():  # at most MAX_CELLS / 8 bytes
        whole[row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = row["bits"]
    return bytes(whole)


def equal_windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Group number of each window ``data[at : at + LENGTH]``; equal windows share theirs.

    Deep-shallow order: the suffixes are sorted by multikey quicksort to ``SHALLOW`` bytes, all
    parts of one depth together; groups that are still equal become blind tries, built level by
    level for all groups at once.  A trie's node keeps the depth at which its suffixes part,
    found against the node's first suffix, and branches on the one byte there.
    """
    word = words_at(np.concatenate([data, np.zeros(16, np.uint8)]))
    group = np.zeros(len(at), np.int64)  # by position in ``at``
    order, number = np.arange(len(at)), 0
    for depth in range(0, SHALLOW, 8):
        value = word[at[order] + depth]
        ranked = np.lexsort((value, group[order])) if depth else np.argsort(value, kind="stable")
        order, value = order[ranked], value[ranked]
        fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (np.diff(group[order]) != 0)])
        group[order] = number + np.cumsum(fresh) - 1
        number += int(fresh.sum())
        # a suffix alone in its group is in place
        size = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        order = order[np.repeat(size > 1, size)]
        if not len(order):
            return group
    while len(order):
        own = group[order]
        firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(firsts, len(order)))
        leader = np.repeat(order[firsts], size)
        parted = np.full(len(order), LENGTH, np.int64)
        for depth in DEEP:
            differ = word[at[order] + depth] ^ word[at[leader] + depth]
            apart = np.flatnonzero(differ)
            parted[apart] = depth + _first_byte(differ[apart])
        skip = np.minimum.reduceat(parted, firsts)
        # groups that part nowhere are leaves of equal windows
        going = np.repeat(skip < LENGTH, size)
        order, own, branch = order[going], own[going], np.repeat(skip, size)[going]
        if not len(order):
            break
        byte = data[at[order] + branch]
        ranked = np.lexsort((byte, own))
        order, own, byte = order[ranked], own[ranked], byte[ranked]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (byte[1:] != byte[:-1])])
        group[order] = number + np.cumsum(fresh) - 1
        number += int(fresh.sum())
        size = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        order = order[np.repeat(size > 1, size)]
    return group


def _first_byte(differ: np.ndarray) -> np.ndarray:
    """Index of the first byte, from the most significant on, that is not zero."""
    index = np.full(len(differ), 7, np.int64)
    for i in range(6, -1, -1):
        index[(differ >> np.uint64(56 - 8 * i)) != 0] = i
    return index


class Intervals:
    """Removed intervals per document, as rows."""

    def __init__(self):
        self.found: dict[tuple[int, int], list[int]] = {}

    def add(self, doc: tuple[int, int], start: int, end: int) -> None:
        self.found.setdefault(doc, []).extend((start, end))

    def rows(self) -> list[tuple]:
        made = [(k[0], k[1], None, None, np.array(v, np.int32).tobytes()) for k, v in self.found.items()]
        self.found = {}
        return made


OUT = "doc long, tag long, key long, run binary, places binary"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _TYPES)], names=["doc", "tag", "key", "run", "places"]
    )


class Runs:
    """Runs by content: the smallest document that has each, with its places there."""

    def __init__(self):
        self.found: dict[bytes, list] = {}
        self.bytes = 0

    def add(self, run: bytes, key: int, doc: tuple[int, int], places: list[int], lost: Intervals) -> None:
        known = self.found.get(run)
        if known is None:
            self.found[run] = [key, doc, places]
            self.bytes += len(run) + 200
        elif known[1] == doc:
            known[2] = known[2] + places
        elif known[1][0] == doc[0]:
            # another text under the same id: both go on, under contents of their own
            known.append((doc, places))
        else:
            if doc[0] < known[1][0]:
                for old, there in [(known[1], known[2]), *known[3:]]:
                    for p in there:
                        lost.add(old, p, p + len(run))
                self.found[run] = [key, doc, places]
            else:
                for p in places:
                    lost.add(doc, p, p + len(run))

    def rows(self) -> list[tuple]:
        made = [
            (doc[0], doc[1], v[0], run, np.array(places, np.int32).tobytes())
            for run, v in self.found.items()
            for doc, places in [(v[1], v[2]), *v[3:]]
        ]
        self.found, self.bytes = {}, 0
        return made


def _candidates(rows: DataFrame, bits, cells: int) -> DataFrame:
    """Runs whose hash may be in another document, and what the tasks have decided already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(bits.value, np.uint8)
        held, lost = Runs(), Intervals()
        for batch in batches:
            for doc, tag, text in zip(*(batch.column(i) for i in range(3))):
                raw, keys, first, after = runs(text.as_py())
                cell = _cell(keys, cells)
                may = np.flatnonzero((mask[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
                name = (doc.as_py(), tag.as_py())
                for key, a, b in zip(keys[may].view(np.int64).tolist(), first[may].tolist(), after[may].tolist()):
                    held.add(raw[a : b + LENGTH - 1], key, name, [a], lost)
                if held.bytes > FLUSH_BYTES:
                    yield _batch(held.rows())
                    yield _batch(lost.rows())
        yield _batch(held.rows())
        yield _batch(lost.rows())

    return rows.mapInArrow(run, OUT)


def _decided(batches: Iterator[pa.RecordBatch], max_group: int) -> Iterator[pa.RecordBatch]:
    """Sorts the runs of each hash; its input is ordered by ``key``, decided rows first.

    The rows of a hash that is too large come out with their key, undecided.
    """
    lost, held, size = Intervals(), [], 0
    current, current_key, too_large = Runs(), None, False
    for batch in batches:
        for doc, tag, key, run, places in zip(*(c.to_pylist() for c in batch.columns)):
            places = np.frombuffer(places, np.int32).tolist()
            if key is None:
                lost.found.setdefault((doc, tag), []).extend(places)
                continue
            if key != current_key:
                if too_large:
                    yield _batch(current.rows())
                else:
                    held.append(current)
                    size += current.bytes
                current, current_key, too_large = Runs(), key, False
                if size > SORT_BYTES:
                    _sort(held, lost)
                    yield _batch(lost.rows())
                    held, size = [], 0
            current.add(run, key, (doc, tag), places, lost)
            if current.bytes > max_group:
                too_large = True
                yield _batch(current.rows())
    if too_large:
        yield _batch(current.rows())
    else:
        held.append(current)
    _sort(held, lost)
    yield _batch(lost.rows())


def _sort(held: list[Runs], lost: Intervals) -> None:
    """Adds what the runs of each hash take from one another."""
    several = [(r, v) for group in held if len(group.found) > 1 for r, v in group.found.items()]
    if not several:
        return
    entries = [(r, doc, places) for r, v in several for doc, places in [(v[1], v[2]), *v[3:]]]
    data = np.frombuffer(b"".join(e[0] for e in entries), np.uint8)
    sizes = np.array([len(e[0]) for e in entries])
    windows = sizes - LENGTH + 1
    offset = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(entries)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    group = equal_windows(data, offset[owner] + inside)
    ids = np.array([e[1][0] for e in entries], np.int64)[owner]
    ranked = np.lexsort((ids, group))
    fresh = np.concatenate([[True], np.diff(group[ranked]) != 0])
    least = np.empty(len(ids), np.int64)
    least[ranked] = ids[ranked][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    hit = np.flatnonzero(ids > least)
    if not len(hit):
        return
    # neighbouring windows of a run become one interval
    cut = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)])
    begin = hit[cut]
    end = hit[np.append(np.flatnonzero(cut)[1:] - 1, len(hit) - 1)]
    for b, e in zip(begin.tolist(), end.tolist()):
        _, doc, places = entries[owner[b]]
        for p in places:
            lost.add(doc, p + int(inside[b]), p + int(inside[e]) + LENGTH)


def _by_content(open_runs: DataFrame) -> DataFrame:
    """Decides single windows by their bytes; for hashes with too many different runs."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, _, run, places in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.arange(len(run) - LENGTH + 1)
                for p in np.frombuffer(places, np.int32).tolist():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([run[i : i + LENGTH] for i in at.tolist()], pa.binary()),
                            pa.array([doc] * len(at), pa.int64()),
                            pa.array([tag] * len(at), pa.int64()),
                            pa.array(at + p, pa.int64()),
                        ],
                        names=["w", "doc", "tag", "at"],
                    )

    windows = store_table(
        open_runs.mapInArrow(split, "w binary, doc long, tag long, at long"), "suffix-windows"
    )
    least = store_table(windows.groupBy("w").agg(F.min("doc").alias("least")), "suffix-least")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.array([p, p + LENGTH], np.int32).tobytes() for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pairs, pa.binary())],
                names=["doc", "tag", "places"],
            )

    hits = windows.join(least, "w").where("doc > least").select("doc", "tag", "at")
    return hits.mapInArrow(placed, "doc long, tag long, places binary")


def _kept(raw: bytes, pairs: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and the rest, for overlapping intervals in any order."""
    if not len(pairs):
        return 0, 0, raw
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def removals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP
) -> DataFrame:
    """``(__doc, __tag, __places)`` of the documents that lose bytes: lists of offset pairs, int32.

    ``__tag`` is a hash of the text, so that rows with one id keep their own places.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << min(max(8 * total // RUN_BYTES, BLOCK).bit_length(), MAX_CELLS.bit_length() - 1)
    # one bit per cell, MAX_CELLS at most
    bits = spark.sparkContext.broadcast(repeat_filter(rows.select("text"), cells))
    spread = F.coalesce("key", F.xxhash64("doc"))
    found = store_table(
        _candidates(rows, bits, cells)
        .repartition(spread)
        .sortWithinPartitions("key")
        .mapInArrow(lambda batches: _decided(batches, max_group), OUT),
        "suffix-found",
    )
    lost = found.where("key is null").select("doc", "tag", "places")
    open_runs = found.where("key is not null")
    if not open_runs.isEmpty():
        lost = lost.unionByName(_by_content(open_runs))
    return lost.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(
        F.collect_list("places").alias("__places")
    )


def remove_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (what is left)."""
    keep = docs.columns if keep is None else keep
    lost = removals(docs, id_col, text_col, max_group)
    tagged = docs.withColumns(
        {"__doc": F.col(id_col).cast("long"), "__tag": F.xxhash64(text_col), "__whole": F.col(text_col)}
    )
    joined = tagged.select(*keep, "__doc", "__tag", "__whole").join(lost, ["__doc", "__tag"], "left")
    packed = F.struct("__whole", "__places")
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_bytes", T.BinaryType()),
    ]

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            out: list[list] = [[], [], [], []]
            for row in column.to_pylist():
                raw = (row["__whole"] or "").encode()
                parts = [np.frombuffer(p, np.int32) for p in row["__places"] or []]
                pairs = np.concatenate(parts).reshape(-1, 2) if parts else np.empty((0, 2), np.int32)
                removed, spans, rest = _kept(raw, pairs)
                for values, value in zip(out, (len(raw), removed, spans, rest)):
                    values.append(value)
            types = [pa.int64()] * 3 + [pa.binary()]
            return [pa.array(v, t) for v, t in zip(out, types)]

        return run

    return with_text_columns(joined.withColumn("__packed", packed), "__packed", fields, make, keep)


def digests(removed: DataFrame) -> DataFrame:
    """The remaining bytes as their SHA-256."""
    return removed.withColumn("kept_sha256", F.sha2("kept_bytes", 256)).drop("kept_bytes")

