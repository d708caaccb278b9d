"""Hard negatives per anchor and positive, by lists that anchor clusters share (MAXIMUS style).

1. Anchors are taken in groups of bounded size (``GROUP_ROWS``, ``GROUP_BYTES``): the driver
   clusters one group by direction (spherical k-means) and broadcasts it.  A cluster keeps the
   largest angle between its centre and a member; large clusters are walked in parts.
2. A task holds its candidates in chunks.  For each cluster a chunk is sorted once by the
   angular upper bound ``|x| cos(max(0, angle(x, centre) - largest member angle))``.  Every
   member walks that list, in strides, until ``|anchor| * bound`` of the next entry is below
   what it still needs: then no later entry can change its result, so the end is certified.
3. The first walk finds the best positives, the second the best negatives below each positive;
   what a task has found already raises the bar for its later chunks.  A task returns at most
   ``positives`` rows per anchor, and ``positives * negatives`` in the second walk; Spark ranks
   these.  Candidates are never shuffled, and no pair of rows is ever a row.

Scores are exact integers: products of norms below 2^53 are multiplied as doubles, larger ones
as Python integers, cut to the range of a long (scaled components are cut at 1e100 before).

Defined results: rows with a null id, label or vector, or a null or non-finite component, take
no part.  Missing components of shorter vectors count as zero; an empty vector scores zero.
Ties are ordered by the smaller id.  Rows that repeat an id are rows of their own: each is an
anchor and a candidate of the others.  An anchor without positives, or a positive without
negatives in its range, gives no row; an empty table gives an empty result.  Further columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.session import configure, scratch_path, store_table

#: bounds of one group of anchors (broadcast) and of one chunk of candidates
GROUP_ROWS = 8_192
GROUP_BYTES = 32 << 20
CHUNK_ROWS = 16_384
CHUNK_BYTES = 32 << 20
MEMBERS = 1_024
STRIDES = (64, 1_024)  # first and longest
CLUSTERS = 64
ROUNDS = 8

_EDGE = (1 << 63) - 2  # largest score; below its negative stands "none"
_NONE = -(1 << 63) + 1
_EXACT = float(1 << 53)
_LARGEST = 1e100  # scaled component

SCHEMA = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


def clusters_of(vectors: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``(centres, number of each row's centre)``: unit centres by spherical k-means."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    count = int(np.clip(np.sqrt(len(unit) / 2), 1, CLUSTERS))
    picks = np.random.default_rng(seed).choice(len(unit), count, replace=False)
    centres = unit[np.sort(picks)].copy()
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres, np.argmax(unit @ centres.T, axis=1)


def _angles(vectors: np.ndarray, norm: np.ndarray, centre: np.ndarray) -> np.ndarray:
    cosine = (vectors @ centre) / np.where(norm > 0, norm, 1)
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass
class Group:
    """Anchors of one pass with their clusters; ``scores`` are those of their positives."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    centres: np.ndarray = field(init=False)
    parts: list[tuple[int, np.ndarray, float]] = field(init=False)  # centre, members, widest angle
    norms: np.ndarray = field(init=False)
    positives: np.ndarray | None = None
    scores: np.ndarray | None = None

    def __post_init__(self):
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.centres, own = clusters_of(self.vectors)
        self.parts = []
        for number, centre in enumerate(self.centres):
            members = np.flatnonzero(own == number)
            angle = _angles(self.vectors[members], self.norms[members], centre)
            # of a large cluster, members at like angles share a list
            members, angle = members[np.argsort(angle)], np.sort(angle)
            for at in range(0, len(members), MEMBERS):
                self.parts.append((number, members[at : at + MEMBERS], float(angle[at : at + MEMBERS][-1])))


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole-numbered rows as exact longs; ``bound``: largest product of norms."""
    if bound < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, -_EDGE, _EDGE).astype(np.int64)


class Best:
    """The ``size`` best ``(score, id)`` per slot, higher scores and then smaller ids first."""

    def __init__(self, slots: int, size: int):
        self.score = np.full((slots, size), _NONE, np.int64)
        self.id = np.full((slots, size), np.iinfo(np.int64).max, np.int64)

    def beats(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the ``len(slots) x len(ids)`` scores would enter."""
        least, last = self.score[slots, -1:], self.id[slots, -1:]
        return (score > least) | ((score == least) & (ids[None, :] < last))

    def put(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Entries one by one, a slot any number of times."""
        touched, slot = np.unique(slots, return_inverse=True)
        size = self.score.shape[1]
        slot = np.concatenate([np.repeat(np.arange(len(touched)), size), slot])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, np.arange(len(touched)))[slot]
        first = place < size
        self.score[touched[slot[first]], place[first]] = score[first]
        self.id[touched[slot[first]], place[first]] = ids[first]

    def found(self, slot: int) -> tuple[list[int], list[int]]:
        there = self.score[slot] > _NONE
        return self.score[slot][there].tolist(), self.id[slot][there].tolist()


class Positives:
    """What the first walk needs and keeps."""

    def __init__(self, group: Group, size: int):
        self.group, self.best = group, Best(len(group.ids), size)

    def need(self, members: np.ndarray) -> np.ndarray:
        return self.best.score[members, -1]

    def see(self, members, score, rows, ids, labels) -> None:
        same = self.group.labels[members][:, None] == labels[None, :]
        other = self.group.rows[members][:, None] != rows[None, :]
        who, which = np.nonzero(same & other & self.best.beats(members, score, ids))
        if len(who):
            self.best.put(members[who], score[who, which], ids[which])


class Negatives:
    """What the second walk needs and keeps; slot ``anchor * positives + place``."""

    def __init__(self, group: Group, size: int, low: int, high: int):
        self.group, self.width = group, group.scores.shape[1]
        exact = group.scores.astype(object)
        self.least = (-((-low * exact) // high)).astype(np.int64)
        # a missing positive, or a score whose range is empty
        self.open = (group.scores > _NONE) & (self.least <= group.scores)
        self.best = Best(len(group.ids) * self.width, size)

    def _slots(self, members: np.ndarray) -> np.ndarray:
        return members[:, None] * self.width + np.arange(self.width)[None, :]

    def need(self, members: np.ndarray) -> np.ndarray:
        bar = np.maximum(self.least[members], self.best.score[self._slots(members), -1])
        return np.where(self.open[members], bar, _EDGE + 1).min(axis=1)

    def see(self, members, score, rows, ids, labels) -> None:
        differ = self.group.labels[members][:, None] != labels[None, :]
        for place in range(self.width):
            upper = self.group.scores[members, place][:, None]
            lower = np.where(self.open[members, place], self.least[members, place], _EDGE + 1)[:, None]
            slots = members * self.width + place
            fits = differ & (score <= upper) & (score >= lower)
            who, which = np.nonzero(fits & self.best.beats(slots, score, ids))
            if len(who):
                self.best.put(slots[who], score[who, which], ids[which])


def walk(group: Group, kept, rows, ids, labels, vectors) -> int:
    """Shows every member of every cluster the head of its list that can matter to it.

    Returns the number of scores computed.
    """
    norm = np.linalg.norm(vectors, axis=1)
    widest, seen = float(norm.max(initial=0)), 0
    last, angle = -1, None
    for number, members, spread in group.parts:
        if number != last:
            last, angle = number, _angles(vectors, norm, group.centres[number])
        bound = norm * np.cos(np.maximum(angle - spread, 0))
        order = np.argsort(-bound, kind="stable")
        at, stride, active = 0, STRIDES[0], members
        while at < len(order):
            # room for the rounding of angles and norms; scores are whole numbers
            reach = group.norms[active] * bound[order[at]] + 1e-7 * group.norms[active] * widest + 0.5
            active = active[reach >= kept.need(active)]
            if not len(active):
                break
            part = order[at : at + stride]
            limit = float(group.norms[active].max() * norm[part].max())
            score = products(group.vectors[active], vectors[part], limit)
            kept.see(active, score, rows[part], ids[part], labels[part])
            seen += score.size
            at, stride = at + stride, min(2 * stride, STRIDES[1])
    return seen


def _matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """Vectors as rows of ``dim`` whole-numbered doubles."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    flat = np.clip(flat, -_LARGEST, _LARGEST)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scan(batches: Iterator[pa.RecordBatch], group: Group, kept, dim: int, scale: float) -> None:
    """Walks the candidates ``(row, id, label, vector)`` of a task, chunk by chunk."""
    most = max(min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(dim, 1))), 1)
    held, size = [], 0

    def flush():
        columns = [np.concatenate([h[i] for h in held]) for i in range(4)]
        for at in range(0, len(columns[0]), most):
            walk(group, kept, *(c[at : at + most] for c in columns))

    for batch in batches:
        row, ident, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append((row, ident, label, _matrix(batch.column(3), dim, scale)))
        size += len(row)
        if size >= most:
            flush()
            held, size = [], 0
    if size:
        flush()


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column) -> DataFrame:
    """``(row, id, label, vector, is_anchor)`` of the rows that take part, stored."""
    finite = F.forall(
        F.col(vector_col),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    whole = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    return store_table(
        rows.where(whole & finite).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("id"),
            F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).alias("vector"),
            F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        ),
        "negative-rows",
    )


def _ranked(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The best ``size`` of the exploded ``(scores, ids)`` per ``keys``, numbered from 1."""
    each = found.select(*found.drop("scores", "ids").columns, F.explode(F.arrays_zip("scores", "ids")).alias("hit"))
    order = Window.partitionBy(*keys).orderBy(F.col("hit.scores").desc(), F.col("hit.ids"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: float = 256.0,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The columns of ``SCHEMA``: for each anchor's best positives of its own label the best rows
    of other labels with ``low * positive_score <= high * negative_score <= high * positive_score``.
    """
    spark = rows.sparkSession
    configure(spark)
    table = usable(rows, id_col, vector_col, label_col, anchor)
    dim = table.agg(F.max(F.size("vector"))).first()[0] or 0
    most = max(min(group_rows, GROUP_BYTES // (8 * max(dim, 1))), 1)
    anchors = table.where("is_anchor")
    groups = -(-anchors.count() // most)
    candidates = table.select("row", "id", "label", "vector")
    parts = []
    for number in range(groups):
        mine_ = F.pmod(F.xxhash64("row"), F.lit(groups)) == number
        held = anchors.where(mine_).select("row", "id", "label", "vector").toArrow()  # about ``most`` rows
        if not held.num_rows:
            continue
        held = held.combine_chunks()
        group = Group(
            *(held.column(i).to_numpy() for i in range(3)),
            _matrix(held.column(3).chunk(0), dim, scale),
        )
        path = scratch_path(spark, "negatives")
        _group(candidates, group, dim, scale, positives, negatives, low, high).write.parquet(path)
        parts.append(path)
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*parts)


def _group(candidates, group: Group, dim, scale, positives, negatives, low, high) -> DataFrame:
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(group)  # GROUP_ROWS and GROUP_BYTES bound it

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Positives(shared.value, positives)
        _scan(batches, shared.value, kept, dim, scale)
        out = [(i, *kept.best.found(i)) for i in range(len(shared.value.ids))]
        yield _batch([o for o in out if o[1]], ["slot", "scores", "ids"])

    found = candidates.mapInArrow(first, "slot long, scores array<long>, ids array<long>")
    best = _ranked(found, ["slot"], positives).select("slot", "rank", "hit.*").toArrow()
    shape = (len(group.ids), positives)
    group.scores, group.positives = np.full(shape, _NONE, np.int64), np.full(shape, -1, np.int64)
    slot, place = best.column(0).to_numpy(), best.column(1).to_numpy() - 1
    group.scores[slot, place] = best.column(2).to_numpy()
    group.positives[slot, place] = best.column(3).to_numpy()
    again = spark.sparkContext.broadcast(group)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = again.value
        kept = Negatives(own, negatives, low, high)
        _scan(batches, own, kept, dim, scale)
        out = [(i, *kept.best.found(i)) for i in range(own.scores.size)]
        yield _batch([o for o in out if o[1]], ["slot", "scores", "ids"])

    ranked = _ranked(
        candidates.mapInArrow(second, "slot long, scores array<long>, ids array<long>"), ["slot"], negatives
    ).select("slot", "rank", F.col("hit.scores").alias("score"), F.col("hit.ids").alias("id"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = again.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            who, place = at // positives, at % positives
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own.ids[who]),
                    pa.array(own.positives[who, place]),
                    batch.column(1),
                    batch.column(3),
                    pa.array(own.scores[who, place]),
                    batch.column(2),
                ],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

    return ranked.mapInArrow(named, SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
