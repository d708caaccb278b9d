"""Near-duplicates: one-permutation MinHash, banded buckets, stars and exact confirmation.

* A text's distinct word shingles become 64-bit hashes.  One permutation suffices: the head of
  a hash names its bin and the smallest hash of a bin stands for it.  An empty bin borrows from
  a full one, tried in an order of its own that is the same for all texts (optimal
  densification), so bins of two sets agree with the sets' similarity as probability.
* ``ROWS`` bins make a band, equal bands a bucket.  With 32 bands of 4 a pair of similarity 0.8
  shares no bucket with probability 5e-8.
* Equal sets are one class with its smallest id; only classes go on.
* A bucket is not paired out.  It gets one centre, at first its most typical member, and every
  member of another component one edge to it; ``TURNS`` centres follow each other.  Buckets
  whose members are then in one component are done, and big groups of copies are.  Elsewhere
  the members outside a bucket's largest component meet the members of other components, so
  that no pair that could still join two components is left out; only pairs go on whose
  sketches (a bit per shingle) leave the threshold within reach.
* Edges of sets whose sizes exclude the threshold are dropped, the rest confirmed on the full
  sets; what is already in one component is not compared again.
* Components come from alternating large and small stars.

Hot buckets and classes are joined as stored tables, which lets Spark split a hot key over
tasks; everything counted per group is summed before the exchange.

Defined results: words are split at ASCII white space and A-Z are lower-cased; a text of fewer
words than a shingle is one shingle; a null or empty text has none and is linked with nothing.
Rows with a null id are linked with nothing and stay (null component).  Rows that repeat an id
are one document: the links of any of them are its links, and they share the verdict.  An empty
table gives an empty result; long texts are shingled whole.  Names that begin with ``__`` are
reserved.  Result
columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.llm.rows import BATCH_ROWS, prepare, with_text_columns
from chromafield.session import store_table

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
SKETCH_BITS = 2_048
TURNS = 4  # centres that a bucket gets one after the other
MAX_CACHED_WORDS = 100_000
OUT_ROWS = 8_192  # shingles in an Arrow batch

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _orders() -> np.ndarray:
    """For each bin, the order in which it tries the others."""
    rng = np.random.default_rng(20170)
    return np.array([rng.permutation(BINS) for _ in range(BINS)])


ORDERS = _orders()


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Ascending distinct hashes of the text's shingles of ``size`` words."""
    # bytes split at and lower-case ASCII only
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    hashes = np.array(list(map(words.__getitem__, split)), np.uint64)
    size = min(size, len(hashes))
    value = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        value = (value ^ hashes[i : len(hashes) - size + 1 + i]) * _FACTOR + _MIX
    return np.unique(_mixed(value))


def signature(values: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin of an ascending non-empty set, empty bins filled."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    starts = np.searchsorted(values >> shift, np.arange(BINS, dtype=np.uint64))
    full = np.zeros(BINS, bool)
    inside = starts < len(values)
    full[inside] = (values[starts[inside]] >> shift) == np.flatnonzero(inside).astype(np.uint64)
    source = np.arange(BINS)
    if not full.all():
        empty = np.flatnonzero(~full)
        source[empty] = ORDERS[empty, full[ORDERS[empty]].argmax(1)]
    return values[starts[source]]


def band_keys(values: np.ndarray) -> np.ndarray:
    """One number per band, different between bands."""
    rows = signature(values).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed((key ^ rows[:, i]) * _FACTOR + _MIX)
    return key.view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """``SKETCH_BITS`` bits in words of 64: one is set if a shingle's hash ends in its number."""
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[(values % np.uint64(SKETCH_BITS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, text_col: str, size: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``__n`` (set size), ``__set`` (digest of the set), ``__bands``, ``__sketch``."""
    fields = [
        T.StructField("__n", T.LongType()),
        T.StructField("__set", T.BinaryType()),
        T.StructField("__bands", T.ArrayType(T.LongType())),
        T.StructField("__sketch", T.ArrayType(T.LongType())),
    ]

    def make():
        words = WordHashes()

        def run(texts: pa.Array) -> list[pa.Array]:
            sets = [shingle_set(t, size, words) for t in texts.to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [band_keys(s) if len(s) else None for s in sets]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]

        return run

    return with_text_columns(docs, text_col, fields, make, keep)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``links (a, b)``: the smallest node reachable."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = store_table(edges.where("a <> b").distinct(), "near-edges")
    while True:
        # done when every node has one edge, and that to a node without a smaller neighbour
        ends = edges.select(F.explode(F.expr("array(struct(a, 1 as up), struct(b as a, 0 as up))")).alias("x"))
        per_node = ends.groupBy("x.a").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("least"))
        if per_node.where("up > 1 or (up > 0 and least = 0)").isEmpty():
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        # large star: a node's larger neighbours move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "near-least")
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store_table(moved.where("a <> b").distinct(), "near-large")
        # small star: a node and its smaller neighbours move to the smallest of them
        least = store_table(large.groupBy("a").agg(F.min("b").alias("m")), "near-least")
        small = large.join(least, "a")
        edges = store_table(
            small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct(),
            "near-edges",
        )


def _merged(labels: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
    """``labels`` after the components in ``pairs (ca, cb)`` have been joined."""
    if pairs.isEmpty():
        return labels
    joined = store_table(components(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "near-joined")
    if labels is None:
        return joined
    # nodes without a link so far carried their own number
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return store_table(known.unionByName(fresh), "near-labels")


def _labelled(frame: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """``frame`` with the component of ``column``; nodes without a link are their own."""
    found = labels.select(F.col("node").alias(column), F.col("component").alias("__found"))
    return (
        frame.join(found, column, "left")
        .withColumn(name, F.coalesce("__found", column))
        .drop("__found")
    )


def _confirm(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The components ``(ca, cb)`` of the edges ``(a, b, ca, cb)`` whose full sets are similar."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    pairs = edges.join(one, "a").join(two, "b").select("ca", "cb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                for i, (ta, tb) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if tb != last[0]:  # rows of one centre come together
                        last = (tb, shingle_set(tb, size, words))
                    good[start + i] = similar(shingle_set(ta, size, words), last[1], percent)
            yield batch.select(["ca", "cb"]).filter(pa.array(good))

    return pairs.mapInArrow(run, "ca long, cb long")


def links(
    reps: DataFrame, texts_of, size: int, percent: int
) -> DataFrame | None:
    """Labels ``(node, component)`` of all linked nodes of ``reps (node, n, bands, sketch)``, or None.

    ``texts_of(nodes)`` gives the stored ``(node, text)`` of the nodes it is asked for.
    """
    members = reps.select("node", "n", F.explode("bands").alias("key"))
    shared = store_table(
        members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "near-shared"
    )
    buckets = store_table(members.join(shared, "key"), "near-buckets")
    if buckets.isEmpty():
        return None
    texts = texts_of(buckets.select("node").distinct())
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"

    # the first centre of a bucket is the member with the most company over all its buckets,
    # the most typical one and the same in most buckets of a group; later ones are random
    company = store_table(buckets.groupBy("node").agg(F.sum("size").alias("company")), "near-company")
    named = buckets.join(company, "node").select("key", "node", "n", "company", F.col("node").alias("component"))
    named, labels = store_table(named, "near-buckets"), None
    for turn in range(TURNS):
        rank = F.col("company") if turn == 0 else F.xxhash64("key", "node", F.lit(turn))
        centre = named.select("key", F.struct(rank.alias("rank"), "node", "n", "component").alias("c"))
        centres = store_table(
            centre.groupBy("key")
            .agg(F.max("c").alias("c"))
            .select("key", F.col("c.node").alias("b"), F.col("c.n").alias("m"), F.col("c.component").alias("cb")),
            "near-centres",
        )
        edges = store_table(
            named.join(centres, "key")
            .where(f"component <> cb and {fits}")
            .select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
            .groupBy("a", "b")
            .agg(F.count("*").alias("agree")),
            "near-stars",
        )
        # each node's most promising edge first; the others only where they join components
        best = edges.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("x")).select("a", "x.b")
        for chosen in (best, edges) if turn == 0 else (edges,):
            labels = _merged(labels, _tested(chosen.select("a", "b"), labels, texts, size, percent))
        if labels is not None:
            named = store_table(_labelled(named.drop("component"), labels, "node", "component"), "near-named")
        several = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        open_keys = store_table(several.where("least <> most").select("key"), "near-open")
        named = store_table(named.join(open_keys, "key", "left_semi"), "near-buckets")
        if named.isEmpty():
            return labels

    # what is left: buckets that still hold several components, such as texts around the same
    # boilerplate.  Of two similar sets each holds one of the other's rarest shingles, so members
    # meet by these: every one outside a shingle's largest component meets those of other
    # components, if their sketches allow a link
    open_nodes = store_table(named.select("node", "n", "component").distinct(), "near-open-nodes")
    rare = rarest(texts.join(open_nodes.select("node"), "node", "left_semi"), size, percent)
    named = store_table(rare.join(open_nodes, "node"), "near-rare")
    parts = named.groupBy("gram", "component").agg(F.count("*").alias("rows"))
    mains = store_table(
        parts.groupBy("gram")
        .agg(F.max(F.struct("rows", "component")).alias("main"), F.count("*").alias("several"))
        .where("several > 1")
        .select("gram", F.col("main.component").alias("main")),
        "near-mains",
    )
    sketches = reps.select("node", "sketch")
    apart = named.join(mains, "gram").withColumn("minor", F.col("component") != F.col("main"))
    live = store_table(apart.drop("main").join(sketches, "node"), "near-live")
    minor = live.where("minor").select(
        "gram",
        F.col("node").alias("b"),
        F.col("n").alias("m"),
        F.col("component").alias("cb"),
        F.col("place").alias("at"),
        F.col("sketch").alias("other"),
    )
    # the first shingle that two similar sets share has enough places behind it on both sides, so
    # a pair meets there and seldom again
    behind = f"(100 + {percent}) * (1 + least(n - place, m - at)) >= {percent} * (n + m)"
    pairs = (
        live.join(minor, "gram")
        .where(f"component <> cb and (not minor or node < b) and {fits} and {behind} and {_bound(percent)}")
        .select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
        .distinct()
    )
    return _merged(labels, _tested(store_table(pairs, "near-pairs"), labels, texts, size, percent))


def rarest(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``(node, gram, place)``: the shingles of ``texts (node, text)`` that a similar set cannot all lack.

    Shingles are ordered by their number of texts, then by hash.  A set of n has at least
    ceil(percent n / 100) of them in common with a similar one, so the n - ceil(percent n / 100) + 1
    first of both sets have one in common.  Shingles of one text only meet nothing.  ``place`` is a
    shingle's number in that order, from 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = shingle_set(text.as_py(), size, words).view(np.int64)
                for at in range(0, len(grams), OUT_ROWS):
                    part = grams[at : at + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), node, np.int64)),
                            pa.array(np.full(len(part), len(grams), np.int64)),
                            pa.array(part),
                        ],
                        names=["node", "n", "gram"],
                    )

    grams = store_table(texts.select("node", "text").mapInArrow(run, "node long, n long, gram long"), "near-grams")
    texts_with = grams.groupBy("gram").agg(F.count("*").alias("found"))
    by_rarity = Window.partitionBy("node").orderBy("found", "gram")
    least = F.expr(f"n - cast(ceil({percent} * n / 100.0) as long) + 1")
    ranked = grams.join(texts_with, "gram").withColumn("place", F.row_number().over(by_rarity))
    return ranked.where((F.col("place") <= least) & (F.col("found") > 1)).select("node", "gram", "place")


def _tested(edges: DataFrame, labels: DataFrame | None, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Components that confirmed ``edges (a, b)`` join; edges within one are not looked at."""
    if labels is None:
        named = edges.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    else:
        named = _labelled(_labelled(edges, labels, "a", "ca"), labels, "b", "cb")
    apart = named.where("ca <> cb").select("a", "b", "ca", "cb")
    return store_table(_confirm(apart, texts, size, percent), "near-links")


def _bound(percent: int) -> str:
    """Condition that every similar pair meets: a bit that only one sketch has is a shingle of
    its own, so the sets share at most its size less those."""
    own = " + ".join(f"bit_count(sketch[{i}] & ~other[{i}])" for i in range(SKETCH_BITS // 64))
    return f"(100 + {percent}) * least(n - ({own}), m) >= {percent} * (n + m)"


def verdicts(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    signed = store_table(signatures(narrow, "__text", size, ["__id"]), "near-signatures")
    usable = signed.where("__n > 0 and __id is not null")
    classes = store_table(
        usable.groupBy("__set")
        .agg(F.min("__id").alias("__first"), F.count("*").alias("__copies"))
        .where("__copies > 1")
        .select("__set", "__first"),
        "near-classes",
    )
    known = usable.join(classes, "__set", "left").withColumn("__rep", F.coalesce("__first", "__id"))
    reps = store_table(
        known.where("__id = __rep")
        .selectExpr("__rep as node", "__n as n", "__bands as bands", "__sketch as sketch"),
        "near-reps",
    )

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = narrow.select(F.col("__id").alias("node"), F.col("__text").alias("text"))
        return store_table(wanted.join(store_table(nodes, "near-nodes"), "node", "left_semi"), "near-texts")

    labels = links(reps, texts_of, size, percent)
    rep = F.when(F.col("__id").isNotNull(), F.coalesce("__first", "__id"))
    rows = signed.join(classes, "__set", "left").select("__id", "__n", rep.alias("__rep"))
    if labels is None:
        rows = rows.withColumn("__component", F.col("__rep"))
    else:
        rows = _labelled(rows, labels, "__rep", "__component")
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("__n").alias("n_shingles"),
        F.col("__component").alias("component_id"),
        (F.col("__component").isNull() | (F.col("__component") == F.col("__id"))).alias("kept"),
    )


def deduplicate(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per group, that with the smallest id, and all rows linked with nothing."""
    dropped = store_table(
        verdicts(docs, size, percent, id_col, text_col).where("not kept").select(id_col).distinct(),
        "near-dropped",
    )
    return docs.join(dropped, id_col, "left_anti").select(docs.columns)
