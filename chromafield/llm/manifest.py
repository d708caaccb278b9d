"""A Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and proofs.

Leaves of a group ascend by id; while several nodes remain, every three consecutive ones are
hashed into one.  The groups' roots, in order of the group (null first, by bytes), form a tree of
the same kind.  Hashes are SHA-256 over concatenated hex digests.

1. *Bitmap ranks* give each leaf its place without sorting leaves.  The ids of a group are one bit
   each, gathered by OR into containers of 1,024 ids (non-zero words only, with a mask).  A
   container holds a popcount directory, and its own place is a sum of counts over the
   containers before it, by three levels of directories, so that no window holds more than
   262,144 of them.  A leaf's place is its container's place plus the bits before its own.
2. *Slot arrays*: leaves meet by ``(group, place div SPAN)``; an entry goes to its slot, and
   ``LEVELS`` levels are hashed in the array at once.  One row per array goes on to the next round.
3. *Proofs* come down the same arrays: an array's row gets the path from its root upwards, and
   each entry puts the levels inside the array before it.

Defined results: a null id comes first in its group, and its rows are never treated as altered by
the query; rows that repeat an id follow one another by their leaf hash; equal rows are leaves of
their own.  A group of one leaf has that leaf as its root, and a table of one group has that
group's root.  An empty table gives an empty result.  Further columns of the input are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.session import configure, store_table

ARITY = 3
LEVELS = 7  # levels of one slot array
SPAN = ARITY**LEVELS
BITS = 10  # ids of a container
WORDS = (1 << BITS) // 64
FAN = 18  # bits of one directory level
ARRAY_ROWS = 64  # slot arrays in an Arrow batch

#: left and right siblings of a node, in turn, from the leaf upwards
PROOF = "array<string>"


def encoded(column: str | Column) -> Column:
    """``-`` for null, else the UTF-8 length of the value as text, a colon, and the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str | Column]) -> Column:
    """The hash of a row: hex SHA-256 over its encoded columns."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def digest(*hexes: str) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def fold(node: str, proof: list[str]) -> str:
    """The root that a leaf and the siblings of its path lead to."""
    for at in range(0, len(proof), 2):
        node = digest(proof[at], node, proof[at + 1])
    return node


def height(nodes: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys of ``a`` stay."""
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(other, on, how).drop(*[f"__{k}" for k in keys])


def containers(leaves: DataFrame) -> DataFrame:
    """``(part, high, n, mask, words, before)`` of ``leaves (part, id)``: the bitmap of each 1,024
    ids of a part as its non-zero words, with the number of bits before each of all words."""
    place = F.col("id").bitwiseAND((1 << BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    word = F.shiftright(place, 6)
    merged = leaves.groupBy("part", F.shiftright("id", BITS).alias("high")).agg(
        F.count(F.lit(1)).alias("n"),
        # a null id is the one bit of a container of its own
        *[
            F.bit_or(F.when(word.eqNullSafe(i), bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}")
            for i in range(WORDS)
        ],
    )
    words = [F.col(f"w{i}") for i in range(WORDS)]
    before, total = [], F.lit(0)
    for w in words:
        before.append(total)
        total = total + F.bit_count(w)
    mask = F.lit(0)
    for i, w in enumerate(words):
        mask = mask + F.when(w != 0, 1 << i).otherwise(0)
    return merged.select(
        "part",
        "high",
        "n",
        F.when(F.col("high").isNull(), 1).otherwise(total).alias("ids"),
        mask.alias("mask"),
        F.filter(F.array(*words), lambda w: w != 0).alias("words"),
        F.array(*before).alias("before"),
    )


def _running(keys: list[str], order: str) -> Column:
    """Sum of ``n`` over the rows before."""
    window = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def located(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``base``: the number of the part's rows in the containers before."""
    named = boxes.withColumns({"mid": F.shiftright("high", FAN), "top": F.shiftright("high", 2 * FAN)})
    mids = named.groupBy("part", "top", "mid").agg(F.sum("n").alias("n"))
    tops = mids.groupBy("part", "top").agg(F.sum("n").alias("n"))
    tops = tops.select("part", "top", _running(["part"], "top").alias("top_base"))
    mids = mids.select("part", "top", "mid", _running(["part", "top"], "mid").alias("mid_base"))
    mids = _same(mids, tops, ["part", "top"]).select(
        "part", "mid", (F.col("mid_base") + F.col("top_base")).alias("mid_base")
    )
    own = named.withColumn("base", _running(["part", "mid"], "high"))
    return _same(own, mids, ["part", "mid"]).withColumn("base", F.col("base") + F.col("mid_base")).drop(
        "mid", "top", "mid_base"
    )


def _bits_before() -> Column:
    """Ids of the leaf's container that are below its own, from mask, words and directory."""
    return F.expr(
        f"""case when id is null then 0 else
            before[cast(shiftright(id & {(1 << BITS) - 1}, 6) as int)] + bit_count(
                words[bit_count(mask & ~shiftleft(-1, cast(shiftright(id & {(1 << BITS) - 1}, 6) as int)))]
                & ~shiftleft(-1L, cast(id & 63 as int))) end"""
    )


def ranked_groups(sizes: DataFrame) -> DataFrame:
    """``sizes (part, n)`` with ``tree``: the place of the part, null first, then by bytes."""
    ordered = sizes.orderBy(F.col("part").asc_nulls_first()).withColumns(
        {"task": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    )
    ordered = store_table(ordered, "manifest-groups")
    # one row per task
    tasks = ordered.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    tasks = tasks.select("task", _running([], "task").alias("start"))
    return ordered.join(tasks, "task").select("part", "n", (F.col("start") + F.col("at")).alias("tree"))


def _repeated(leaves: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ids that several rows of a part have: ``(part, high, extras)`` per container, the further
    rows of each of its ids, and ``(row, shift)``, a row's place among those of its id.

    Rows of one id are ordered by leaf.  Places come from counts per two bytes of the leaf, per
    leaf and input task, and per row of that task, so neither an id nor a leaf is one window.
    """
    crowded = boxes.where("n > ids").select("part", "high")
    near = leaves.select("part", "id", F.shiftright("id", BITS).alias("high"), "row", "leaf")
    near = _same(near, crowded, ["part", "high"])
    several = store_table(
        near.groupBy("part", "high", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "manifest-repeats"
    )
    low = F.coalesce(F.col("id").bitwiseAND((1 << BITS) - 1), F.lit(0).cast("long")).cast("int")
    extras = several.groupBy("part", "high").agg(
        F.collect_list(F.struct(low.alias("low"), (F.col("n") - 1).alias("more"))).alias("extras")
    )
    rows = _same(near, several.select("part", "id"), ["part", "id"]).withColumns(
        {"head": F.substring("leaf", 1, 2), "task": F.shiftright("row", 33)}
    )
    rows = store_table(rows, "manifest-repeated")
    counts = rows.groupBy("part", "id", "head", "leaf", "task").agg(F.count(F.lit(1)).alias("n"))
    heads = counts.groupBy("part", "id", "head").agg(F.sum("n").alias("n"))
    heads = heads.select("part", "id", "head", _running(["part", "id"], "head").alias("first"))
    within = Window.partitionBy("part", "id", "head").orderBy("leaf", "task")
    tasks = counts.withColumn(
        "second", F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ).drop("n")
    starts = _same(tasks, heads, ["part", "id", "head"])
    last = F.row_number().over(Window.partitionBy("part", "id", "leaf", "task").orderBy("row")) - 1
    placed = _same(rows.withColumn("third", last).drop("head"), starts, ["part", "id", "leaf", "task"])
    return extras, placed.select("row", (F.col("first") + F.col("second") + F.col("third")).alias("shift"))


def places(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves (row, part, id, leaf, ...)`` with ``tree, n, place``, and the stored groups."""
    boxes = store_table(containers(leaves), "manifest-bitmaps")
    groups = store_table(
        ranked_groups(boxes.groupBy("part").agg(F.sum("n").alias("n"))), "manifest-trees"
    )
    found = located(boxes)
    crowded = not boxes.where("n > ids").isEmpty()
    keyed = leaves.withColumn("high", F.shiftright("id", BITS))
    extra, shift = F.lit(0), F.lit(0)
    if crowded:
        extras, shifts = _repeated(leaves, boxes)
        found = _same(found, extras, ["part", "high"], "left")
        keyed = keyed.join(shifts, "row", "left")
        extra = F.expr(
            f"""coalesce(aggregate(filter(extras, e -> e.low < (id & {(1 << BITS) - 1})),
                0L, (a, e) -> a + e.more), 0L)"""
        )
        shift = F.coalesce("shift", F.lit(0))
    found = _same(found.drop("n", "ids"), groups, ["part"])
    joined = _same(keyed, found, ["part", "high"])
    place = F.col("base") + _bits_before() + extra + shift
    return joined.select(*leaves.columns, "tree", "n", place.alias("place")), groups


def _reduced(hashes: list[str], levels: int) -> list[list[str]]:
    """Nodes of each level, from ``hashes`` upwards."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def _sides(tree: list[list[str]], slot: int) -> list[str]:
    """Left and right siblings of a slot, level by level."""
    proof = []
    for nodes in tree[:-1]:
        first = slot - slot % ARITY
        proof += ["".join(nodes[first:slot]), "".join(nodes[slot + 1 : first + ARITY])]
        slot //= ARITY
    return proof


def _slots(column: pa.Array, field: str) -> Iterator[tuple[np.ndarray, list]]:
    """``(slots, values)`` of each array of entries."""
    offsets, flat = column.offsets.to_numpy(), column.flatten()
    slots, values = flat.field("slot").to_numpy(), flat.field(field).to_pylist()
    for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0]):
        yield slots[a:b], values[a:b]


def _placed(slots: np.ndarray, values: list) -> list[str]:
    hashes: list = [None] * len(slots)
    for slot, value in zip(slots.tolist(), values):
        hashes[slot] = value.hex()
    return hashes


def arrays(nodes: DataFrame, entry: list[str]) -> DataFrame:
    """Slot arrays ``(tree, n, block, entries)`` of ``nodes (tree, n, place, hash)``; ``n`` counts
    the nodes of the tree's level, and ``entry`` names what an entry holds."""
    slot = F.pmod("place", F.lit(SPAN)).cast("int").alias("slot")
    return nodes.groupBy("tree", "n", F.expr(f"place div {SPAN}").alias("block")).agg(
        F.collect_list(F.struct(slot, *entry)).alias("entries")
    )


def climb(filled: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of every round, the lowest first, and ``(tree, hash)`` of the roots.

    ``most``: nodes of the largest tree.
    """

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for size, (slots, values) in zip(batch.column(1).to_pylist(), _slots(batch.column(3), "hash")):
                levels = min(LEVELS, height(size))
                roots.append(bytes.fromhex(_reduced(_placed(slots, values), levels)[-1][0]))
            size = [-(-n // SPAN) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), batch.column(2), pa.array(roots, pa.binary())],
                names=["tree", "n", "place", "hash"],
            )

    rounds = [filled]
    while True:
        entries = F.arrays_zip("entries.slot", "entries.hash").cast("array<struct<slot: int, hash: binary>>")
        narrow = rounds[-1].select("tree", "n", "block", entries.alias("entries"))
        nodes = narrow.mapInArrow(up, "tree long, n long, place long, hash binary")
        most = -(-most // SPAN)
        if most <= 1:
            return rounds, store_table(nodes.select("tree", "hash"), "manifest-roots")
        rounds.append(store_table(arrays(nodes, ["hash"]), "manifest-level"))


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``(tree, block, proof, top)`` for the arrays of the lowest round.

    ``above`` holds ``(tree, proof, top)``: the path that goes on from each tree's root.
    """

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            columns = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
            for tree, size, block, proof, top, (slots, values) in zip(*columns, _slots(batch.column(3), "hash")):
                levels = _reduced(_placed(slots, values), min(LEVELS, height(size)))
                for slot in range(len(slots)):
                    out[0].append(tree)
                    out[1].append(block * SPAN + slot)
                    out[2].append(_sides(levels, slot) + proof)
                    out[3].append(top)
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, types)], names=["tree", "block", "proof", "top"]
            )

    path = above.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(rounds[1:]):
        joined = level.join(path, ["tree", "block"]).select("tree", "n", "block", "entries", "proof", "top")
        path = store_table(
            joined.mapInArrow(down, f"tree long, block long, proof {PROOF}, top string"), "manifest-paths"
        )
    return path


def manifest(
    docs: DataFrame,
    leaf_hash: Column,
    presented: Column | None = None,
    id_col: str = "doc_id",
    group_col: str = "source",
) -> DataFrame:
    """``id_col, leaf, subroot, root, proof, folded_root`` per row of ``docs``.

    ``leaf_hash`` is the row's hex digest and ``presented`` the one that is folded with the
    siblings of its leaf (default, and where null: its own).
    """
    spark = docs.sparkSession
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARRAY_ROWS))
    given = leaf_hash if presented is None else F.coalesce(presented, leaf_hash)
    leaves = store_table(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(group_col).cast("string").alias("part"),
            F.col(id_col).cast("long").alias("id"),
            F.unhex(leaf_hash).alias("leaf"),
            F.unhex(given).alias("given"),
        ),
        "manifest-leaves",
    )
    placed, groups = places(leaves)
    filled = store_table(
        arrays(placed.withColumn("hash", F.col("leaf")), ["hash", "given", "id"]), "manifest-slots"
    )
    count, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    rounds, subroots = climb(filled, most or 0)
    nodes = subroots.select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(count).cast("long").alias("n"),
        F.col("tree").alias("place"),
        "hash",
    )
    over, roots = climb(store_table(arrays(nodes, ["hash"]), "manifest-tree"), count)
    found = roots.select(F.lower(F.hex("hash")).alias("root")).head()  # one row
    root = found.root if found else ""
    # the paths of the groups' roots, then those of the arrays of leaves
    start = spark.createDataFrame([(0, [], "")], f"tree long, proof {PROOF}, top string")
    group_paths = descend([over[0], *over], start).select(F.col("block").alias("tree"), "proof")
    tops = subroots.select("tree", F.lower(F.hex("hash")).alias("top"))
    paths = descend(rounds, group_paths.join(tops, "tree").select("tree", "proof", "top"))

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "leaf", "subroot", "proof", "folded_root"]
        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            entries, flat = batch.column(1), batch.column(1).flatten()
            given, ids = flat.field("given").to_pylist(), flat.field("id").to_pylist()
            at = 0
            columns = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for size, proof, top, (slots, values) in zip(*columns, _slots(entries, "hash")):
                levels = _reduced(_placed(slots, values), min(LEVELS, height(size)))
                out: list[list] = [[], [], [], [], []]
                for k, slot in enumerate(slots.tolist()):
                    path = _sides(levels, slot) + proof
                    row = (ids[at + k], levels[0][slot], top, path, fold(given[at + k].hex(), path))
                    for column, value in zip(out, row):
                        column.append(value)
                at += len(slots)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    joined = filled.join(paths, ["tree", "block"]).select("n", "entries", "proof", "top")
    out = joined.mapInArrow(
        proven, f"id long, leaf string, subroot string, proof {PROOF}, folded_root string"
    )
    return out.select(
        F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof", "folded_root"
    )


def digests(proven: DataFrame) -> DataFrame:
    """The proof as its SHA-256, and whether the folded root is the root."""
    return proven.withColumns(
        {
            "proof_sha256": F.sha2(F.array_join("proof", ""), 256),
            "verified": F.col("folded_root") == F.col("root"),
        }
    ).drop("proof")
