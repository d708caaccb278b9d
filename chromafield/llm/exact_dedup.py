"""Exact duplicates of whole texts by two passes over a Bloom filter.

Pass one turns every normalised text into a hash and counts, per filter cell, how many
documents hit it; cells hit twice make up the filter.  Pass two tests each document: one with
a cell that was hit once only is certainly unique and passes straight through.  Only the
possibly repeated rows are shuffled, and they are grouped by the full SHA-256, so a false
positive of the filter costs a little shuffle and never changes a result.

The filter is cut into blocks of 32,768 bits; both cells of a hash lie in one block, so a test
is one look-up.  At most ``MAX_BLOCKS`` blocks (32 MB) are broadcast.  That holds about 33
million documents at one false positive in twenty; above it the filter fills up, more
``(hash, id)`` rows (40 bytes each, never texts in ``verdicts``) are shuffled, and the results
stay the same.

Defined results: a null text counts as empty; only A-Z are lower-cased; the largest non-null id
of a group stays (null where a group has none); rows that repeat an id with an equal text are
one document, so ``verdicts`` gives all of them the same verdict and ``deduplicate`` returns one
of them.  An empty table gives an empty result; texts of any length are hashed whole.  Names that begin
with ``__`` are reserved.  Result columns replace input columns of the
same name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafield.session import configure, store_table

BLOCK_BITS = 32_768
MAX_BLOCKS = 8_192
DOCS_PER_BLOCK = 4_096
HASHES = 2  # cells per document


def normalised(text: str | Column) -> Column:
    """Null as empty, A-Z lower-cased, everything else as it is."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )


def digest(text: str | Column) -> Column:
    """SHA-256 (32 bytes) of the normalised text."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _number(sha: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(sha, start, size)), 16, 10).cast("long")


def _block(sha: Column, blocks: int) -> Column:
    return F.pmod(_number(sha, 1, 4), F.lit(blocks)).cast("int")


def _cells(sha: Column) -> list[Column]:
    return [F.pmod(_number(sha, 5 + 4 * i, 4), F.lit(BLOCK_BITS)) for i in range(HASHES)]


def repeat_filter(keys: DataFrame, sha: str, blocks: int) -> DataFrame:
    """Blocks ``(__block, __bits)`` of the cells that two or more rows of ``keys`` hit.

    Hits are summed before the exchange, so a group of copies is one row per task there.
    """
    cell = F.explode(F.array_distinct(F.array(*_cells(F.col(sha)))))
    return (
        keys.select(_block(F.col(sha), blocks).alias("__block"), cell.alias("__cell"))
        .groupBy("__block", "__cell")
        .count()
        .where("count > 1")
        .groupBy("__block")
        .agg(F.bitmap_construct_agg("__cell").alias("__bits"))
    )


def _tested(rows: DataFrame, sha: str, cells: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``__maybe``: false only if no other row has this hash."""

    def hit(cell: Column) -> Column:
        at = F.floor(cell / 8).cast("int") + 1
        byte = F.conv(F.hex(F.substring(F.col("__bits"), at, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(cell, F.lit(8)).cast("int")) == 1

    found = rows.withColumn("__block", _block(F.col(sha), blocks)).join(
        F.broadcast(cells), "__block", "left"
    )
    first, second = (hit(cell) for cell in _cells(F.col(sha)))
    return found.withColumn("__maybe", F.coalesce(first & second, F.lit(False))).drop(
        "__block", "__bits"
    )


def _prepared(docs: DataFrame, id_col: str, text_col: str, least: int):
    """Stored keys of all rows, the filter with its size, and the stored groups of the rows that
    pass it, from ``least`` rows on."""
    spark = docs.sparkSession
    configure(spark)
    keys = store_table(
        docs.select(F.col(id_col).alias("__id"), digest(text_col).alias("__sha")), "exact-keys"
    )
    rows = keys.count()
    blocks = max(1, min(MAX_BLOCKS, -(-rows // DOCS_PER_BLOCK)))
    cells = store_table(repeat_filter(keys, "__sha", blocks), "exact-filter")
    groups = store_table(
        _tested(keys, "__sha", cells, blocks)
        .where("__maybe")
        .groupBy("__sha")
        .agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
        .where(F.col("__size") >= least),
        "exact-groups",
    )
    return keys, cells, blocks, groups


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` per row of ``docs``."""
    keys, cells, blocks, groups = _prepared(docs, id_col, text_col, 2)
    tested = _tested(keys, "__sha", cells, blocks)
    single = tested.where("not __maybe").select(
        "*", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__size")
    )
    repeated = tested.where("__maybe").join(groups, "__sha", "left")
    # a false positive has no group: it is its own
    repeated = repeated.select(
        "__id",
        "__sha",
        "__maybe",
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")).alias("__keep"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("__size"),
    )
    return single.unionByName(repeated).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    _, cells, blocks, groups = _prepared(docs, id_col, text_col, 1)
    tested = _tested(docs.withColumn("__sha", digest(text_col)), "__sha", cells, blocks)
    single = tested.where("not __maybe")
    # rows meet their group by hash and id, so that copies do not gather in one task
    keep = groups.select(F.col("__sha").alias("__group"), "__keep")
    wins = (F.col("__sha") == F.col("__group")) & F.col(id_col).eqNullSafe(F.col("__keep"))
    winners = tested.where("__maybe").join(keep, wins, "left_semi").dropDuplicates(["__sha", id_col])
    return single.select(docs.columns).unionByName(winners.select(docs.columns))
