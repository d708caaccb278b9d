"""Shards by jump consistent hashing (Lamping and Veach, 2014), as Spark expressions only.

The 64-bit key is the head of the MD5 of the id, so a row's shard depends on its id and on the
number of shards alone: no ring table exists, and one more shard takes rows only into itself.
The published generator is ``key = key * A + 1 mod 2**64``; its i-th state is
``key * A**i + C(i)``, so all steps of a row are computed from literals, in 16- and 32-bit
parts because SQL integers do not wrap.

Defined results: a null id counts as the text ``null``; a null text has no bytes; rows that
repeat an id share its shard and get slots of their own; an empty table gives an empty result.  Names
that begin with ``__`` are reserved.  Result columns replace input columns
of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.session import configure

# fixed value: the generator of the published algorithm
MULTIPLIER = 2862933555777941757
MASK32 = (1 << 32) - 1
#: more jumps than this have a chance below 1e-12 for 100,000 shards; such rows take the long way
JUMPS = 64
#: ranges of a shard's rows that are numbered apart
RANGES = 4_096


def hash_key(key: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of the key's hash, as longs."""
    hexed = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    part = lambda start: F.conv(F.substring(hexed, start, 8), 16, 10).cast("long")
    return part(1), part(9)


def _steps(count: int) -> Column:
    """The constants of the generator's first states."""
    factor, addend, rows = 1, 0, []
    for _ in range(count):
        factor = factor * MULTIPLIER % (1 << 64)
        addend = (addend * MULTIPLIER + 1) % (1 << 64)
        rows.append(
            f"struct({factor >> 32}L as fh, {factor & MASK32}L as fl, "
            f"{addend >> 32}L as ah, {addend & MASK32}L as al)"
        )
    return F.expr(f"array({', '.join(rows)})")


def _low_product(x: Column, factor: Column) -> Column:
    """``x * factor mod 2**32`` of two 32-bit numbers."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * factor
    high = F.shiftright(x, 16) * factor
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK32))


def _jump(high: Column, low: Column, shards: int, steps: int) -> Column:
    """Last state ``(b, j)`` of the jumps; ``j >= shards`` where they have ended."""

    def draw(c: Column) -> Column:
        """Upper 31 bits of the generator's state."""
        p0 = low.bitwiseAND(F.lit(0xFFFF)) * c["fl"]
        p1 = F.shiftright(low, 16) * c["fl"]
        lower = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + c["al"]
        upper = (
            _low_product(high, c["fl"])
            + _low_product(low, c["fh"])
            + F.shiftright(p1, 16)
            + F.shiftright(lower, 32)
            + c["ah"]
        )
        return F.shiftright(upper.bitwiseAND(F.lit(MASK32)), 1)

    def jump(state: Column, c: Column) -> Column:
        wide = F.lit(float(1 << 31)) / (draw(c) + 1).cast("double")
        return F.when(state["j"] >= shards, state).otherwise(
            F.struct(
                state["j"].alias("b"),
                F.floor((state["j"] + 1).cast("double") * wide).cast("long").alias("j"),
            )
        )

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(_steps(steps), start, jump)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of ``key`` in ``0 .. shards - 1``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    high, low = hash_key(key)
    state = _jump(high, low, shards, min(shards, JUMPS))
    if shards > JUMPS:
        state = F.when(state["j"] >= shards, state).otherwise(_jump(high, low, shards, shards))
    return state["b"].cast("int")


def shard(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` and ``size, text_crc32, law, shard, slot, grown_shard``.

    Slots count from 0 without gaps in each shard.  A shard is not numbered by one task: its
    rows fall into ``RANGES`` ranges of the hash, each numbered apart on top of the counts of
    the ranges before it.  Those counts are at most ``shards * RANGES`` rows.
    """
    configure(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.withColumns(
        {
            "size": F.octet_length(text).cast("long") + 1,
            "text_crc32": F.crc32(text),
            "law": F.lit("key"),
            "shard": jump_hash(F.col(id_col), shards),
            "__range": F.pmod(hash_key(F.col(id_col))[1], F.lit(RANGES)).cast("int"),
            "grown_shard": jump_hash(F.col(id_col), shards + 1),
        }
    )
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        docs.select(
            jump_hash(F.col(id_col), shards).alias("shard"),
            F.pmod(hash_key(F.col(id_col))[1], F.lit(RANGES)).cast("int").alias("__range"),
        )
        .groupBy("shard", "__range")
        .count()
        .select(
            "shard", "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
        )
    )
    within = Window.partitionBy("shard", "__range").orderBy(id_col, "text_crc32", "size")
    numbered = keyed.withColumn("__at", F.row_number().over(within))
    # at most shards * RANGES rows of 16 bytes
    placed = numbered.join(F.broadcast(offsets), ["shard", "__range"])
    result = placed.withColumn("slot", F.col("__before") + F.col("__at") - 1)
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return result.select(*[c for c in docs.columns if c not in own], *own)
