"""Bit masks, hashes and packed arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_source(hue_class: Column, device: Column) -> Column:
    """Hue class in the upper 8 of 32 bits, device number in the lower 24."""
    return F.shiftleft(hue_class.cast("long"), 24).bitwiseOR(
        device.cast("long").bitwiseAND(F.lit(0xFFFFFF).cast("long"))
    )


def unpack_source(source_id: Column) -> Column:
    wide = source_id.cast("long")
    return F.struct(
        F.shiftrightunsigned(wide, 24).bitwiseAND(F.lit(0xFF).cast("long")).alias("hue_class"),
        wide.bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("device"),
    )


def mask_has(mask: Column, bit: Column | int) -> Column:
    return F.getbit(mask.cast("long"), F.lit(bit) if isinstance(bit, int) else bit) == 1


def mask_count(mask: Column) -> Column:
    return F.bit_count(mask.cast("long"))


def mask_members(mask: Column, width: int = 64) -> Column:
    """Array of the set bit positions."""
    wide = mask.cast("long")
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.getbit(wide, b) == 1)


def mask_bits(member: Column) -> Column:
    """One-bit mask of a member number from 0 to 63, for use under ``bit_or``; others raise."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), member.cast("int"))
    outside = F.raise_error(F.concat(F.lit("a mask has no member "), member.cast("string"))).cast("long")
    return F.when((member < 0) | (member > 63), outside).otherwise(bit)


def block_hash(payload: Column, timestamp_us: Column, serial: Column) -> Column:
    """SHA-256 over samples, timestamp and device serial, as hex."""
    return F.sha2(
        F.concat(payload.cast("binary"), timestamp_us.cast("string").cast("binary"), serial.cast("binary")),
        256,
    )


def hash_prefix(digest_hex: Column) -> Column:
    """First 7 bytes of a hex digest."""
    return F.substring(F.unhex(digest_hex), 1, 7)


def embedding_prefix(v: Column, n: int) -> Column:
    """First 12, 14 or 16 dimensions, the sizes the record formats keep."""
    if n not in (12, 14, 16):
        raise ValueError("records keep 12, 14 or 16 dimensions")
    return F.slice(v, 1, n)


def cov_expand(c: Column) -> Column:
    """[xx, xy, xz, yy, yz, zz] to a symmetric 3 x 3 matrix."""
    return F.array(
        F.array(c[0], c[1], c[2]), F.array(c[1], c[3], c[4]), F.array(c[2], c[4], c[5])
    )


def cov_pack(m: Column) -> Column:
    """Upper triangle of a 3 x 3 matrix."""
    return F.array(m[0][0], m[0][1], m[0][2], m[1][1], m[1][2], m[2][2])
