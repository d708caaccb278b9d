"""Frequency, coherence and bandwidth to colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chromafield.schemas import ANCHOR_F4_HZ, F_MIN_HZ, LOG_RANGE

# Audible window that RF tones are folded into.
FOLD_LO_HZ = 20.0
FOLD_HI_HZ = 1000.0


def freq_to_hue(f: Column) -> Column:
    """Continuous log hue: 0 at 1 Hz, 1 at 700 THz, clamped outside."""
    hue = F.ln(F.greatest(f, F.lit(F_MIN_HZ)) / F.lit(F_MIN_HZ)) / F.lit(LOG_RANGE)
    return F.when(f.isNotNull(), F.least(F.lit(1.0), hue))


def freq_to_material_id(f: Column) -> Column:
    """Pitch class 0-11: octaves of one note share a class, F4 is class 5."""
    semitones = F.round(F.lit(12.0) * F.log2(f / F.lit(ANCHOR_F4_HZ)))
    return F.when(f > 0, F.pmod(semitones.cast("int") + F.lit(5), F.lit(12)))


def octave_fold(f: Column) -> Column:
    """Halve until at most 1000 Hz (smallest number of octaves); null below 20 Hz."""
    guess = F.greatest(F.lit(0), F.ceil(F.log2(f / F.lit(FOLD_HI_HZ)) - F.lit(1e-9)))
    folded = f / F.pow(F.lit(2.0), guess)
    # the logarithm may land one short at an exact power of two
    folded = F.when(folded > FOLD_HI_HZ, folded / 2).otherwise(folded)
    return F.when(f >= FOLD_LO_HZ, folded)


def hsl(f: Column, gamma: Column, bandwidth_hz: Column, bw0_hz: float) -> Column:
    """Hue from pitch class, lightness from coherence, saturation from bandwidth.

    Choice: saturation = 1 / (1 + bandwidth / bw0), so narrow signals are vivid.
    """
    return F.struct(
        (freq_to_material_id(f) / F.lit(12.0)).alias("h"),
        (F.lit(1.0) / (F.lit(1.0) + bandwidth_hz / F.lit(bw0_hz))).alias("s"),
        gamma.alias("l"),
    )


def particle_color(f: Column, gamma: Column, variance: Column, v0: float) -> Column:
    """RGBA array: hue from log frequency, value from coherence, saturation from variance.

    Choice: saturation = 1 / (1 + variance / v0), so a steady (suspect) carrier is
    vivid.  The hue runs over 270 degrees so that 0 is red and 1 is violet.
    """
    h6 = freq_to_hue(f) * F.lit(4.5)  # 270 degrees in sixths of the circle
    s = F.lit(1.0) / (F.lit(1.0) + variance / F.lit(v0))

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h6, F.lit(6.0))
        ramp = F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))
        return gamma - gamma * s * ramp

    return F.array(channel(5), channel(3), channel(1), F.lit(1.0))


def level_bucket(v: Column) -> Column:
    """Level to colour step: above 110 -> 3, above 80 -> 2, above 50 -> 1, else 0."""
    return F.when(v > 110, 3).when(v > 80, 2).when(v > 50, 1).otherwise(0)
