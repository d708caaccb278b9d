"""Radio, weather and clock arithmetic as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafield.schemas import SPEED_OF_LIGHT

# Frequency unit factors.
UNIT_HZ = {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9}


def qpc_to_us(counter: Column, epoch: Column, freq: Column) -> Column:
    """Counter ticks since the session epoch in whole microseconds, without overflow."""
    ticks = (counter - epoch).cast("long")
    seconds = F.floor(ticks / freq).cast("long")
    rest = ticks - seconds * freq
    return seconds * F.lit(1_000_000) + F.floor(rest * F.lit(1_000_000) / freq).cast("long")


def iq_features(df: DataFrame, i: str = "i", q: str = "q") -> DataFrame:
    """Amplitude, phase, instantaneous power and dB; phase and dB are null at zero power."""
    power = F.col(i) * F.col(i) + F.col(q) * F.col(q)
    return df.withColumns(
        {
            "amplitude": F.sqrt(power),
            "phase": F.when(power > 0, F.atan2(F.col(q), F.col(i))),
            "power": power,
            "power_db": F.when(power > 0, F.lit(10.0) * F.log10(power)),
        }
    )


def normalize_freq(value: Column, unit: Column, lo_hz: float, hi_hz: float) -> Column:
    """Struct(hz, clamped_hz, warn): unit to Hz, clamp to the tuner range, flag if outside."""
    factor = F.lit(None).cast("double")
    for name, scale in UNIT_HZ.items():
        factor = F.when(unit == name, F.lit(scale)).otherwise(factor)
    hz = value * factor
    return F.struct(
        hz.alias("hz"),
        F.when(hz.isNotNull(), F.least(F.greatest(hz, F.lit(lo_hz)), F.lit(hi_hz))).alias("clamped_hz"),
        ((hz < lo_hz) | (hz > hi_hz)).alias("warn"),
    )


def wavelength(f: Column) -> Column:
    return F.lit(SPEED_OF_LIGHT) / F.nullif(f, F.lit(0.0))


def rf_roughness(sigma_m: Column, f: Column, theta: Column) -> Column:
    """Struct(alpha, rough): surface roughness over wavelength and the Rayleigh class.

    At frequency zero the wave is endless: alpha is 0 and there is no class.
    """
    lam = wavelength(f)
    return F.struct(
        (sigma_m * f / F.lit(SPEED_OF_LIGHT)).alias("alpha"),
        (sigma_m * F.lit(8.0) * F.cos(theta) > lam).alias("rough"),
    )


def fresnel_r(eps_r: Column, eps_i: Column, theta: Column) -> Column:
    """Struct(te, tm): power reflectance for permittivity eps_r - j eps_i."""
    cos_t = F.cos(theta)
    a = eps_r - F.pow(F.sin(theta), F.lit(2.0))
    mod = F.sqrt(a * a + eps_i * eps_i)
    # w = sqrt(eps - sin^2): principal root as a (re, im) pair
    w_re = F.sqrt(F.greatest(F.lit(0.0), (mod + a) / 2))
    w_im = -F.sqrt(F.greatest(F.lit(0.0), (mod - a) / 2))

    def power_ratio(p_re: Column, p_im: Column) -> Column:
        num = F.pow(p_re - w_re, F.lit(2.0)) + F.pow(p_im - w_im, F.lit(2.0))
        den = F.pow(p_re + w_re, F.lit(2.0)) + F.pow(p_im + w_im, F.lit(2.0))
        return F.try_divide(num, den)

    return F.struct(
        power_ratio(cos_t, F.lit(0.0)).alias("te"),
        power_ratio(eps_r * cos_t, -eps_i * cos_t).alias("tm"),
    )


def wet_permittivity(f: Column, eps_dry: Column, saturation: Column, temp_c: float = 25.0) -> Column:
    """Struct(eps_r, eps_i) of a surface with water saturation in [0, 1].

    Choice: the water term is the published double-Debye fit of Liebe, Hufford and
    Manabe (1991); the effective medium adds saturation * (eps_water - 1).
    """
    t = 300.0 / (temp_c + 273.15) - 1.0
    static = 77.66 + 103.3 * t
    mid, high = 0.0671 * static, 3.52
    relax1 = 20.20 - 146.0 * t + 316.0 * t * t  # GHz
    relax2 = 39.8 * relax1
    ghz = f / F.lit(1e9)
    x1, x2 = ghz / F.lit(relax1), ghz / F.lit(relax2)
    d1 = F.lit(static - mid) / (F.lit(1.0) + x1 * x1)
    d2 = F.lit(mid - high) / (F.lit(1.0) + x2 * x2)
    return F.struct(
        (eps_dry + saturation * (d1 + d2 + F.lit(high - 1.0))).alias("eps_r"),
        (saturation * (d1 * x1 + d2 * x2)).alias("eps_i"),
    )


def propagation_speed(temp_c: Column, pressure_hpa: Column, humidity_pct: Column) -> Column:
    """Wave speed in air, c / n.  Choice: refractivity and vapour pressure of ITU-R P.453."""
    enhance = F.lit(1.0) + F.lit(1e-4) * (
        F.lit(7.2) + pressure_hpa * (F.lit(0.0320) + F.lit(5.9e-6) * temp_c * temp_c)
    )
    saturation = (
        enhance
        * F.lit(6.1121)
        * F.exp((F.lit(18.678) - temp_c / F.lit(234.5)) * temp_c / (temp_c + F.lit(257.14)))
    )
    vapour = humidity_pct / F.lit(100.0) * saturation
    kelvin = temp_c + F.lit(273.15)
    refractivity = F.lit(77.6) / kelvin * (pressure_hpa + F.lit(4810.0) * vapour / kelvin)
    return F.lit(SPEED_OF_LIGHT) / (F.lit(1.0) + refractivity * F.lit(1e-6))


def bearing(dphi: Column, f: Column, baseline_m: Column) -> Column:
    """Arrival angle from a phase difference; null where no angle exists."""
    x = dphi * wavelength(f) / (F.lit(2 * math.pi) * baseline_m)
    return F.when(F.abs(x) <= 1.0, F.asin(x))


def radial_velocity(doppler_hz: Column, f: Column) -> Column:
    return F.lit(SPEED_OF_LIGHT) * F.try_divide(doppler_hz, f)


def link_budget(bandwidth_hz: Column, snr_db: Column) -> Column:
    """Struct(capacity_bps, qam_ceiling): Shannon capacity and 2^(SNR_dB / 3)."""
    snr = F.pow(F.lit(10.0), snr_db / 10)
    return F.struct(
        (bandwidth_hz * F.log2(F.lit(1.0) + snr)).alias("capacity_bps"),
        F.pow(F.lit(2.0), snr_db / 3).alias("qam_ceiling"),
    )


def lf_hf_split(f: Column, amplitude: Column) -> Column:
    """Struct(lf, hf): amplitude below 80 Hz and from 80 to 300 Hz."""
    zero = F.lit(0.0)
    return F.struct(
        F.when(f < 80, amplitude).otherwise(zero).alias("lf"),
        F.when((f >= 80) & (f <= 300), amplitude).otherwise(zero).alias("hf"),
    )


def path_phase(lengths_m: Column, f: Column) -> Column:
    """Struct(phase, constructive): sum(length / wavelength) mod 1 over one path's legs."""
    total = F.aggregate(lengths_m, F.lit(0.0), lambda acc, x: acc + x) * f / F.lit(SPEED_OF_LIGHT)
    phase = F.pmod(total, F.lit(1.0))
    return F.struct(
        phase.alias("phase"), (F.cos(phase * F.lit(2 * math.pi)) >= 0).alias("constructive")
    )
