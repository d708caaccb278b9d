"""Explicit schemas and constants.  Nothing in the library infers a schema."""

from __future__ import annotations

import math

from pyspark.sql import types as T

# Physical constants and band edges.
SPEED_OF_LIGHT = 299_792_458.0
F_MIN_HZ = 1.0
F_MAX_HZ = 700e12
LOG_RANGE = math.log(F_MAX_HZ / F_MIN_HZ)
ANCHOR_F4_HZ = 349.23
KNN_K = 20
N_EIGENVECTORS = 4
INTERFEROMETER_BASELINE_M = 0.012
POWERLINE_HZ = 60.0
MAX_SENSORS = 32  # width of the sensor bit mask

# Layer and device-state codes.
LAYERS = {
    "video": 0,
    "pose": 1,
    "acoustic": 2,
    "rf": 3,
    "environment": 4,
    "magnetic": 5,
    "jury": 6,
    "timeline": 7,
}
# Toggle letters on the scene, each naming one layer.
LAYER_TOGGLES = {
    "V": "video",
    "P": "pose",
    "A": "acoustic",
    "R": "rf",
    "E": "environment",
    "M": "magnetic",
    "J": "jury",
    "T": "timeline",
}
DEVICE_STATES = ("CONNECTED", "DISCONNECTED", "UNWIRED")

# Sensor bands (name, lower edge Hz, upper edge Hz).  They overlap.
BANDS = [
    ("coil", 1.0, 90e3),
    ("microphone", 20.0, 20e3),
    ("loop_receiver", 10e3, 300e6),
    ("transceiver", 70e6, 6e9),
    ("microcontroller", 0.0, 75e6),
    ("stereo_camera", 299e12, 301e12),
    ("webcam", 299e12, 301e12),
    ("infrared_array", 299e12, 301e12),
]

# Tuner band presets in Hz and the half width around them.
BAND_PRESETS_HZ = {
    "433": 433e6,
    "915": 915e6,
    "1090": 1090e6,
    "2400": 2.4e9,
    "5800": 5.8e9,
}
PRESET_HALF_WIDTH_HZ = 500e3

# Relative permittivity (real, imaginary) near 2.4 GHz.
MATERIALS = [
    ("dry_concrete", 5.0, 0.17),
    ("wet_concrete", 12.0, 1.5),
    ("glass", 6.27, 0.15),
    ("wood", 2.0, 0.1),
    ("metal", 1.0, 1.0e7),
    ("human_body", 52.0, 13.0),
]


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


_FLOATS = T.ArrayType(T.FloatType(), False)

RAW_IQ = T.StructType(
    [
        _f("i", T.FloatType()),
        _f("q", T.FloatType()),
        _f("timestamp_us", T.LongType()),
        _f("sensor_id", T.LongType()),
        _f("jitter_us", T.IntegerType()),
        _f("packet_loss_count", T.IntegerType()),
        _f("capture", T.StringType()),
        _f("sample_index", T.LongType()),
    ]
)

# The 128-byte record without its reserved tail.
PARTICLE_CORE = T.StructType(
    [
        _f("position", _FLOATS),
        _f("covariance", _FLOATS),
        _f("opacity", T.FloatType()),
        _f("color", _FLOATS),
        _f("timestamp_us", T.LongType()),
        _f("frequency_hz", T.FloatType()),
        _f("energy", T.FloatType()),
        _f("phase_coherence", T.FloatType()),
        _f("carrier_variance", T.FloatType()),
        _f("anomaly_score", T.FloatType()),
        _f("sensor_id_mask", T.LongType()),
        _f("corpus_hash", T.BinaryType()),
        _f("jury_flags", T.ShortType()),
    ]
)

PARTICLE = T.StructType(
    PARTICLE_CORE.fields
    + [
        _f("layer", T.ByteType()),
        _f("source", T.ByteType()),
        _f("material_id", T.IntegerType()),
        _f("gnss_fix", T.ByteType()),
        _f("bandwidth_hz", T.FloatType()),
        _f("temperature_c", T.FloatType()),
        _f("humidity_pct", T.FloatType()),
        _f("motif_hint", T.IntegerType()),
        _f("doppler_shift", T.FloatType()),
        _f("phase_velocity", T.FloatType()),
        _f("scattering_cross_section", T.FloatType()),
        _f("embedding", _FLOATS),
    ]
)

VERDICT = T.StructType(
    [
        _f("timestamp_us", T.LongType()),
        _f("position", _FLOATS),
        _f("frequency_hz", T.FloatType()),
        _f("gpu_score", T.FloatType()),
        _f("coral_score", T.FloatType()),
        _f("tdoa_confidence", T.FloatType()),
        _f("divergence", T.FloatType()),
    ]
)

ENVIRONMENT = T.StructType(
    [
        _f("timestamp_us", T.LongType()),
        _f("temperature_c", T.DoubleType()),
        _f("humidity_pct", T.DoubleType()),
        _f("pressure_hpa", T.DoubleType()),
        _f("lat", T.DoubleType()),
        _f("lon", T.DoubleType()),
        _f("gnss_fix", T.ByteType()),
        _f("utc", T.TimestampType()),
    ]
)

OBSERVATION = T.StructType(
    [
        _f("id", T.LongType()),
        _f("timestamp_us", T.LongType()),
        _f("sensor_type", T.StringType()),
        _f("material_id", T.IntegerType()),
        _f("energy", T.DoubleType()),
        _f("position_xyz", _FLOATS),
        _f("description_text", T.StringType()),
        _f("embedding_vec", _FLOATS),
        _f("significant", T.BooleanType()),
    ]
)

MOTIF_EVENT = T.StructType(
    [
        _f("name", T.StringType()),
        _f("phase", T.IntegerType()),
        _f("phase_total", T.IntegerType()),
        _f("confidence", T.DoubleType()),
        _f("next_event_eta_secs", T.DoubleType()),
        _f("freq_hz", T.DoubleType()),
    ]
)

IMU = T.StructType(
    [
        _f("counter", T.LongType()),
        _f("buttons", T.LongType()),
        _f("stick_l", T.LongType()),
        _f("stick_r", T.LongType()),
        _f("accel", _FLOATS),
        _f("gyro", _FLOATS),
        _f("timestamp_us", T.LongType()),
    ]
)

NODE = T.StructType(
    [_f("id", T.StringType()), _f("type", T.StringType()), _f("props", T.StringType())]
)
EDGE = T.StructType(
    [
        _f("src", T.StringType()),
        _f("dst", T.StringType()),
        _f("type", T.StringType()),
        _f("ts", T.LongType()),
    ]
)

SETTINGS = T.StructType(
    [
        _f("material", T.StringType()),
        _f("center", T.ArrayType(T.DoubleType())),
        _f("size", T.ArrayType(T.DoubleType())),
        _f("wetness", T.DoubleType()),
        _f("permittivity", T.DoubleType()),
        _f("conductivity", T.DoubleType()),
    ]
)
