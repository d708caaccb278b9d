"""Column functions on the values the specification fixes."""

import math

import pytest
from pyspark.sql import functions as F

from chromafield import functions as C
from chromafield.functions.color import freq_to_hue, freq_to_material_id, octave_fold
from chromafield.operators.joins import materials_frame, reflectance
from chromafield.schemas import LOG_RANGE


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first()
    return row["x"]


def test_pitch_class(spark):
    for f, want in ((440.0, 9), (880.0, 9), (349.23, 5), (2.4e9, 2), (0.0, None)):
        assert one(spark, freq_to_material_id(F.col("f")), f=f) == want


def test_hue(spark):
    assert math.isclose(LOG_RANGE, 34.1821, abs_tol=1e-4)
    for f, want in ((1.0, 0.0), (700e12, 1.0), (0.5, 0.0), (1e15, 1.0)):
        assert one(spark, freq_to_hue(F.col("f")), f=f) == pytest.approx(want, abs=1e-12)


def test_octave_fold(spark):
    assert one(spark, octave_fold(F.col("f")), f=2.4e9) == pytest.approx(572.2046, abs=1e-4)
    for f in (1000.0, 2000.0, 1000.0 * 2**29):
        assert one(spark, octave_fold(F.col("f")), f=f) == 1000.0
    assert one(spark, octave_fold(F.col("f")), f=20.0) == 20.0
    assert one(spark, octave_fold(F.col("f")), f=19.9) is None


def test_level_bucket(spark):
    assert [one(spark, C.level_bucket(F.col("v")), v=v) for v in (111.0, 81.0, 51.0, 50.0)] == [3, 2, 1, 0]


def test_colors(spark):
    red = one(spark, C.particle_color(F.col("f"), F.lit(1.0), F.lit(0.0), 1.0), f=1.0)
    assert red == pytest.approx([1.0, 0.0, 0.0, 1.0])
    violet = one(spark, C.particle_color(F.col("f"), F.lit(1.0), F.lit(0.0), 1.0), f=700e12)
    assert violet == pytest.approx([0.5, 0.0, 1.0, 1.0])
    dark = one(spark, C.particle_color(F.col("f"), F.lit(0.0), F.lit(0.0), 1.0), f=440.0)
    assert dark == pytest.approx([0.0, 0.0, 0.0, 1.0])


def test_ticks_do_not_overflow(spark):
    ticks = 10_000_000 * 86_400 * 400  # 400 days of a 10 MHz counter
    assert one(spark, C.qpc_to_us(F.col("c"), F.lit(0), F.lit(10_000_000)), c=ticks) == 86_400_000_000 * 400


def test_link_budget(spark):
    out = one(spark, C.link_budget(F.col("b"), F.col("s")), b=1e6, s=50.0)
    assert out["capacity_bps"] == pytest.approx(16.61e6, rel=1e-3)
    assert one(spark, C.link_budget(F.lit(1.0), F.col("s")), s=45.0)["qam_ceiling"] == pytest.approx(32768)


def test_roughness_ratio(spark):
    a = one(spark, C.rf_roughness(F.col("s"), F.lit(2.4e9), F.lit(0.0)), s=0.00125)["alpha"]
    b = one(spark, C.rf_roughness(F.col("s"), F.lit(60e9), F.lit(0.0)), s=0.00125)
    assert a == pytest.approx(0.01, abs=1e-3) and b["alpha"] / a == pytest.approx(25) and b["rough"]


def test_roughness_at_frequency_zero(spark):
    zero = one(spark, C.rf_roughness(F.col("s"), F.col("f"), F.lit(0.0)), s=0.00125, f=0.0)
    assert zero["alpha"] == 0.0 and zero["rough"] is None


def test_concrete_reflectance(spark):
    df = spark.createDataFrame([("dry_concrete", 0.0)], "material string, theta double")
    r = reflectance(df, materials_frame(spark), "theta").first()["reflectance"]
    # normal incidence: ((sqrt(5) - 1) / (sqrt(5) + 1))^2, within 1 dB
    want = ((math.sqrt(5) - 1) / (math.sqrt(5) + 1)) ** 2
    assert abs(10 * math.log10(r["te"] / want)) < 1 and r["te"] == pytest.approx(r["tm"])


def test_wet_wood_reflects_more(spark):
    dry = one(spark, C.wet_permittivity(F.lit(2.4e9), F.lit(2.0), F.col("s")), s=0.0)
    wet = one(spark, C.wet_permittivity(F.lit(2.4e9), F.lit(2.0), F.col("s")), s=0.3)
    assert dry["eps_r"] == 2.0 and dry["eps_i"] == 0.0 and 20 < wet["eps_r"] < 30


def test_propagation_and_bearing(spark):
    c_air = one(spark, C.propagation_speed(F.col("t"), F.lit(1013.25), F.lit(50.0)), t=15.0)
    assert 299_690_000 < c_air < 299_792_458
    assert one(spark, C.bearing(F.col("p"), F.lit(6e9), F.lit(0.012)), p=0.0) == 0.0
    assert one(spark, C.bearing(F.col("p"), F.lit(6e9), F.lit(0.001)), p=3.0) is None


def test_path_phase_single_reflector(spark):
    lam = 299_792_458.0 / 2.4e9
    out = one(spark, C.path_phase(F.col("legs"), F.lit(2.4e9)), legs=[lam * 2, lam * 1.25])
    assert abs(out["phase"] - 0.25) * 360 < 5
    assert not one(spark, C.path_phase(F.col("legs"), F.lit(2.4e9)), legs=[lam * 1.5])["constructive"]


def test_hash_prefix(spark):
    digest = F.sha2(F.lit("abc").cast("binary"), 256)
    assert one(spark, F.hex(C.hash_prefix(digest)), v=0) == "BA7816BF8F01CF"


def test_masks(spark):
    assert one(spark, C.mask_members(F.col("m")), m=0b10000101) == [0, 2, 7]
    packed = one(spark, C.pack_source(F.lit(11), F.col("d")), d=77)
    assert one(spark, C.unpack_source(F.col("s")), s=packed).asDict() == {"hue_class": 11, "device": 77}
    C.register_sql_functions(spark)
    assert [r[0] for r in spark.sql("SELECT * FROM explode_mask(10)").collect()] == [1, 3]
    wide = (1 << 40) | 1
    assert one(spark, C.mask_members(F.col("m")), m=wide) == [0, 40]
    assert one(spark, C.mask_members(F.col("m")), m=-(1 << 63)) == [63]
    assert [r[0] for r in spark.sql(f"SELECT * FROM explode_mask({wide})").collect()] == [0, 40]
    assert one(spark, C.mask_bits(F.col("b")), b=40) == 1 << 40
    for outside in (64, -1):
        with pytest.raises(Exception, match="no member"):
            one(spark, C.mask_bits(F.col("b")), b=outside)


@pytest.mark.parametrize("f", [None, 0.0, -5.0, 19.99, 20.0, 999.9999999, 1000.0, 1000.0000001, 2000.0, 4000.0, 1e8])
def test_sql_functions_equal_the_columns(spark, f):
    C.register_sql_functions(spark)
    row = spark.createDataFrame([(f,)], "f double").select(
        F.expr("freq_to_hue(f)"), C.freq_to_hue(F.col("f")),
        F.expr("octave_fold(f)"), C.octave_fold(F.col("f")),
        F.expr("freq_to_material_id(f)"), C.freq_to_material_id(F.col("f")),
    ).first()
    assert row[0] == row[1] and row[2] == row[3] and row[4] == row[5]


def test_capture_names(spark):
    p = one(spark, C.parse_capture_name(F.col("n")), n="/data/rx_rtl_20240131T235959.iq")
    assert (p["kind"], p["device"], p["extension"]) == ("rx", "rtl", "iq") and p["captured_at"].year == 2024
    p = one(spark, C.parse_capture_name(F.col("n")), n="session_20240131T235959.pcm")
    assert (p["kind"], p["device"], p["extension"]) == ("session", None, "pcm")
    assert one(spark, C.parse_capture_name(F.col("n")), n="junk.iq")["captured_at"] is None


def test_edit_distance(spark):
    d = C.motif_edit_distance(F.col("a"), F.col("b"))
    assert one(spark, d, a=[1, 500, 3], b=[1, 3, 3, 9000]) == 2
    assert one(spark, d, a=[35_300, 55_300, 2**40], b=[35_300, 2**40]) == 1


def test_notes(spark):
    text = "---\ntimestamp: 2024-01-05T10:00:00\nsensor_ids: [1, 2]\nmemory_obs_ids: [7]\nconfidence: 0.5\ntags: [wifi, null]\n---\nBody --- here\n"
    n = one(spark, C.parse_note(F.col("t")), t=text)
    assert n["sensor_ids"] == ["1", "2"] and n["obs_ids"] == ["7"] and n["tags"] == ["wifi", "null"]
    assert n["confidence"] == 0.5 and n["body"] == "Body --- here\n"
    bare = one(spark, C.parse_note(F.col("t")), t="no front matter")
    assert bare["timestamp"] is None and bare["body"] == "no front matter"


def test_settings(spark):
    good = '{"material":"glass","center":[0,0,0],"size":[1,1,1],"wetness":0.5,"permittivity":6.3,"conductivity":0}'
    docs = [(good,), ('{"material":"jelly","center":[0,0],"size":[1,1,0],"wetness":2}',), ("not json",)]
    out = [r["violations"] for r in C.validate_settings(spark.createDataFrame(docs, "settings string")).collect()]
    assert out[0] == [] and len(out[1]) == 4 and "material missing" in out[2]


def test_nan_stays(spark):
    assert one(spark, C.is_diagnostic(F.col("v")), v=float("nan")) is True
    assert one(spark, C.is_diagnostic(F.lit(None).cast("double")), v=1) is False


def test_frequency_units(spark):
    out = one(spark, C.normalize_freq(F.lit(2.4), F.col("u"), 24e6, 1766e6), u="GHz")
    assert out.asDict() == {"hz": 2.4e9, "clamped_hz": 1766e6, "warn": True}
    assert one(spark, C.normalize_freq(F.lit(2.4), F.col("u"), 24e6, 1766e6), u="THz")["hz"] is None
