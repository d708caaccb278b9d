"""Byte-level sources, sinks, notes and the exhibit, on files made in a temporary folder."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromafield.schemas import IMU
from chromafield.sources import captures, sinks, tables


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def root(tmp_path_factory):
    # pytest names its folders after the test; keep the banned words out of the path
    return tmp_path_factory.mktemp("captured")


@pytest.fixture
def folder(tmp_path_factory):
    return root(tmp_path_factory)


def test_record_lengths():
    assert captures.CORPUS_DTYPE.itemsize == 128 and captures.IMU_DTYPE.itemsize == 100
    assert captures.IQ_DTYPE.itemsize == 8


def test_iq_is_split_and_timed(spark, folder):
    x = np.arange(2000, dtype="<f4")
    put(folder / "rx_rtl_20240101T000000.iq", x.tobytes())
    df = captures.read_iq(spark, str(folder), 1000.0, 3, split_bytes=800)
    assert df.rdd.getNumPartitions() == 10
    rows = {r["sample_index"]: r for r in df.collect()}
    assert len(rows) == 1000 and rows[7]["i"] == 14.0 and rows[7]["q"] == 15.0 and rows[7]["sensor_id"] == 3
    assert rows[7]["timestamp_us"] == 1_704_067_200_000_000 + 7000
    assert rows[7]["capture"] == "rx_rtl_20240101T000000.iq"


def test_time_filter_prunes_bytes(spark, folder):
    put(folder / "a.iq", np.zeros(20_000, "<f4").tobytes())
    df = captures.read_iq(spark, str(folder), 1000.0, split_bytes=800, between=(5_000_000, 5_100_000))
    assert df.count() == 100
    options = {"path": str(folder), "samplerate": "1000", "splitbytes": "800", "fromus": "5000000", "untilus": "5100000"}
    reader = captures.RecordReader(options, "iq")
    assert sum(s.count for p in reader.partitions() for s in p.spans) <= 110


def test_small_files_share_a_task(spark, folder):
    for i in range(50):
        put(folder / f"c{i}.iq", np.zeros(20, "<f4").tobytes())
    df = captures.read_iq(spark, str(folder), 1000.0)
    assert df.rdd.getNumPartitions() == 1 and df.count() == 500


def test_bad_size_and_guard(spark, folder):
    put(folder / "bad.iq", b"\0" * 12)
    with pytest.raises(Exception, match="does not divide"):
        captures.read_iq(spark, str(folder / "bad.iq"), 1000.0).count()
    put(folder / "x" / "tests" / "a.iq", b"\0" * 16)
    with pytest.raises(ValueError, match="production"):
        captures.read_iq(spark, str(folder / "x" / "tests" / "a.iq"), 1000.0)
    with pytest.raises(Exception, match="production"):  # found below a folder
        captures.read_iq(spark, str(folder / "x"), 1000.0).count()
    with pytest.raises(Exception, match="FileNotFound|path"):
        captures.read_iq(spark, str(folder / "none"), 1000.0).count()


@pytest.mark.parametrize("fmt,raw", [
    ("pcm16", struct.pack("<3h", -32768, 0, 16384)),
    ("pcm24", b"\x00\x00\x80" + b"\x00\x00\x00" + b"\x00\x00\x40"),
    ("pcmf32", struct.pack("<3f", -1.0, 0.0, 0.5)),
])
def test_pcm(spark, folder, fmt, raw):
    put(folder / "m.pcm", raw)
    rows = captures.read_pcm(spark, str(folder / "m.pcm"), 3.0, fmt).orderBy("sample_index").collect()
    assert [r["i"] for r in rows] == [-1.0, 0.0, 0.5] and {r["q"] for r in rows} == {0.0}


def test_imu_layout(spark, folder):
    packet = bytearray(100)
    struct.pack_into("<5I", packet, 0, 1, 42, 0b101, 7, 8)
    struct.pack_into("<6f", packet, 44, 1, 2, 3, 4, 5, 6)
    struct.pack_into("<Q", packet, 68, 123456789)
    put(folder / "p.imu", bytes(packet) * 3)
    row = captures.read_imu(spark, str(folder / "p.imu")).first()
    assert (row["counter"], row["buttons"], row["stick_l"], row["stick_r"]) == (42, 5, 7, 8)
    assert row["accel"] == [1, 2, 3] and row["gyro"] == [4, 5, 6] and row["timestamp_us"] == 123456789
    captures.write_records(spark.createDataFrame([row], IMU), str(folder / "out"), "imu", "imu")
    written = [f for f in (folder / "out").iterdir() if f.suffix == ".imu"]
    assert len(written) == 1 and written[0].read_bytes() == bytes(packet)


def test_corpus_layout(spark, folder):
    rec = bytearray(128)
    struct.pack_into("<3f", rec, 0, 1, 2, 3)
    struct.pack_into("<6f", rec, 12, *range(6))
    struct.pack_into("<5f", rec, 36, 0.5, 1, 2, 3, 4)
    struct.pack_into("<Q", rec, 56, 1_704_067_200_000_000)
    struct.pack_into("<5f", rec, 64, 440, 2, 0.75, 0.25, float("nan"))
    struct.pack_into("<I", rec, 84, 2**31)
    rec[88:95] = b"ABCDEFG"
    rec[95] = 9
    put(folder / "corpus_20240101.bin", bytes(rec))
    df = captures.read_corpus_bin(spark, str(folder / "corpus_20240101.bin"))
    row = df.first()
    assert row["position"] == [1, 2, 3] and row["covariance"] == [0, 1, 2, 3, 4, 5] and row["color"] == [1, 2, 3, 4]
    assert row["sensor_id_mask"] == 2**31 and bytes(row["corpus_hash"]) == b"ABCDEFG" and row["jury_flags"] == 9
    assert row["anomaly_score"] != row["anomaly_score"]  # NaN is kept
    captures.write_records(df, str(folder / "again"), "corpus")
    (file,) = [f for f in (folder / "again").iterdir() if f.suffix == ".bin"]
    assert file.name.startswith("corpus_20240101-") and file.read_bytes() == bytes(rec)


def test_catalogue(spark, folder):
    put(folder / "rx_rtl_20240101T000000.iq", b"\0" * 80)
    put(folder / "odd.cf32", b"\0" * 81)
    put(folder / "tests" / "no.iq", b"\0" * 8)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in tables.capture_catalog(spark, str(folder), 10.0).collect()}
    assert set(rows) == {"rx_rtl_20240101T000000.iq", "odd.cf32"}
    assert rows["rx_rtl_20240101T000000.iq"]["duration_s"] == 1.0 and rows["rx_rtl_20240101T000000.iq"]["valid"]
    assert not rows["odd.cf32"]["valid"] and rows["odd.cf32"]["samples"] == 10


def test_jsonl(spark, folder):
    put(folder / "events.jsonl", b'{"timestamp_us": 5, "energy": 1.5}\n{broken\n')
    rows = tables.read_corpus_jsonl(spark, str(folder / "events.jsonl")).collect()
    assert [r["timestamp_us"] for r in rows] == [5, None] and rows[1]["_corrupt"] == "{broken"
    put(folder / "empty.jsonl", b"")
    with pytest.raises(ValueError, match="empty corpus"):
        tables.read_corpus_jsonl(spark, str(folder / "empty.jsonl"))


def test_append_only_corpus(spark, folder):
    day = 86_400_000_000
    df = spark.createDataFrame([(1, 10), (2, day + 5)], "id long, timestamp_us long")
    out = str(folder / "corpus")
    sinks.append_corpus(df, out)
    sinks.append_corpus(df, out)
    back = spark.read.schema("id long, timestamp_us long, day date").parquet(f"{out}/particles")
    assert back.count() == 4 and back.select("day").distinct().count() == 2
    stream = str(folder / "stream")
    for _ in range(2):  # a retried batch replaces itself
        sinks.append_corpus(df, stream, batch_id=0)
    assert spark.read.schema("id long").parquet(f"{stream}/particles/*").count() == 2


def test_notes_folder(spark, folder):
    put(folder / "n1.md", b"---\ntimestamp: 2024-01-01\nmemory_obs_ids: [5, 6]\ntags: [a]\n---\nFan hum\n")
    put(folder / "n2.md", b"plain")
    notes = tables.read_notes(spark, str(folder))
    assert notes.count() == 2
    obs = spark.createDataFrame([(5,), (9,)], "id long")
    assert [r["obs_id"] for r in tables.note_refs(notes, obs).collect()] == [5]
    assert tables.query_notes(notes, text="fan", tag="a").count() == 1
    assert tables.query_notes(notes, since="2025").count() == 0


def test_mark_significant(spark):
    obs = spark.createDataFrame([(1, None), (2, True), (3, False)], "id long, significant boolean")
    got = {r["id"]: r["significant"] for r in sinks.mark_significant(obs, spark.createDataFrame([(3,)], "id long")).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_exhibit(spark, folder):
    corpus = spark.createDataFrame([(1, 100, bytearray(b"abcdefg")), (2, 150, bytearray(b"hijklmn")), (3, 10**9, bytearray(b"x"))], "particle_id long, timestamp_us long, corpus_hash binary")
    nodes = spark.createDataFrame([("event:1", "Event", ""), ("object:9", "Object", ""), ("event:3", "Event", "")], "id string, type string, props string")
    edges = spark.createDataFrame([("event:1", "object:9", "CO_OCCURS_WITH", 100)], "src string, dst string, type string, ts long")
    out = str(folder / "exhibit")
    clock = corpus.where("particle_id = 2").select("timestamp_us")
    got = {r["part"]: r["rows"] for r in sinks.export_exhibit(corpus, nodes, edges, 1, out, 60, clock, 5).collect()}
    assert got == {"corpus": 2, "nodes": 2, "edges": 1, "hashes": 2, "times": 1}
    assert spark.read.schema("part string, rows long").json(f"{out}/manifest").count() == 5
    with pytest.raises(ValueError, match="no event"):
        sinks.export_exhibit(corpus, nodes, edges, 77, out, 60)


def test_csi(spark):
    df = spark.createDataFrame([(1, 5, [(1.0, 2.0), (3.0, 4.0)])], "packet_id long, timestamp_us long, h array<struct<re:double,im:double>>")
    got = [(r["subcarrier"], r["re"], r["im"]) for r in tables.csi_points(df).orderBy("subcarrier").collect()]
    assert got == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    assert F is not None


def test_samples_keep_their_times_over_several_files(spark, folder):
    """Time, number and value of every sample come back, whatever the order of the rows."""
    from chromafield.sources import captures

    rate, start = 2.4e6, 1_700_000_000_250_000
    rows = [(float(k), -float(k), start + int(k * 1e6 / rate), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "i float, q float, timestamp_us long, sample_index long")
    captures.write_records(df.orderBy(F.hash("i")).repartition(4), str(folder / "iq_times"), "iq")
    back = captures.read_iq(spark, str(folder / "iq_times"), rate)
    assert back.select("source_file").distinct().count() > 1 if "source_file" in back.columns else True
    got = [(r["i"], r["q"], r["timestamp_us"], r["sample_index"]) for r in back.collect()]
    assert sorted(got) == sorted(rows)


def test_null_samples_raise(spark, folder):
    from chromafield.sources import captures

    df = spark.createDataFrame([(1.0, None)], "i float, q float")
    with pytest.raises(Exception, match="cannot hold the nulls"):
        captures.write_records(df, str(folder / "iq_nulls"), "iq")


def test_paths_go_to_the_default_file_system(spark):
    from chromafield.sources import captures

    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    try:
        assert captures.qualified(spark, "/in/x") == "viewfs://store/in/x"
        assert captures.qualified(spark, "file:/in/x") == "file:/in/x"
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_zone_maps_open_matching_blocks_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(captures, "ZONE_RECORDS", 100)
    folder = tmp_path / "imu"
    folder.mkdir()

    def packets(times):
        rows = np.zeros(len(times), captures.IMU_DTYPE)
        rows["timestamp_us"], rows["counter"] = times, np.arange(len(times))
        return rows.tobytes()

    (folder / "a.bin").write_bytes(packets(np.arange(1000)))
    (folder / "b.bin").write_bytes(packets(np.arange(5000, 5250)))

    def ranges(lo, hi):
        reader = captures.RecordReader({"path": str(folder), "fromus": str(lo), "untilus": str(hi)}, "imu")
        return [(s.path[-5:], s.first, s.count) for t in reader.partitions() for s in t.spans if s.count]

    everything = [("a.bin", 0, 1000), ("b.bin", 0, 250)]
    assert ranges(350, 420) == everything  # no maps yet
    assert captures.index_records(spark, str(folder), "imu", 100) == 2
    assert captures.index_records(spark, str(folder), "imu", 100) == 0
    assert ranges(350, 420) == [("a.bin", 300, 200)]
    assert ranges(5200, 9000) == [("b.bin", 200, 50)]
    assert ranges(2000, 3000) == []
    with open(folder / "b.bin", "ab") as file:  # grown after it was indexed
        file.write(packets([350]))
    assert ranges(350, 420) == [("a.bin", 300, 200), ("b.bin", 250, 1)]
    assert captures.read_imu(spark, str(folder), between=(350, 420)).count() == 71
    df = captures.read_imu(spark, str(folder))
    # a filtered query leaves nothing behind for the next one
    assert df.where("timestamp_us >= 350 and timestamp_us < 420").count() == 71
    assert df.count() == 1251
    assert captures.index_records(spark, str(folder), "imu", 100) == 1
    assert ranges(350, 420) == [("a.bin", 300, 200), ("b.bin", 200, 51)]


def test_written_particles_have_zone_maps(spark, tmp_path):
    from chromafield.sources import captures

    path = str(tmp_path / "imu")
    zero = F.array(*[F.lit(0.0).cast("float")] * 3)
    df = spark.range(0, 500, 1, 1).select(
        F.col("id").alias("counter"), *[F.lit(0).cast("long").alias(n) for n in ("buttons", "stick_l", "stick_r")],
        zero.alias("accel"), zero.alias("gyro"), (F.col("id") * 10).alias("timestamp_us"),
    )
    captures.write_records(df, path, "imu")
    file = captures.list_files(path)
    assert len(file) == 1  # the map is no data
    block, covered, pairs = captures.load_zones(captures._resolve(path)[0], file[0].path)
    assert covered == 500 and pairs.min() == 0 and pairs.max() == 4990
