"""Streams over several micro-batches against the batch forms."""

import math

import pytest
from pyspark.sql import functions as F

from chromafield.operators import windows as W
from chromafield.streaming import core as S
from chromafield.streaming.device import device_status, stream_device_status

SCHEMA = "particle_id long, sensor_id long, timestamp_us long, energy double"


@pytest.fixture
def feed(spark, tmp_path_factory):
    """A landing folder that grows by one file set per call."""
    folder = str(tmp_path_factory.mktemp("landing") / "in")

    def push(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(SCHEMA).parquet(folder)

    return push, stream, folder


def run(stream, out, ckpt, mode="append"):
    q = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def test_decay_carries_state(spark, feed, tmp_path):
    push, stream, folder = feed
    rows = [(i, i % 2, i * 1_000_000 + (i % 3) * 1000, float(i % 5)) for i in range(40)]
    for part in (rows[:13], rows[13:30], rows[30:]):
        push(part)
        run(S.stateful_decay(stream(), 5_000_000, "sensor_id"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r["particle_id"]: r["smoothed"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    batch = W.decay_smooth(spark.createDataFrame(rows, SCHEMA), ["sensor_id"], "energy", 5_000_000, tie=["particle_id"])
    want = {r["particle_id"]: r["smoothed"] for r in batch.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_device_states_over_batches(spark, feed, tmp_path):
    push, stream, _ = feed
    sec = 1_000_000
    batches = [
        [(1, 1, 10 * sec, 0.0), (2, 2, 11 * sec, 0.0)],
        [(3, 1, 15 * sec, 0.0), (4, 1, 60 * sec, 0.0)],  # 2 stays silent, 1 pauses
        [(5, 2, 100 * sec, 0.0), (6, 1, 101 * sec, 0.0)],
    ]
    for rows in batches:
        push(rows)
        timed = S.with_event_time(stream(), "1 second")
        run(stream_device_status(timed, 20 * sec), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {(r["sensor_id"], r["state"], r["at_us"] // sec) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {
        (1, "CONNECTED", 10), (2, "CONNECTED", 11),
        (1, "DISCONNECTED", 35), (1, "CONNECTED", 60), (2, "DISCONNECTED", 31),
        (1, "DISCONNECTED", 80), (2, "CONNECTED", 100), (1, "CONNECTED", 101),
    }


def test_batch_device_states(spark):
    df = spark.createDataFrame([(1, 1, 100, 0.0), (2, 2, 10, 0.0)], SCHEMA)
    registry = spark.createDataFrame([(1,), (2,), (3,)], "sensor_id long")
    got = {r["sensor_id"]: r["state"] for r in device_status(df, registry, 50, 120).collect()}
    assert got == {1: "CONNECTED", 2: "DISCONNECTED", 3: "UNWIRED"}


def test_missing_voter_and_degradation(spark, feed, tmp_path):
    push, stream, _ = feed
    sec = 1_000_000
    push([(1, 0, sec, 0.5), (2, 1, sec, 0.7), (3, 2, sec, 0.9), (4, 0, 11 * sec, 0.1), (5, 0, 60 * sec, 0.3)])
    votes = S.with_event_time(stream(), "1 second").withColumns({"voter": F.col("sensor_id"), "score": F.col("energy"), "cell": F.lit(1)})
    run(S.stream_votes(votes, "10 seconds", ["cell"]), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r["window_us"] // sec: (r["gpu_score"], r["coral_score"], r["tdoa_confidence"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {0: (0.5, 0.7, 0.9), 10: (0.1, None, None)}


def test_late_rows_are_kept(spark, feed, tmp_path):
    push, stream, _ = feed
    root = str(tmp_path / "late")
    seen = []
    for rows in ([(1, 1, 1000, 0.0)], [(2, 1, 500, 0.0), (3, 1, 950, 0.0), (4, 1, 2000, 0.0)], [(5, 1, 1000, 0.0)]):
        push(rows)
        writer = S.late_rows(stream(), root, 100, lambda b, i: seen.extend(r[0] for r in b.select("particle_id").collect()), str(tmp_path / "c"))
        S.drain_batches(writer)
    late = {r[0] for r in spark.read.schema("particle_id long").parquet(f"{root}/late/*").collect()}
    assert late == {2, 5} and sorted(seen) == [1, 3, 4]


def test_config_is_read_each_batch(spark, feed, tmp_path):
    push, stream, _ = feed
    path, used = tmp_path / "settings.json", []
    for tau in (0.14, 0.80):
        path.write_text(f'{{"tau": {tau}}}')
        push([(1, 1, 1, 0.0)])
        S.drain_batches(S.with_config(stream(), str(path), lambda b, i, c: used.append(c["tau"]), str(tmp_path / "c")))
    assert used == [0.14, 0.80]


def test_dedupe_across_batches(spark, feed, tmp_path):
    push, stream, _ = feed
    for rows in ([(1, 1, 1_000_000, 0.0), (1, 1, 1_000_000, 0.0)], [(1, 1, 1_000_000, 0.0), (2, 1, 2_000_000, 0.0)]):
        push(rows)
        timed = S.with_event_time(stream(), "10 minutes")
        run(S.stream_dedupe(timed, ["particle_id"]).select("particle_id"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2]


def test_decay_in_one_pass_equals_row_by_row():
    import math
    import random

    import numpy as np

    from chromafield.streaming.core import decayed

    rnd = random.Random(4)
    times = sorted(rnd.randrange(0, 10**7) for _ in range(300)) + [10**9, 10**9, 10**9 + 5]
    values = [rnd.uniform(-1, 1) for _ in times]
    for last, x in ((None, 0.0), (5 * 10**6, 0.7)):
        want, at, state = [], last, x
        for t, u in zip(times, values):
            keep = 0.0 if at is None else math.exp(-max(0, t - at) / 20_000)
            state = state * keep + (1 - keep) * u
            at = t if at is None else max(at, t)
            want.append(state)
        got, end, left = decayed(np.array(times), np.array(values), last, x, 20_000)
        assert np.allclose(got, want, atol=1e-12) and end == at and abs(left - state) < 1e-12


def _grow(path, values, ragged=b""):
    """Appends samples to a capture, and perhaps a part of the next one."""
    import numpy as np

    with open(path, "ab") as out:
        out.write(np.array(values, "<f4").tobytes() + ragged)


def test_growing_captures_are_read_once(spark, tmp_path):
    """Files grow, appear and end inside a record; the stream restarts between all batches."""
    from chromafield.sources import captures

    import struct

    folder = tmp_path / "captures"
    folder.mkdir()
    first, second = folder / "rx_a_20240101T000000.pcm", folder / "rx_b_20240101T000010.pcm"
    ckpt, out = str(tmp_path / "c"), str(tmp_path / "o")

    def batch():
        stream = captures.stream_records(spark, "pcmf32", str(folder), 10.0, sensor_id=4, split_bytes=24)
        run(stream, out, ckpt)
        rows = spark.read.parquet(out).collect()
        return sorted((r["timestamp_us"], r["i"]) for r in rows)

    at = 1_704_067_200_000_000
    want = [(at + i * 100_000, float(i)) for i in range(20)]
    _grow(first, range(9), struct.pack("<f", 9.0)[:3])
    assert batch() == want[:9]
    assert batch() == want[:9]
    with open(first, "ab") as file:
        file.write(struct.pack("<f", 9.0)[3:])
    _grow(first, range(10, 17))
    _grow(second, [100.0, 101.0])
    late = [(at + 10_000_000 + i * 100_000, 100.0 + i) for i in range(3)]
    assert batch() == want[:17] + late[:2]
    _grow(second, [102.0])
    _grow(first, [17.0, 18.0, 19.0])
    assert batch() == want + late
    rows = spark.read.parquet(out)
    assert rows.where("sensor_id = 4").count() == 23
    assert rows.where("timestamp_us < 1704067210000000").select("sample_index").distinct().count() == 20


def test_record_stream_offsets(tmp_path):
    """Planning: bounded batches, exact ranges, and files that shrink or go."""
    from chromafield.sources.captures import RecordStreamReader

    a, b = tmp_path / "a.iq", tmp_path / "b.iq"
    a.write_bytes(bytes(83))
    b.write_bytes(bytes(40))
    options = {"path": str(tmp_path), "samplerate": "10", "splitbytes": "32", "maxbytespertrigger": "50"}
    reader = RecordStreamReader(options, "iq")
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert end == {str(a): 80, str(b): 40}  # the position is not known yet

    def ranges(tasks):
        return [(s.path[-4:], s.first, s.count) for t in tasks for s in t.spans]

    assert ranges(reader.partitions(start, end)) == [
        ("a.iq", 0, 4), ("a.iq", 4, 4), ("a.iq", 8, 2), ("b.iq", 0, 4), ("b.iq", 4, 1),
    ]
    assert ranges(reader.partitions(start, end)) == ranges(RecordStreamReader(options, "iq").partitions(start, end))
    a.write_bytes(bytes(83 + 64))
    b.write_bytes(bytes(64))
    reader.commit(end)
    bounded = reader.latestOffset()
    assert bounded == {str(a): 80 + 48, str(b): 40}
    assert ranges(reader.partitions(end, bounded)) == [("a.iq", 10, 4), ("a.iq", 14, 2)]
    reader.commit(bounded)
    assert reader.latestOffset() == {str(a): 144, str(b): 64}
    assert reader.partitions(bounded, bounded) == []
    with pytest.raises(ValueError, match="shrunk"):
        reader.partitions(bounded, {str(a): 8})


def test_ingest_takes_streams_only(spark):
    from chromafield.sources import tables

    with pytest.raises(ValueError, match="not a stream"):
        tables.ingest(spark, {"x": spark.range(3)})


def test_batches_are_read_as_one_table(spark, tmp_path):
    from chromafield.sources import sinks

    path, day = str(tmp_path / "table"), 86_400_000_000
    frames = [[(0, 1), (day, 2)], [], [(0, 3), (2 * day, 4)]]
    for batch_id, rows in enumerate(frames):
        sinks.store_observation(spark.createDataFrame(rows, "timestamp_us long, id int"), path, batch_id)
    got = sinks.read_batches(spark, path, "timestamp_us long, id int").collect()
    assert {(r["id"], r["batch"], r["day"].day) for r in got} == {(1, 0, 1), (2, 0, 2), (3, 2, 1), (4, 2, 3)}
