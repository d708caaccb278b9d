"""Fixed-length record files as a splittable Spark data source.

Formats: ``iq`` (two floats), ``pcm16`` / ``pcm24`` / ``pcmf32`` (mono), ``imu`` (100-byte
packets) and ``corpus`` (128-byte particles), all little-endian without a header.  Spark
SQL has no cast from bytes to floats, so tasks decode byte ranges with numpy into Arrow
batches.  Large files are split on record borders and small files share a task.  A time range
(``between``) prunes byte ranges before anything is read: by arithmetic in sample files, and by
zone maps (the least and greatest time of every block of records, in a hidden file beside the
data) in files of packets and particles.  The range is an argument, because filters that Spark
pushes into a Python source stay in effect for later queries on the same DataFrame.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from chromafield.schemas import IMU, PARTICLE_CORE, RAW_IQ
from chromafield.session import configure

# Record layouts (field, type, byte offset).
IQ_DTYPE = np.dtype([("i", "<f4"), ("q", "<f4")])
IMU_DTYPE = np.dtype(
    {
        "names": ["counter", "buttons", "stick_l", "stick_r", "accel", "gyro", "timestamp_us"],
        "formats": ["<u4", "<u4", "<u4", "<u4", ("<f4", 3), ("<f4", 3), "<u8"],
        "offsets": [4, 8, 12, 16, 44, 56, 68],
        "itemsize": 100,
    }
)
CORPUS_DTYPE = np.dtype(
    {
        "names": [
            "position", "covariance", "opacity", "color", "timestamp_us", "frequency_hz", "energy",
            "phase_coherence", "carrier_variance", "anomaly_score", "sensor_id_mask", "corpus_hash",
            "jury_flags",
        ],
        "formats": [
            ("<f4", 3), ("<f4", 6), "<f4", ("<f4", 4), "<u8", "<f4", "<f4", "<f4", "<f4", "<f4", "<u4",
            "V7", "u1",
        ],
        "offsets": [0, 12, 36, 40, 56, 64, 68, 72, 76, 80, 84, 88, 95],
        "itemsize": 128,
    }
)

RECORD_BYTES = {"iq": 8, "pcm16": 2, "pcm24": 3, "pcmf32": 4, "imu": 100, "corpus": 128}
SCHEMAS = {
    "iq": RAW_IQ, "pcm16": RAW_IQ, "pcm24": RAW_IQ, "pcmf32": RAW_IQ, "imu": IMU, "corpus": PARTICLE_CORE,
}
SAMPLED = ("iq", "pcm16", "pcm24", "pcmf32")
BATCH_RECORDS = 65_536
# second of the capture, then the microseconds and the number of the first sample, if known
_STAMP = re.compile(r"_(\d{8}T\d{6})(?:_(\d{6})us(?:_(\d+))?)?")
_BANNED = {"tests", "examples"}


def guard_path(path: str) -> None:
    """Test artefacts must never enter a production read."""
    if _BANNED & set(path.split("://")[-1].split("/")):
        raise ValueError(f"test files must not be used in production: {path}")


def _resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):  # Spark writes file:/x as well as file:///x
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def is_folder(path: str) -> bool:
    fs, inner = _resolve(path)
    return fs.get_file_info(inner).type == pafs.FileType.Directory


def list_files(path: str) -> list[pafs.FileInfo]:
    """The file itself, or all data files below a folder, in name order."""
    fs, inner = _resolve(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [info]
    below = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(
        (f for f in below if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))),
        key=lambda f: f.path,
    )


def start_of(name: str, default: int) -> tuple[int, int]:
    """Time in microseconds and number of a file's first sample: from its name, else the default."""
    found = _STAMP.search(name)
    if not found:
        return default, 0
    at = datetime.strptime(found.group(1), "%Y%m%dT%H%M%S").replace(tzinfo=timezone.utc)
    return int(at.timestamp()) * 1_000_000 + int(found.group(2) or 0), int(found.group(3) or 0)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: one without a scheme is in Hadoop's default one."""
    if "://" in path or path.startswith("file:"):
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


@dataclass
class Span:
    """A run of whole records in one file."""

    path: str
    first: int
    count: int
    start_us: int  # of the capture's sample 0
    before: int = 0  # samples of the capture in earlier files


ZONE_RECORDS = 65_536


def zone_path(path: str) -> str:
    """The zone map of a data file: hidden, so that no reader takes it for data."""
    folder, name = posixpath.split(path)
    return posixpath.join(folder, f"_{name}.zones")


class ZoneMap:
    """Least and greatest time per block of ``ZONE_RECORDS`` records, as they are written."""

    def __init__(self, block: int | None = None):
        self.block, self.records, self.zones = block or ZONE_RECORDS, 0, []
        self.rest = np.empty(0, np.int64)

    def add(self, times: np.ndarray) -> None:
        self.records += len(times)
        self.rest = np.concatenate([self.rest, times.astype(np.int64)])
        while len(self.rest) >= self.block:
            self._close(self.block)

    def _close(self, count: int) -> None:
        part, self.rest = self.rest[:count], self.rest[count:]
        self.zones.append((int(part.min()), int(part.max())))

    def dump(self) -> bytes:
        """Records per block, records in all, and the pairs, as 64-bit integers."""
        if len(self.rest):
            self._close(len(self.rest))
        return np.array([(self.block, self.records), *self.zones], "<i8").tobytes()


def load_zones(fs: pafs.FileSystem, path: str) -> tuple[int, int, np.ndarray] | None:
    """``(records per block, records covered, pairs)`` of a data file, if it has a zone map."""
    beside = zone_path(path)
    if fs.get_file_info(beside).type != pafs.FileType.File:
        return None
    with fs.open_input_file(beside) as handle:
        rows = np.frombuffer(handle.read(), "<i8").reshape(-1, 2)
    return int(rows[0, 0]), int(rows[0, 1]), rows[1:]


class Spans(InputPartition):
    def __init__(self, spans: list[Span]):
        self.spans = spans


def _fixed_list(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    offsets = pa.array(np.arange(0, values.size + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).reshape(-1)))


def _pcm(raw: bytes, fmt: str) -> np.ndarray:
    """Mono samples as floats in [-1, 1]."""
    if fmt == "pcmf32":
        return np.frombuffer(raw, "<f4")
    if fmt == "pcm16":
        return np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(2**15)
    octets = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    value = octets[:, 0] | (octets[:, 1] << 8) | (octets[:, 2] << 16)
    return ((value ^ 0x800000) - 0x800000).astype(np.float32) / np.float32(2**23)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, fmt: str):
        self.fmt = fmt
        self.size = RECORD_BYTES[fmt]
        self.path = options["path"]
        self.rate = float(options.get("samplerate", 0) or 0)
        self.sensor = int(options.get("sensorid", 0))
        self.start = int(options.get("startus", 0))
        self.split = max(self.size, int(options.get("splitbytes", 64 << 20)))
        # least and greatest time that is asked for
        self.lo = int(options["fromus"]) if "fromus" in options else None
        self.hi = int(options["untilus"]) - 1 if "untilus" in options else None
        if fmt in SAMPLED and self.rate <= 0:
            raise ValueError("sampleRate is required for sample files")

    def _bounds(self, records: int, start_us: int) -> tuple[int, int]:
        first, last = 0, records
        if self.lo is not None:
            first = max(first, int((self.lo - start_us) * self.rate / 1e6) - 1)
        if self.hi is not None:
            last = min(last, int((self.hi - start_us) * self.rate / 1e6) + 2)
        return first, last

    def _span(self, path: str, name: str, first: int, count: int) -> Span:
        start, before = start_of(name, self.start)
        if self.fmt in SAMPLED:
            start -= int(np.floor(before * (1e6 / self.rate)))
        return Span(path, first, count, start, before)

    def _tasks(self, spans: list[Span]) -> list[Spans]:
        """Spans cut to ``splitBytes``; small ones share a task."""
        tasks: list[list[Span]] = []
        room, step = 0, self.split // self.size
        for span in spans:
            first, last = span.first, span.first + span.count
            while first < last:
                count = min(step, last - first)
                if not tasks or room < count:
                    tasks.append([])
                    room = step
                tasks[-1].append(Span(span.path, first, count, span.start_us, span.before))
                room -= count
                first += count
        return [Spans(t) for t in tasks]

    def partitions(self):
        spans = []
        for info in list_files(self.path):
            guard_path(info.path)
            if info.size % self.size:
                raise ValueError(f"{info.path}: size {info.size} does not divide by {self.size}")
            for first, last in self._ranges(info):
                spans.append(self._span(info.path, info.base_name, first, max(last - first, 0)))
        return self._tasks(spans) or [Spans([])]

    def _ranges(self, info: pafs.FileInfo) -> list[tuple[int, int]]:
        """Record ranges of a file that the time bounds leave."""
        records = info.size // self.size
        if self.fmt in SAMPLED:
            return [self._bounds(records, start_of(info.base_name, self.start)[0])]
        zones = None
        if self.lo is not None or self.hi is not None:
            zones = load_zones(_resolve(self.path)[0], info.path)
        if zones is None:
            return [(0, records)]
        block, covered, pairs = zones
        hit = np.ones(len(pairs), bool)
        if self.lo is not None:
            hit &= pairs[:, 1] >= self.lo
        if self.hi is not None:
            hit &= pairs[:, 0] <= self.hi
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        found = [(int(a) * block, min(int(b) * block, covered)) for a, b in zip(edge[::2], edge[1::2])]
        # what was appended after the map was made
        return found + ([(covered, records)] if records > covered else [])

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        fs, _ = _resolve(self.path)
        for span in partition.spans:
            with fs.open_input_file(span.path) as handle:
                handle.seek(span.first * self.size)
                done = 0
                while done < span.count:
                    n = min(BATCH_RECORDS, span.count - done)
                    raw = handle.read(n * self.size)
                    yield self._decode(raw, span, span.first + done, n)
                    done += n

    def _decode(self, raw: bytes, span: Span, first: int, n: int) -> pa.RecordBatch:
        if self.fmt in SAMPLED:
            index = np.arange(span.before + first, span.before + first + n, dtype=np.int64)
            if self.fmt == "iq":
                rec = np.frombuffer(raw, IQ_DTYPE)
                i, q = rec["i"], rec["q"]
            else:
                i = _pcm(raw, self.fmt)
                q = np.zeros(n, np.float32)
            stamps = span.start_us + np.floor(index * (1e6 / self.rate)).astype(np.int64)
            none = np.zeros(n, np.int32)
            columns = [
                pa.array(np.ascontiguousarray(i)),
                pa.array(np.ascontiguousarray(q)),
                pa.array(stamps),
                pa.array(np.full(n, self.sensor, np.int64)),
                pa.array(none),
                pa.array(none),
                pa.array([posixpath.basename(span.path)]).take(pa.array(none)),
                pa.array(index),
            ]
            return pa.RecordBatch.from_arrays(columns, names=RAW_IQ.names)
        if self.fmt == "imu":
            rec = np.frombuffer(raw, IMU_DTYPE)
            columns = [pa.array(rec[c].astype(np.int64)) for c in ("counter", "buttons", "stick_l", "stick_r")]
            columns += [_fixed_list(rec["accel"]), _fixed_list(rec["gyro"])]
            columns.append(pa.array(rec["timestamp_us"].astype(np.int64)))
            return pa.RecordBatch.from_arrays(columns, names=IMU.names)
        rec = np.frombuffer(raw, CORPUS_DTYPE)
        columns = []
        for name in CORPUS_DTYPE.names:
            if name in ("position", "covariance", "color"):
                columns.append(_fixed_list(rec[name]))
            elif name == "corpus_hash":
                columns.append(pa.array([v.tobytes() for v in rec[name]], pa.binary()))
            elif name in ("timestamp_us", "sensor_id_mask"):
                columns.append(pa.array(rec[name].astype(np.int64)))
            elif name == "jury_flags":
                columns.append(pa.array(rec[name].astype(np.int16)))
            else:
                columns.append(pa.array(np.ascontiguousarray(rec[name])))
        return pa.RecordBatch.from_arrays(columns, names=list(CORPUS_DTYPE.names))


class RecordStreamReader(RecordReader, DataSourceStreamReader):
    """Growing capture folders: an offset holds the bytes read of each file.

    A batch ends at the last whole record that each file holds when the batch is planned; what a
    recorder appends later, or the rest of a half-written record, belongs to a later batch.  The
    ranges of a batch follow from its two offsets alone, so a batch that is planned again after
    a failure or a restart reads the same bytes.  New files may appear under any name.  A file
    that has become shorter than what was read of it raises; one that was removed is left out.

    ``maxBytesPerTrigger`` bounds a batch once the stream's position is known, that is from the
    second batch after a start on; files are taken in name order.
    """

    def __init__(self, options: dict, fmt: str):
        super().__init__(options, fmt)
        self.most = int(options.get("maxbytespertrigger", 0) or 0)
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {}
        room = self.most if self.most and self.at is not None else None
        for info in list_files(self.path):
            guard_path(info.path)
            whole = info.size - info.size % self.size
            if room is not None:
                known = self.at.get(info.path, 0)
                take = max(min(whole - known, room - room % self.size), 0)
                room, whole = room - take, max(known + take, min(known, whole))
            if whole:
                now[info.path] = whole
        return now

    def partitions(self, start: dict, end: dict):
        spans = []
        for path, size in sorted(end.items()):
            known = start.get(path, 0)
            if size < known:
                raise ValueError(f"{path} has shrunk from {known} to {size} bytes under the stream")
            if size > known:
                first = known // self.size
                spans.append(self._span(path, posixpath.basename(path), first, size // self.size - first))
        self.at = end
        return self._tasks(spans)

    def commit(self, end: dict) -> None:
        self.at = end


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


def _column(table: pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(table.schema.get_field_index(name))
    if column.null_count:
        raise ValueError(f"a record cannot hold the nulls of {name}")
    return column.to_numpy(zero_copy_only=False)


def encode(batch: pa.RecordBatch, fmt: str) -> bytes:
    """Arrow batch to records of one format."""
    if fmt == "iq":
        out = np.empty(batch.num_rows, IQ_DTYPE)
        out["i"], out["q"] = _column(batch, "i"), _column(batch, "q")
        return out.tobytes()
    if fmt.startswith("pcm"):
        x = _column(batch, "i").astype(np.float64)
        if fmt == "pcmf32":
            return x.astype("<f4").tobytes()
        bits = 16 if fmt == "pcm16" else 24
        top = 2 ** (bits - 1)
        whole = np.clip(np.rint(x * top), -top, top - 1).astype(np.int32)
        if fmt == "pcm16":
            return whole.astype("<i2").tobytes()
        return whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    dtype = IMU_DTYPE if fmt == "imu" else CORPUS_DTYPE
    out = np.zeros(batch.num_rows, dtype)
    for name in dtype.names:
        if dtype[name].shape:
            lists = batch.column(batch.schema.get_field_index(name))
            if lists.null_count or lists.flatten().null_count:
                raise ValueError(f"a record cannot hold the nulls of {name}")
            out[name] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dtype[name].shape[0])
        elif name == "corpus_hash":
            values = batch.column(batch.schema.get_field_index(name)).to_pylist()
            out[name] = [np.void((v or b"").ljust(7, b"\0")[:7]) for v in values]
        else:
            out[name] = _column(batch, name)
    raw = bytearray(out.tobytes())
    if fmt == "imu":  # every packet opens with the fixed word 1
        view = np.frombuffer(raw, np.uint8).reshape(-1, 100)
        view[:, 0] = 1
    return bytes(raw)


class RecordWriter(DataSourceArrowWriter):
    """Each task writes its own files under hidden names; the commit makes them visible.

    Nothing is ever overwritten or deleted except the hidden files of a failed job.
    Particles go to one file per UTC day and task.
    """

    def __init__(self, options: dict, fmt: str):
        self.fmt = fmt
        self.path = options["path"]
        self.prefix = options.get("prefix", "corpus" if fmt == "corpus" else "rx_capture")
        guard_path(self.path)

    def _name(self, batch: pa.RecordBatch) -> str:
        if "timestamp_us" not in batch.schema.names or batch.num_rows == 0:
            return self.prefix
        first = int(_column(batch, "timestamp_us")[0])
        at = datetime.fromtimestamp(first // 1_000_000, timezone.utc)
        if self.fmt == "corpus":
            return f"{self.prefix}_{at:%Y%m%d}"
        name = f"{self.prefix}_{at:%Y%m%dT%H%M%S}_{first % 1_000_000:06d}us"
        if "sample_index" in batch.schema.names:
            name += f"_{int(_column(batch, 'sample_index')[0])}"
        return name

    def _split(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.fmt != "corpus" or batch.num_rows == 0:
            yield batch
            return
        days = _column(batch, "timestamp_us") // 86_400_000_000
        for day in np.unique(days):
            yield batch.filter(pa.array(days == day))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _resolve(self.path)
        fs.create_dir(root, recursive=True)
        token = uuid.uuid4().hex[:12]
        extension = {"iq": "iq", "imu": "imu", "corpus": "bin"}.get(self.fmt, "pcm")
        handles, moves, zones = {}, [], {}
        for batch in iterator:
            for part in self._split(batch):
                # a sample file is one continuous run: the first batch names it
                name = self._name(part) if self.fmt == "corpus" or not handles else next(iter(handles))
                if name not in handles:
                    hidden = f"{root}/_{name}-{token}.{extension}"
                    handles[name] = fs.open_output_stream(hidden)
                    moves.append((hidden, f"{root}/{name}-{token}.{extension}"))
                handles[name].write(encode(part, self.fmt))
                if self.fmt not in SAMPLED:
                    zones.setdefault(name, ZoneMap()).add(_column(part, "timestamp_us"))
        for handle in handles.values():
            handle.close()
        for name, zone in zones.items():
            hidden = f"{root}/__{name}-{token}.zones"
            with fs.open_output_stream(hidden) as out:
                out.write(zone.dump())
            moves.append((hidden, zone_path(f"{root}/{name}-{token}.{extension}")))
        return Written(moves)

    def commit(self, messages) -> None:
        fs, _ = _resolve(self.path)
        for message in messages:
            for hidden, final in message.moves if message else []:
                fs.move(hidden, final)

    def abort(self, messages) -> None:
        fs, _ = _resolve(self.path)
        for message in messages:
            for hidden, _ in message.moves if message else []:
                fs.delete_file(hidden)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chromafield_records"

    def _fmt(self) -> str:
        fmt = self.options.get("format", "iq")
        if fmt not in RECORD_BYTES:
            raise ValueError(f"unknown record format {fmt}")
        return fmt

    def schema(self) -> T.StructType:
        return SCHEMAS[self._fmt()]

    def reader(self, schema) -> RecordReader:
        guard_path(self.options["path"])
        return RecordReader(self.options, self._fmt())

    def streamReader(self, schema) -> RecordStreamReader:
        guard_path(self.options["path"])
        return RecordStreamReader(self.options, self._fmt())

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, self._fmt())


#: a time range [from, until) in microseconds
Range = tuple[int, int]


def _records(spark: SparkSession, fmt: str, path: str, between: Range | None, **options) -> DataFrame:
    guard_path(path)
    path = qualified(spark, path)
    spark.dataSource.register(RecordSource)
    configure(spark)
    reader = spark.read.format("chromafield_records").option("format", fmt)
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    if between is None:
        return reader.load(path)
    rows = reader.option("fromUs", str(between[0])).option("untilUs", str(between[1])).load(path)
    return rows.where((F.col("timestamp_us") >= between[0]) & (F.col("timestamp_us") < between[1]))


def read_iq(
    spark: SparkSession,
    path: str,
    sample_rate: float,
    sensor_id: int = 0,
    start_us: int = 0,
    split_bytes: int | None = None,
    between: Range | None = None,
) -> DataFrame:
    """Interleaved float I/Q samples; the start comes from the file name where it has one."""
    return _records(
        spark, "iq", path, between, sampleRate=sample_rate, sensorId=sensor_id, startUs=start_us, splitBytes=split_bytes
    )


def read_pcm(
    spark: SparkSession,
    path: str,
    rate: float,
    fmt: str = "pcm16",
    sensor_id: int = 0,
    start_us: int = 0,
    split_bytes: int | None = None,
    between: Range | None = None,
) -> DataFrame:
    """Mono audio: ``i`` is the sample and ``q`` is zero.  ``fmt``: pcm16, pcm24 or pcmf32."""
    if not fmt.startswith("pcm"):
        raise ValueError(f"unknown audio format {fmt}")
    return _records(
        spark, fmt, path, between, sampleRate=rate, sensorId=sensor_id, startUs=start_us, splitBytes=split_bytes
    )


def read_imu(
    spark: SparkSession, path: str, split_bytes: int | None = None, between: Range | None = None
) -> DataFrame:
    """100-byte motion packets."""
    return _records(spark, "imu", path, between, splitBytes=split_bytes)


def read_corpus_bin(
    spark: SparkSession, path: str, split_bytes: int | None = None, between: Range | None = None
) -> DataFrame:
    """Daily files of 128-byte particles."""
    return _records(spark, "corpus", path, between, splitBytes=split_bytes)


def stream_records(
    spark: SparkSession,
    fmt: str,
    path: str,
    rate: float | None = None,
    sensor_id: int = 0,
    start_us: int = 0,
    split_bytes: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Stream over a folder (or file) of records of any format that recorders still write to.

    ``rate`` is needed for sample formats; ``max_bytes`` bounds a micro-batch.
    """
    guard_path(path)
    path = qualified(spark, path)
    spark.dataSource.register(RecordSource)
    configure(spark)
    options = {
        "format": fmt, "sampleRate": rate, "sensorId": sensor_id, "startUs": start_us,
        "splitBytes": split_bytes, "maxBytesPerTrigger": max_bytes,
    }
    reader = spark.readStream.format("chromafield_records")
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)


def index_records(spark: SparkSession, path: str, fmt: str, block_records: int = ZONE_RECORDS) -> int:
    """Make zone maps for the packet or particle files of a folder that have none, or have grown.

    Files that this module wrote have theirs already.  Tasks read a file each, block by block, and
    write its map beside it; the number of files that got one is returned.
    """
    if fmt in SAMPLED:
        raise ValueError("sample files are pruned by arithmetic")
    guard_path(path)
    path = qualified(spark, path)
    fs, size = _resolve(path)[0], RECORD_BYTES[fmt]
    todo = []
    for info in list_files(path):
        known = load_zones(fs, info.path)
        if known is None or known[1] != info.size // size:
            todo.append((info.path, info.size // size))
    dtype = IMU_DTYPE if fmt == "imu" else CORPUS_DTYPE

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _resolve(path)[0]
        for batch in batches:
            for name, records in zip(*(c.to_pylist() for c in batch.columns)):
                zone = ZoneMap(block_records)
                with files.open_input_file(name) as handle:
                    for first in range(0, records, block_records):
                        raw = handle.read(min(block_records, records - first) * size)
                        zone.add(np.frombuffer(raw, dtype)["timestamp_us"])
                hidden = zone_path(name) + f"-{uuid.uuid4().hex[:8]}"
                with files.open_output_stream(hidden) as out:
                    out.write(zone.dump())
                files.move(hidden, zone_path(name))
            yield batch

    if not todo:
        return 0
    listed = spark.createDataFrame(todo, "path string, records long")
    return listed.repartition(min(len(todo), 1024)).mapInArrow(build, listed.schema).count()


def write_records(df: DataFrame, path: str, fmt: str, prefix: str | None = None) -> None:
    """Write captures, packets or particles.

    Samples with a time are put in its order: each file is a stretch of time, named after the
    microsecond and, where there is a ``sample_index``, the number of its first sample, so that
    reading at the same rate gives every sample its own time again.  Samples are taken as evenly
    spaced within a file.  Without a time, order within a file is the task's row order.  Nulls
    have no place in a record and raise.
    """
    guard_path(path)
    path = qualified(df.sparkSession, path)
    df.sparkSession.dataSource.register(RecordSource)
    columns = [f.name for f in SCHEMAS[fmt].fields if f.name in df.columns]
    rows = df.select(*columns)
    order = [c for c in ("timestamp_us", "sample_index") if c in columns]
    if fmt in SAMPLED and "timestamp_us" in order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.write.format("chromafield_records").option("format", fmt).mode("append")
    if prefix:
        writer = writer.option("prefix", prefix)
    writer.save(path)
