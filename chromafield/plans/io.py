"""Queries for sources and sinks: tables are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromafield.functions import block_hash, hash_prefix, parse_note
from chromafield.operators import aggregates as A
from chromafield.plans.bindings import HOUR_US, MINUTE_US, OBS_SQL, Tables, query, rounded
from chromafield.plans.spatial import _POLE_SQL, _stored_pole
from chromafield.session import scratch_path
from chromafield.sources import captures, sinks, tables

c = F.col
T0 = 1_704_067_200_000_000


@query(
    "iq_capture_roundtrip",
    "A1 A7",
    f"""WITH {OBS_SQL} SELECT CAST(count(*) AS BIGINT) AS n, round(sum(CAST(CAST(re AS FLOAT) AS DOUBLE)), 4) AS sum_i,
      round(sum(CAST(CAST(im AS FLOAT) AS DOUBLE)), 4) AS sum_q,
      round(sum(CAST(CAST(re AS FLOAT) AS DOUBLE) ** 2 + CAST(CAST(im AS FLOAT) AS DOUBLE) ** 2), 4) AS power FROM obs""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "iq")
    samples = t.obs.select(c("re").cast("float").alias("i"), c("im").cast("float").alias("q"))
    captures.write_records(samples, path, "iq")
    back = captures.read_iq(t.spark, path, 48_000.0, split_bytes=1 << 16)
    i, q = c("i").cast("double"), c("q").cast("double")
    return rounded(
        back.agg(F.count("*").alias("n"), F.sum(i).alias("sum_i"), F.sum(q).alias("sum_q"), F.sum(i * i + q * q).alias("power")), 4
    )


@query(
    "pcm_roundtrip",
    "A2",
    f"""WITH {OBS_SQL} SELECT 'pcm16' AS format, CAST(count(*) AS BIGINT) AS n,
      round(sum(least(greatest(round_even(CAST(CAST(re AS FLOAT) AS DOUBLE) * 32768, 0), -32768), 32767) / 32768), 4) AS total FROM obs
    UNION ALL SELECT 'pcm24', CAST(count(*) AS BIGINT),
      round(sum(least(greatest(round_even(CAST(CAST(re AS FLOAT) AS DOUBLE) * 8388608, 0), -8388608), 8388607) / 8388608), 4) FROM obs
    UNION ALL SELECT 'pcmf32', CAST(count(*) AS BIGINT), round(sum(CAST(CAST(re AS FLOAT) AS DOUBLE)), 4) FROM obs""",
)
def _(t: Tables):
    samples = t.obs.select(c("re").cast("float").alias("i"))
    out = None
    for fmt in ("pcm16", "pcm24", "pcmf32"):
        path = scratch_path(t.spark, fmt)
        captures.write_records(samples, path, fmt)
        back = captures.read_pcm(t.spark, path, 48_000.0, fmt)
        part = back.agg(F.count("*").alias("n"), F.sum(c("i").cast("double")).alias("total")).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


@query(
    "imu_packets_roundtrip",
    "A3",
    f"""WITH {OBS_SQL} SELECT particle_id AS counter, CAST(1 << layer AS BIGINT) AS buttons, timestamp_us,
      round(CAST(CAST(re AS FLOAT) AS DOUBLE), 6) + 0e0 AS ax, round(CAST(CAST(im AS FLOAT) AS DOUBLE), 6) + 0e0 AS gz FROM obs""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "imu")
    re, im = c("re").cast("float"), c("im").cast("float")
    zero = F.lit(0.0).cast("float")
    packets = t.obs.select(
        c("particle_id").alias("counter"),
        F.expr("shiftleft(1L, layer)").alias("buttons"),
        F.lit(0).cast("long").alias("stick_l"),
        F.lit(0).cast("long").alias("stick_r"),
        F.array(re, zero, zero).alias("accel"),
        F.array(zero, zero, im).alias("gyro"),
        "timestamp_us",
    )
    captures.write_records(packets, path, "imu", "imu")
    back = captures.read_imu(t.spark, path)
    return rounded(
        back.select("counter", "buttons", "timestamp_us", c("accel")[0].alias("ax"), c("gyro")[2].alias("gz"))
    )


def _particles(t: Tables):
    digest = block_hash(c("particle_id").cast("string"), c("timestamp_us"), c("sensor_id").cast("string"))

    def floats(*cols):
        return F.array(*[F.coalesce(x.cast("float"), F.lit(0.0).cast("float")) for x in cols])

    zero = F.lit(0.0)
    return t.obs.select(
        floats(c("x"), c("y"), c("z")).alias("position"),
        floats(zero, zero, zero, zero, zero, zero).alias("covariance"),
        F.lit(1.0).cast("float").alias("opacity"),
        floats(zero, zero, zero, zero + 1).alias("color"),
        "timestamp_us",
        c("frequency_hz").cast("float").alias("frequency_hz"),
        c("energy").cast("float").alias("energy"),
        F.lit(0.5).cast("float").alias("phase_coherence"),
        F.lit(0.1).cast("float").alias("carrier_variance"),
        F.lit(0.0).cast("float").alias("anomaly_score"),
        F.expr("shiftleft(1L, sensor_id)").alias("sensor_id_mask"),
        hash_prefix(digest).alias("corpus_hash"),
        c("layer").cast("short").alias("jury_flags"),
    )


_PARTICLE_SQL = f"""WITH {OBS_SQL} SELECT timestamp_us, CAST(1 << sensor_id AS BIGINT) AS sensor_id_mask, CAST(layer AS INT) AS jury_flags,
      round(CAST(CAST(energy AS FLOAT) AS DOUBLE), 6) AS energy, x, z,
      upper(substr(sha256(concat(particle_id, timestamp_us, sensor_id)), 1, 14)) AS corpus_hash FROM obs"""


def _particle_view(df):
    return rounded(
        df.select(
            "timestamp_us",
            "sensor_id_mask",
            c("jury_flags").cast("int").alias("jury_flags"),
            "energy",
            c("position")[0].cast("double").alias("x"),
            c("position")[2].cast("double").alias("z"),
            F.hex("corpus_hash").alias("corpus_hash"),
        )
    )


@query("corpus_binary_roundtrip", "A4", _PARTICLE_SQL)
def _(t: Tables):
    path = scratch_path(t.spark, "corpus")
    captures.write_records(_particles(t), path, "corpus")
    return _particle_view(captures.read_corpus_bin(t.spark, path))


@query(
    "corpus_time_range",
    "A4",
    f"""WITH {OBS_SQL}, m AS (SELECT min(timestamp_us) AS lo, max(timestamp_us) AS hi FROM obs)
    SELECT timestamp_us, CAST(1 << sensor_id AS BIGINT) AS sensor_id_mask, CAST(layer AS INT) AS jury_flags,
      round(CAST(CAST(energy AS FLOAT) AS DOUBLE), 6) AS energy, x, z,
      upper(substr(sha256(concat(particle_id, timestamp_us, sensor_id)), 1, 14)) AS corpus_hash
    FROM obs, m WHERE timestamp_us >= lo + (hi - lo) // 3 AND timestamp_us < lo + (hi - lo) // 3 + 6 * {HOUR_US}""",
)
def _(t: Tables):
    """Six hours of the stored corpus: only the blocks whose zone maps meet them are opened."""
    path = scratch_path(t.spark, "corpus")
    captures.write_records(_particles(t), path, "corpus")
    lo, hi = t.obs.agg(F.min("timestamp_us"), F.max("timestamp_us")).first()
    start = lo + (hi - lo) // 3
    return _particle_view(captures.read_corpus_bin(t.spark, path, between=(start, start + 6 * HOUR_US)))


@query("corpus_jsonl_roundtrip", "A5 A8", _PARTICLE_SQL)
def _(t: Tables):
    path = scratch_path(t.spark, "corpus")
    sinks.append_corpus(_particles(t), path)
    return _particle_view(tables.read_corpus_jsonl(t.spark, f"{path}/events_jsonl"))


@query(
    "corpus_days",
    "A8 I2",
    f"""WITH {OBS_SQL} SELECT strftime(make_timestamp(timestamp_us), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "corpus")
    half = T0 + 15 * 86_400_000_000
    for part in (_particles(t).where(c("timestamp_us") < half), _particles(t).where(c("timestamp_us") >= half)):
        sinks.append_corpus(part, path)
    stored = t.spark.read.schema("timestamp_us long, day date").parquet(f"{path}/particles")
    return stored.groupBy(c("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(
    "capture_catalogue",
    "A6 I1",
    f"""WITH {OBS_SQL} SELECT CAST(count(*) AS BIGINT) AS samples, TRUE AS valid, round(count(*) / 48000.0, 6) AS duration_s FROM obs""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "catalogue")
    samples = t.obs.select(c("re").cast("float").alias("i"), c("im").cast("float").alias("q"))
    captures.write_records(samples, path, "iq", "rx_rtl_20240101T000000")
    files = tables.capture_catalog(t.spark, path, 48_000.0)
    return rounded(
        files.agg(F.sum("samples").alias("samples"), F.bool_and("valid").alias("valid"), F.sum("duration_s").alias("duration_s"))
    )


@query(
    "csi_points",
    "A10",
    """WITH u AS (SELECT vec_id AS packet_id, unnest(range(0, 32)) AS subcarrier, embedding FROM embeddings)
    SELECT packet_id, subcarrier, round(CAST(embedding[2 * subcarrier + 1] AS DOUBLE), 6) AS re,
      round(CAST(embedding[2 * subcarrier + 2] AS DOUBLE), 6) AS im FROM u""",
)
def _(t: Tables):
    h = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.struct(
            F.get("embedding", i * 2).cast("double").alias("re"), F.get("embedding", i * 2 + 1).cast("double").alias("im")
        ),
    )
    packets = t.windows.select(c("vec_id").alias("packet_id"), h.alias("h"))
    out = tables.csi_points(packets, keep=["packet_id"])
    return rounded(out.withColumn("subcarrier", c("subcarrier").cast("long")))


# ---- observations and notes ----------------------------------------------------------


@query(
    "observation_store",
    "A11 A12",
    f"""WITH {OBS_SQL} SELECT particle_id AS id, timestamp_us, k > 95 AS significant FROM obs""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "observations")
    obs = t.obs.select(c("particle_id").alias("id"), "timestamp_us", "k", F.lit(False).alias("significant"))
    sinks.store_observation(obs.where("layer < 2"), path)
    sinks.store_observation(obs.where("layer >= 2"), path)
    stored = t.spark.read.schema("id long, timestamp_us long, k int, significant boolean").parquet(path)
    return sinks.mark_significant(stored, stored.where("k > 95").select("id")).select("id", "timestamp_us", "significant")


def _notes(t: Tables):
    """Documents as notes: the front matter holds values of the table, the body its text."""
    at = F.lit(T0) + c("doc_id") * F.lit(60 * MINUTE_US)
    head = F.concat(
        F.lit("---\ntimestamp: "),
        F.date_format(F.timestamp_micros(at), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("\nsensor_ids: ["),
        c("doc_id") % 8,
        F.lit(", "),
        (c("doc_id") + 3) % 8,
        F.lit("]\nmemory_obs_ids: ["),
        c("doc_id") * 7,
        F.lit("]\nconfidence: "),
        (c("doc_id") % 100) / F.lit(100.0),
        F.lit("\ntags: ["),
        c("source"),
        F.lit(", "),
        c("lang"),
        F.lit("]\n---\n"),
    )
    return t.documents.select(
        c("doc_id"), at.alias("timestamp_us"), parse_note(F.concat(head, c("text"))).alias("n")
    ).select("doc_id", "timestamp_us", c("doc_id").cast("string").alias("path"), "n.*")


@query(
    "note_front_matter",
    "A13",
    f"""SELECT doc_id, strftime(make_timestamp({T0} + doc_id * {60 * MINUTE_US}), '%Y-%m-%dT%H:%M:%S') AS timestamp,
      (doc_id % 8) || ',' || ((doc_id + 3) % 8) AS sensors, round((doc_id % 100) / 100.0, 6) AS confidence,
      source || ',' || lang AS tags, CAST(length(text) AS BIGINT) AS body_chars, md5(text) AS body_md5 FROM documents""",
)
def _(t: Tables):
    return rounded(
        _notes(t).select(
            "doc_id",
            c("timestamp"),
            F.array_join("sensor_ids", ",").alias("sensors"),
            "confidence",
            F.array_join("tags", ",").alias("tags"),
            F.length("body").cast("long").alias("body_chars"),
            F.md5(c("body").cast("binary")).alias("body_md5"),
        )
    )


@query(
    "note_references",
    "I10",
    """SELECT CAST(doc_id AS VARCHAR) AS path, doc_id * 7 AS obs_id FROM documents
    WHERE doc_id * 7 IN (SELECT event_id FROM events)""",
)
def _(t: Tables):
    return tables.note_refs(_notes(t), t.obs.select(c("particle_id").alias("id"))).select("path", "obs_id")


@query(
    "note_search",
    "A13 C1",
    f"""SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND lang = 'en'
      AND strftime(make_timestamp({T0} + doc_id * {60 * MINUTE_US}), '%Y-%m-%dT%H:%M:%S') >= '2024-01-05'""",
)
def _(t: Tables):
    return tables.query_notes(_notes(t), text="The", tag="en", since="2024-01-05").select("doc_id")


@query(
    "weekly_synthesis",
    "E21",
    f"""WITH n AS (SELECT epoch_us(date_trunc('week', make_timestamp({T0} + doc_id * {60 * MINUTE_US}))) AS week_us,
        unnest([source, lang]) AS tag FROM documents)
    SELECT week_us, tag, CAST(count(*) AS BIGINT) AS notes, 'Observed ' || count(*) || ' instances of ' || tag AS line
    FROM n GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def _(t: Tables):
    return A.weekly_synthesis(_notes(t), 5)


@query(
    "event_exhibit",
    "A14 D16",
    f"""WITH {_POLE_SQL}, b AS (SELECT src AS s, dst AS d FROM edges UNION ALL SELECT dst, src FROM edges),
    near AS (SELECT 'event:100' AS id UNION SELECT d FROM b WHERE s = 'event:100'),
    ev AS (SELECT timestamp_us AS ts FROM obs WHERE particle_id = 100),
    r AS (SELECT obs.* FROM obs, ev WHERE timestamp_us BETWEEN ts - {30 * MINUTE_US} AND ts + {30 * MINUTE_US})
    SELECT 'corpus' AS part, CAST(count(*) AS BIGINT) AS rows FROM r
    UNION ALL SELECT 'nodes', CAST(count(*) AS BIGINT) FROM nodes WHERE id IN (SELECT id FROM near)
    UNION ALL SELECT 'edges', CAST(count(*) AS BIGINT) FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)
    UNION ALL SELECT 'hashes', CAST(count(*) AS BIGINT) FROM r
    UNION ALL SELECT 'times', CAST(count(*) AS BIGINT) FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.layer = 3
      AND b.timestamp_us BETWEEN a.timestamp_us - {5 * MINUTE_US} AND a.timestamp_us + {5 * MINUTE_US})""",
)
def _(t: Tables):
    nodes, edges = _stored_pole(t)
    digest = block_hash(c("k").cast("string"), c("timestamp_us"), c("sensor_id").cast("string"))
    corpus = t.obs.withColumn("corpus_hash", hash_prefix(digest))
    return sinks.export_exhibit(
        corpus, nodes, edges, 100, scratch_path(t.spark, "exhibit"), 30 * MINUTE_US,
        t.obs.where("layer = 3"), 5 * MINUTE_US, hops=1,
    )
