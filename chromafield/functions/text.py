"""Names, JSON lines, settings documents, notes and motif strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.schemas import MATERIALS, PARTICLE, SETTINGS

_CAPTURE = r"([A-Za-z0-9]+)_([A-Za-z0-9]+)_(\d{8}T\d{6})\.(\w+)$"
_SESSION = r"([A-Za-z0-9]+)_(\d{8}T\d{6})\.(\w+)$"

# Word lists for motif names.
ADJECTIVES = (
    "amber bold calm dark eager faint gentle hollow idle keen lucid mellow noble pale quiet rapid"
).split()
NOUNS = (
    "arc beacon chord drift echo flare ghost harbor iris kite lantern mirror needle orbit prism ripple"
).split()


def parse_capture_name(path: Column) -> Column:
    """Struct(kind, device, captured_at, extension) of ``rx_rtl_20240131T235959.iq``.

    Names without a device part (``session_...``) leave the device null.
    """
    full = F.regexp_extract(path, _CAPTURE, 3) != ""
    pattern_kind = F.when(full, F.regexp_extract(path, _CAPTURE, 1)).otherwise(
        F.nullif(F.regexp_extract(path, _SESSION, 1), F.lit(""))
    )
    stamp = F.when(full, F.regexp_extract(path, _CAPTURE, 3)).otherwise(
        F.regexp_extract(path, _SESSION, 2)
    )
    ext = F.when(full, F.regexp_extract(path, _CAPTURE, 4)).otherwise(
        F.nullif(F.regexp_extract(path, _SESSION, 3), F.lit(""))
    )
    return F.struct(
        pattern_kind.alias("kind"),
        F.when(full, F.regexp_extract(path, _CAPTURE, 2)).alias("device"),
        F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss")).alias("captured_at"),
        ext.alias("extension"),
    )


def corpus_day(timestamp_us: Column) -> Column:
    """UTC day a corpus row belongs to."""
    return F.to_date(F.timestamp_micros(timestamp_us))


def parse_particle(line: Column) -> Column:
    """JSON line to particle; a corrupt line keeps its text in ``_corrupt``."""
    schema = T.StructType(PARTICLE.fields + [T.StructField("_corrupt", T.StringType())])
    return F.from_json(
        line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )


def validate_settings(df: DataFrame, col: str = "settings") -> DataFrame:
    """Check settings documents: closed material list, three-part bounds, saturation 0 to 1.

    Adds ``parsed`` and ``violations``; a valid document has an empty array.
    """
    names = [name for name, _, _ in MATERIALS]
    out = df.withColumn("parsed", F.from_json(F.col(col), SETTINGS))
    p = F.col("parsed")

    def rule(broken: Column, text: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(text))

    rules = [
        rule(p.isNull() | p["material"].isNull(), "material missing"),
        rule(~p["material"].isin(names), "material unknown"),
        rule(p["center"].isNull() | (F.size(p["center"]) != 3), "center needs 3 numbers"),
        rule(p["size"].isNull() | (F.size(p["size"]) != 3), "size needs 3 numbers"),
        rule(F.exists(p["size"], lambda x: x <= 0), "size must be positive"),
        rule((p["wetness"] < 0) | (p["wetness"] > 1), "wetness outside 0..1"),
        rule(p["permittivity"] < 1, "permittivity below 1"),
        rule(p["conductivity"] < 0, "conductivity negative"),
    ]
    return out.withColumn("violations", F.array_compact(F.array(*rules)))


def motif_edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two motif sequences given as arrays of motif numbers.

    Each number becomes one character, that of its place among the numbers of the pair, so
    the built-in string distance applies whatever the numbers are.
    """
    numbers = F.array_distinct(F.concat(a, b))

    def word(seq: Column) -> Column:
        # characters above the two-byte ones, where no code point is reserved
        return F.array_join(
            F.transform(
                seq,
                lambda m: F.decode(
                    F.unhex(F.lpad(F.hex(F.array_position(numbers, m) + F.lit(0x10000)), 8, "0")), "UTF-32"
                ),
            ),
            "",
        )

    return F.levenshtein(word(a), word(b))


def motif_name(motif_id: Column) -> Column:
    """Stable adjective-noun name.  Choice: both words are drawn from the MD5 of the id."""
    digest = F.md5(motif_id.cast("string").cast("binary"))

    def word(words: list[str], start: int) -> Column:
        number = F.conv(F.substring(digest, start, 7), 16, 10).cast("int")
        return F.element_at(F.array(*map(F.lit, words)), F.pmod(number, F.lit(len(words))) + 1)

    return F.concat_ws("-", word(ADJECTIVES, 1), word(NOUNS, 8))


def parse_note(text: Column) -> Column:
    """Front matter of a note as a struct, plus the body.

    Front matter stands between two ``---`` lines at the start, one ``key: value``
    per line; lists are written in brackets.
    """
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)

    def scalar(key: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))

    def items(key: str) -> Column:
        inner = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*?)\]", 1)
        parts = F.transform(F.split(inner, ","), lambda x: F.trim(x))
        return F.filter(parts, lambda x: x != "")

    return F.struct(
        scalar("timestamp").alias("timestamp"),
        items("sensor_ids").alias("sensor_ids"),
        items(r"\w*obs_ids").alias("obs_ids"),
        scalar("confidence").try_cast("double").alias("confidence"),
        items("tags").alias("tags"),
        F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "").alias("body"),
    )


def event_line(df: DataFrame) -> DataFrame:
    """Plain-language line for each verdict row (``verdict`` of the aggregates module)."""
    outcome = F.when(F.col("dissenter").isNull(), F.lit("unanimous")).otherwise(
        F.concat(F.lit("voter "), F.col("dissenter").cast("string"), F.lit(" dissents"))
    )
    return df.withColumn(
        "event_line",
        F.format_string(
            "%d of %d voters flag an anomaly (%s)",
            F.col("yes_votes"),
            F.col("n_votes"),
            outcome,
        ),
    )


def is_diagnostic(c: Column) -> Column:
    """NaN is a diagnostic value; it is reported, never filled."""
    return F.coalesce(F.isnan(c), F.lit(False))
