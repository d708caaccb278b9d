"""SQL names for the column functions, as SQL-bodied functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from chromafield.schemas import ANCHOR_F4_HZ, F_MIN_HZ, LOG_RANGE

_FOLDED = "f / pow(2, greatest(0, ceil(log2(f / 1000) - 1e-9D)))"
_BODIES = {
    "freq_to_hue(f DOUBLE) RETURNS DOUBLE":
        f"CASE WHEN f IS NOT NULL THEN "
        f"least(1.0D, ln(greatest(f, {F_MIN_HZ}D) / {F_MIN_HZ}D) / {LOG_RANGE!r}D) END",
    "freq_to_material_id(f DOUBLE) RETURNS INT":
        f"CASE WHEN f > 0 THEN pmod(CAST(round(12 * log2(f / {ANCHOR_F4_HZ}D)) AS INT) + 5, 12) END",
    "octave_fold(f DOUBLE) RETURNS DOUBLE":
        f"CASE WHEN f >= 20 THEN CASE WHEN {_FOLDED} > 1000 THEN {_FOLDED} / 2 ELSE {_FOLDED} END END",
}


def register_sql_functions(spark: SparkSession) -> None:
    """Create ``freq_to_hue``, ``freq_to_material_id``, ``octave_fold`` and the table
    function ``explode_mask`` as temporary functions of the session."""
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION explode_mask(mask BIGINT) RETURNS TABLE (bit INT) "
        "RETURN SELECT explode(filter(sequence(0, 63), b -> getbit(mask, b) = 1))"
    )
