"""Running a batch function over the texts of a table, with all other columns kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.session import configure

#: rows that a Python worker holds at once; texts are long, and workers share a small memory
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, with Arrow batches for rows that hold whole texts."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def with_text_columns(
    docs: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` and one column per field, computed from the column ``text_col``.

    ``make()`` runs once per task and returns the function for a batch: the Arrow array of
    texts to one Arrow array per field.  New columns replace input columns of the same name;
    ``keep`` names the input columns that go on (default: all).
    """
    prepare(docs.sparkSession)
    own = {f.name for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    rows = docs.select(*kept, F.col(text_col).alias("__input"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                columns = function(part.column(len(kept)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(kept))] + columns,
                    names=kept + [f.name for f in fields],
                )

    schema = T.StructType([rows.schema[c] for c in kept] + fields)
    return rows.mapInArrow(run, schema)


def shielded(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns named like an operator's results renamed, and the columns that
    bring all of ``docs`` back from the operator's output."""
    held = {c: f"__held_{c}" for c in docs.columns if c in own}
    return docs.withColumnsRenamed(held), [F.col(held.get(c, c)).alias(c) for c in docs.columns]


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id, as text, falls into one of ``folds`` folds."""
    return F.coalesce(
        F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold,
        F.lit(False),
    )
