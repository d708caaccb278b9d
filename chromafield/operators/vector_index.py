"""A stored index over vectors: exact nearest neighbours by cosine from few of its files.

Unit vectors are dealt to coarse cells (the nearest of a set of centres); the index is a table in
folders by cell, with each row's distance to its centre, sorted by that distance in the files.
Of two unit vectors, cosine = 1 - distance^2 / 2, so for a query q and a row x of cell c the
triangle inequality gives |q - x| >= | |q - c| - |x - c| |.  A search reads the cells nearest to q
first; their k-th distance then bounds, per cell, the range of |x - c| that can still matter.
Cells without such a range are never opened (partition pruning), and in the others the bounds
reach the files' statistics (filter push-down).  The result is exact whatever the centres are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.functions.vectors import dot
from chromafield.session import configure

#: rows that the centres are fitted on, at most; every row is indexed
SAMPLE_ROWS = 20_000
MAX_CELLS = 4_096
ROWS_PER_CELL = 2_000
FILE_ROWS = 200_000
ROUNDS = 8
#: cells whose bounds become filters of the scan; those of more cells are joined
PUSHED_CELLS = 64
#: room for the rounding of sums of squares
SLACK = 1e-9


def _units(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def fit_centres(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centres of a bounded sample of unit vectors, by Lloyd's rounds from random rows."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        total, count = np.zeros_like(centres), np.bincount(own, minlength=len(centres))[:, None]
        np.add.at(total, own, sample)
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    return centres


@dataclass
class VectorIndex:
    """An index at a path; ``cells`` lists (cell, n, least and greatest distance to the centre)."""

    spark: SparkSession
    path: str
    vec: str
    id_col: str
    schema: T.StructType
    centres: np.ndarray
    cells: pd.DataFrame
    last_cells: int = 0  # folders that the last search opened

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _nearest(self, query: np.ndarray, ranges: pd.DataFrame, k: int) -> DataFrame:
        """The k best rows of the cells in ``ranges`` (cell, low, high)."""
        q = F.array(*[F.lit(float(v)) for v in query])
        found = self._rows().where(F.col("_cell").isin([int(c) for c in ranges["cell"]]))
        listed = [(int(c), float(a), float(b)) for c, a, b in ranges[["cell", "low", "high"]].itertuples(index=False)]
        if len(listed) <= PUSHED_CELLS:
            within = [(F.col("_cell") == c) & F.col("_residual").between(a, b) for c, a, b in listed]
            found = found.where(reduce(Column.__or__, within))
        else:
            known = self.spark.createDataFrame(listed, "_k int, _low double, _high double")  # MAX_CELLS at most
            on = (F.col("_cell") == F.col("_k")) & F.col("_residual").between(F.col("_low"), F.col("_high"))
            found = found.join(F.broadcast(known), on).drop("_k", "_low", "_high")
        return (
            found.withColumn("similarity", dot(F.col(self.vec).cast("array<double>"), q) / F.col("_norm"))
            .drop("_cell", "_residual", "_norm")
            .orderBy(F.desc("similarity"), F.asc(self.id_col))
            .limit(k)
        )

    def search(self, query: Sequence[float], k: int = 5) -> DataFrame:
        """The k most similar rows with ``similarity``, ties by the smaller id; exact."""
        self.last_cells = 0
        query = np.asarray(query, float)
        size = np.linalg.norm(query)
        if size == 0 or not len(self.cells):
            return self._rows().drop("_cell", "_residual", "_norm").withColumn("similarity", F.lit(None).cast("double")).limit(0)
        query = query / size
        cells = self.cells.copy()
        away = np.linalg.norm(self.centres[cells["cell"].to_numpy()] - query, axis=1)
        cells["away"] = away
        cells["bound"] = np.maximum(np.maximum(away - cells["most"], cells["least"] - away), 0.0)
        cells = cells.sort_values(["away", "cell"])
        # first the nearest cells that hold k rows
        head = cells[(cells["n"].cumsum() - cells["n"]) < k]
        first = self._nearest(query, head.assign(low=0.0, high=4.0), k).select("similarity").collect()
        kth = np.sqrt(max(2 - 2 * first[-1][0], 0.0)) if len(first) == k else 4.0
        reach = kth + SLACK
        open_ = cells[cells["bound"] <= reach]
        self.last_cells = len(open_)
        return self._nearest(query, open_.assign(low=open_["away"] - reach, high=open_["away"] + reach), k)


def build_index(
    df: DataFrame, path: str, id_col: str = "vec_id", vec: str = "embedding", cells: int | None = None
) -> VectorIndex:
    """Write the index of ``df`` (all its columns) below ``path`` and open it.

    The centres are fitted on at most ``SAMPLE_ROWS`` rows; every row with a non-zero vector of
    the common length is indexed.  A cell however large is cut into files of ``FILE_ROWS`` rows by
    distance to the centre, so no task writes a cell whole.
    """
    spark = configure(df.sparkSession)
    rows = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double"))))
    shape = rows.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    total, dims = shape[0], shape[1] or 0
    rows = rows.where(F.size(vec) == dims)
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = rows.select(vec) if share == 1.0 else rows.select(vec).sample(share, 11)
    taken = sample.limit(SAMPLE_ROWS + SAMPLE_ROWS // 10).toPandas()
    count = cells or int(np.clip(total // ROWS_PER_CELL, 1, MAX_CELLS))
    units = _units(np.array(taken[vec].tolist(), float).reshape(len(taken), dims))
    centres = fit_centres(units, min(count, max(len(units), 1))) if len(units) else np.zeros((1, dims))
    shared = spark.sparkContext.broadcast(centres)  # MAX_CELLS at most
    added = [
        T.StructField("_cell", T.IntegerType()),
        T.StructField("_residual", T.DoubleType()),
        T.StructField("_norm", T.DoubleType()),
    ]
    schema = T.StructType([*df.schema.fields, *added])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf[vec].tolist(), float).reshape(len(pdf), dims)
            unit, c = _units(x), shared.value
            own = np.argmax(unit @ c.T - (c**2).sum(axis=1) / 2, axis=1)
            away = np.linalg.norm(unit - c[own], axis=1)
            yield pdf.assign(_cell=own.astype(np.int32), _residual=away, _norm=np.linalg.norm(x, axis=1))

    placed = rows.mapInPandas(place, schema).where("_norm > 0")
    # a range of (cell, distance) per task: a hot cell spans several
    parts = max(1, -(-total // FILE_ROWS), min(count, 64))
    (
        placed.repartitionByRange(parts, "_cell", "_residual")
        .sortWithinPartitions("_cell", "_residual")
        .write.option("maxRecordsPerFile", FILE_ROWS)
        .partitionBy("_cell")
        .parquet(f"{path}/rows")
    )
    summary = (
        spark.read.schema(schema).parquet(f"{path}/rows")
        .groupBy(F.col("_cell").alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_residual").alias("least"), F.max("_residual").alias("most"))
    )
    table = [(i, [float(v) for v in row]) for i, row in enumerate(centres)]
    listed = spark.createDataFrame(table, "cell int, centre array<double>").join(summary, "cell", "left")
    listed.withColumns({"vec": F.lit(vec), "id_col": F.lit(id_col)}).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build_index`` wrote; its centres (``MAX_CELLS`` at most) come to the driver."""
    cells = spark.read.parquet(f"{path}/cells").toPandas().sort_values("cell")
    schema = spark.read.parquet(f"{path}/rows").schema if cells["n"].notna().any() else None
    centres = np.array(cells["centre"].tolist(), float)
    first = cells.iloc[0]
    known = cells[cells["n"].notna()][["cell", "n", "least", "most"]].reset_index(drop=True)
    if schema is None:
        schema = T.StructType(
            [T.StructField(first["id_col"], T.LongType()), T.StructField(first["vec"], T.ArrayType(T.DoubleType()))]
            + [T.StructField(n, T.DoubleType()) for n in ("_cell", "_residual", "_norm")]
        )
    return VectorIndex(spark, path, first["vec"], first["id_col"], schema, centres, known)
