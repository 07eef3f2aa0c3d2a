"""Approximate nearest neighbours for search: vectors kept in cells around centroids, of which a query reads the nearest few.

The cells are parquet partitions, so a search reads only the files of the cells that its queries probe. The centroids come
from a bounded sample; every vector is in a cell, and probing all of them is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcorpus.functions.vectors import right_size
from sparkcorpus.operators.nearest import _matrix

#: Vectors that a cell is to hold, vectors of the sample the centroids come from, and those of it a centroid needs.
CELL_ROWS, SAMPLE_ROWS, EACH = 2_000, 20_000, 16
#: Cells a query reads unless it says otherwise.
PROBES = 8


def _usable(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    v = F.col(vector_col)
    good = right_size(v, dims) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0)
    return df.where(good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(df: DataFrame, id_col: str, vector_col: str, dims: int, seed: int = 3) -> np.ndarray:
    """Centroids (cell, dimension) by k-means on a sample of at most about ``SAMPLE_ROWS`` unit vectors, chosen by a hash of the id."""
    rows = _usable(df, id_col, vector_col, dims)
    n = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 52)) < int(share * (1 << 52))).toArrow().sort_by("id")
    if not sample.num_rows:
        return np.zeros((1, dims))
    x = _unit(_matrix(sample["v"].combine_chunks(), dims))
    rng = np.random.default_rng(seed)
    cells = int(np.clip(round(n / CELL_ROWS), 1, max(1, len(x) // EACH)))
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(8):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(cells):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def build(df: DataFrame, id_col: str, vector_col: str, dims: int, path: str) -> int:
    """Write the cells of a table to ``path`` (cell=<n>/...) with their centroids; the number of cells.

    Null vectors, zero vectors and vectors of another length are in no cell, as in the exact search.
    """
    centres = fit(df, id_col, vector_col, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.argmax(_matrix(batch.column("v"), dims) @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own, pa.int32())], names=["id", "v", "cell"])

    rows = _usable(df, id_col, vector_col, dims).mapInArrow(run, "id long, v array<float>, cell int")
    rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark = df.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return len(centres)


def search(spark: SparkSession, path: str, queries: DataFrame, query_col: str, query_vector: str, dims: int, k: int = 5, probes: int = PROBES) -> DataFrame:
    """query, id, distance, rank as ``nearest.nearest`` gives them, of the ``probes`` cells nearest to each query.

    The query vectors of a search (a bounded set) and the centroids (bounded by the sample) are held by the driver.
    """
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    asked = _usable(queries, query_col, query_vector, dims).collect()
    names = np.array([r["id"] for r in asked], np.int64)
    q = np.array([r["v"] for r in asked], np.float64).reshape(-1, dims)
    n = min(probes, len(centres))
    near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :n]
    wanted = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    norms = np.linalg.norm(q, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cells, ids = _matrix(batch.column("v"), dims), batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            length = np.linalg.norm(x, axis=1)
            for c in np.unique(cells):
                rows, who = np.flatnonzero(cells == c), wanted[int(c)]
                far = np.round(1 - (q[who] @ x[rows].T) / (norms[who, None] * length[None, rows]), 6) + 0.0
                top = np.lexsort((np.broadcast_to(ids[rows], far.shape), far), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[who], top.shape[1])), pa.array(ids[rows][top].ravel()), pa.array(np.take_along_axis(far, top, axis=1).ravel())], names=["query", "id", "distance"])

    # the cells are partitions: only the files of the wanted ones are listed
    rows = spark.read.schema("id long, v array<float>, cell int").parquet(f"{path}/vectors").where(F.col("cell").isin(sorted(wanted)))
    found = rows.mapInArrow(run, "query long, id long, distance double")
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
