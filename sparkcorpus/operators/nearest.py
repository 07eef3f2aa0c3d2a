"""Exact nearest neighbours of a stated set of query vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcorpus.functions.vectors import right_size
from sparkcorpus.session import cut_lineage

#: Bytes of query vectors that go to every task at once; a larger query set is searched in several passes.
QUERY_BYTES = 32 * 1024 * 1024


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column of arrays of one length, without a Python object for each number."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dims)


def _best_of(index: DataFrame, names: list, q: np.ndarray, dims: int, k: int) -> DataFrame:
    norms = np.linalg.norm(q, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            length = np.linalg.norm(x, axis=1)
            ids = batch.column("id").to_numpy()
            good = length > 0
            x, length, ids = x[good], length[good], ids[good]
            if not len(ids):
                continue
            far = np.round(1 - (q @ x.T) / (norms[:, None] * length[None, :]), 6) + 0.0  # no negative zeros
            top = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(far, top, axis=1).ravel())], names=["query", "id", "distance"])

    return index.mapInArrow(run, "query long, id long, distance double")


def nearest(index: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_col: str, query_vector: str, dims: int, k: int = 5) -> DataFrame:
    """query, id, distance, rank: the k rows nearest to each query vector by cosine distance (six places), ties by id.

    Null vectors, zero vectors and vectors of another length take no part on either side. Each task keeps its own best k
    of a query for every batch, so what is shuffled is bounded by batches, not rows. The query vectors are sent in blocks
    of at most ``QUERY_BYTES``; with several blocks each one's result is written before the next is read, so that the
    driver holds one at a time.
    """
    asked = queries.where(right_size(F.col(query_vector), dims)).select(F.col(query_col).cast("long").alias("query"), F.col(query_vector).alias("v"))
    rows = index.where(right_size(F.col(vector_col), dims) & ~F.exists(vector_col, lambda x: x.isNull())).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    block, parts, names, vectors = max(1, QUERY_BYTES // (8 * dims)), [], [], []

    def flush(last: bool) -> None:
        if names:
            part = _best_of(rows, list(names), np.array(vectors, np.float64).reshape(-1, dims), dims, k)
            parts.append(part if last and not parts else cut_lineage(part, "nearest"))
        names.clear()
        vectors.clear()

    for r in asked.toLocalIterator():
        if None not in r["v"] and any(r["v"]):
            if len(names) == block:
                flush(False)
            names.append(r["query"])
            vectors.append(list(r["v"]))
    flush(True)
    if not parts:
        return rows.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
