"""Vector functions: expressions for single values, and Arrow functions for blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column) -> Column:
    """Unit vector in double precision; null for null and zero vectors."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where either is null or zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, 1 - dot(a, b) / length)


def right_size(v: Column, dims: int) -> Column:
    """True for vectors of the index's dimension (false for null)."""
    return F.coalesce(F.size(v) == dims, F.lit(False)) & v.isNotNull()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats as an array; null for null and for lengths that are no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """An array of floats as little-endian bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
