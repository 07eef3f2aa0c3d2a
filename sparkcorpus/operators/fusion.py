"""Fusing ranked lists by weighted reciprocal ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the search methods by type of query.
QUERY_WEIGHTS = {
    "entity": {"semantic": 0.8, "fulltext": 1.2, "hyde": 0.8},
    "conceptual": {"semantic": 1.2, "fulltext": 0.8, "hyde": 1.2},
    "unclear": {"semantic": 1.0, "fulltext": 1.0, "hyde": 1.0},
}


def rrf_score(ranks: list[int], k: int = 60, weights: list[float] | None = None, normalise: bool = False) -> float:
    """Sum of weight / (k + rank), divided by the sum of weights if ``normalise``."""
    weights = weights or [1.0] * len(ranks)
    if len(weights) != len(ranks):
        raise ValueError("ranks and weights must have the same length")
    score = sum(w / (k + r) for w, r in zip(weights, ranks))
    return score / sum(weights) if normalise and weights else score


def numbered(lists: list[DataFrame]) -> DataFrame:
    """Ranked lists (query, id, rank) as one table with ``list_no`` from 1."""
    parts = [df.select("query", "id", "rank", F.lit(n).alias("list_no")) for n, df in enumerate(lists, 1)]
    return reduce(DataFrame.unionByName, parts)


def fuse(lists: list[DataFrame], top: int, k: int = 60, weights: list[float] | None = None, normalise: bool = False, mode: str = "canonical") -> DataFrame:
    """query, id, score, rank of the fused lists, the ``top`` best of each query.

    ``canonical`` uses the rank of an item in each list. ``reference`` numbers the lists an item appears in (1, 2, ...)
    and uses that number in place of the rank, with the weight of the list. Equal scores keep the order in which items
    are first seen: by list, then by rank, then by id. Scores are rounded to nine places before ordering.
    """
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("one weight a list is needed")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("list_no"))
    rows = numbered(lists)
    if mode == "reference":
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query", "id").orderBy("list_no")))
    elif mode == "canonical":
        rows = rows.withColumn("place", F.col("rank"))
    else:
        raise ValueError(f"unknown mode: {mode}")
    total = F.sum(weight / (k + F.col("place")))
    if normalise:
        total = total / F.sum(weight)
    fused = rows.groupBy("query", "id").agg(F.round(total, 9).alias("score"), F.min(F.struct("list_no", F.col("rank").alias("seen"))).alias("first"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "id", "score", "rank")
