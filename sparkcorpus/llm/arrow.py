"""Feeding Python text operators in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Plan nodes whose partitions are only known when the plan runs.
_SHUFFLING = frozenset(("Join", "Aggregate", "Window", "Sort", "Distinct", "Repartition", "RepartitionByExpression", "GlobalLimit"))


def _narrow(plan) -> bool:
    children = plan.children()
    return plan.nodeName() not in _SHUFFLING and all(_narrow(children.apply(k)) for k in range(children.size()))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Leave the scan's own splits where they keep the cores busy; else hash a small scan to the default parallelism.

    A compressed file of a few megabytes is one split but minutes of Python work, so it is dealt out by key. A plan that
    shuffles is left to adaptive execution: asking for its partitions would run it.
    """
    if not _narrow(df._jdf.queryExecution().optimizedPlan()):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want * 2, *keys)


def map_rows(df: DataFrame, schema: T.StructType, work: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """``mapInArrow`` over ``df``: ``work`` gives the output columns of a batch as lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch of very long texts is worked on in pieces, so that memory stays bounded
            for start in range(0, batch.num_rows, 512):
                out = work(batch.slice(start, 512))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
