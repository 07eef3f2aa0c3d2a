"""Packing items into fixed-capacity containers, online, by the sum-of-squares rule.

A packer keeps how many containers stand open at each fill level and places an item where the sum of the squared
counts becomes least, so that no fill level piles up. Packers work on independent shares of the items, so the work is
linear and spread; each share fills about ``SHARE`` containers, beside which its few open ones at the end are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Containers that a share of the items fills.
SHARE = 4_000


class SumOfSquares:
    """Online packer: ``place(size)`` gives the number of the container for an item of 1..capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        top = self.capacity - size
        # change of the sum when an item moves a container from level l to l + size; level 0 is a new container
        change = 2 * self.open[size : self.capacity + 1].copy() + 1
        change[-1] = 0
        change[1:] += np.where(self.open[1 : top + 1] > 0, 1 - 2 * self.open[1 : top + 1], 1 << 40)
        # among equals the fullest container
        level = top - int(np.argmin(change[::-1]))
        if level:
            box = self.waiting[level].pop()
            self.open[level] -= 1
        else:
            box, self.made = self.made, self.made + 1
        if level + size < self.capacity:
            self.waiting[level + size].append(box)
            self.open[level + size] += 1
        return box


def pack(df: DataFrame, key: str, size: str, capacity: int, total: int | None = None) -> DataFrame:
    """``key``, piece_no, piece_size, container_id: every item of ``df`` assigned to containers of ``capacity``.

    An item is divided only if it exceeds a container: into full ones and a rest that is packed like an item. An item
    without size (0 or null) takes no space and gets one row with a null container. ``total`` (the sum of sizes) saves a
    pass. Items come in the order of a hash of their key, so the result depends on neither the row order nor lost
    executors; a key that repeats is an item each time. Other columns are not read. An empty table gives no rows.
    """
    items = df.select(F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    if total is None:
        total = items.agg(F.sum("size")).first()[0] or 0
    shares = max(1, -(-total // (capacity * SHARE)))
    order = F.xxhash64("item")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("piece_size", T.LongType()), T.StructField("container_id", T.LongType())])
    arrow = pa.schema([("piece_no", pa.int32()), ("piece_size", pa.int64()), ("container_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = SumOfSquares(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            at, number, sizes, boxes = [], [], [], []
            for row, n in enumerate(batch.column("size").to_pylist()):
                piece = 0
                while n > capacity or not piece:
                    part = min(n, capacity)
                    at.append(row)
                    number.append(piece)
                    sizes.append(part)
                    boxes.append(base + packer.place(part) if part > 0 else None)
                    n, piece = n - part, piece + 1
                if n > 0:
                    at.append(row)
                    number.append(piece)
                    sizes.append(n)
                    boxes.append(base + packer.place(n))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at, pa.int64())), *[pa.array(x, f.type) for x, f in zip((number, sizes, boxes), arrow)]], names=[key, *arrow.names])

    return items.repartition(shares, "item").sortWithinPartitions(order, "item", "size").mapInArrow(run, schema)
