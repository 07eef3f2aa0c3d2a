"""What changed between full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcorpus.session import fresh


def canonical_hash(*values: Column) -> Column:
    """64-bit hash of a row's values in which nulls count as values of their own."""
    return F.xxhash64(*[x for v in values for x in (v.isNull(), v)])


def latest_version(df: DataFrame, keys: list[str], instant: str, values: list[str]) -> DataFrame:
    """Of several rows of a key the one with the latest instant; no instant is older than any.

    Aggregated map-side first, so a key with any number of rows is one row before the shuffle. Equal instants
    are decided by the values themselves (the greatest, nulls least), so the result doesn't depend on row order.
    """
    rest = [v for v in dict.fromkeys(values) if v != instant]
    if not rest:
        # a plain maximum is aggregated by hash, a struct only by sorting
        return df.groupBy(*keys).agg(F.max(instant).alias(instant))
    held = fresh("held")
    best = df.groupBy(*keys).agg(F.max(F.struct(instant, *rest)).alias(held))
    return best.select(*keys, *[F.col(held)[v].alias(v) for v in [instant, *rest]])


def changes_between(df: DataFrame, keys: list[str], snapshot: str, values: list[str], deliveries: DataFrame | None = None) -> DataFrame:
    """``keys``, ``snapshot`` and ``change_type`` (added, removed, changed) of each record that differs between a
    delivery and the one before it; the first delivery gives no rows.

    ``df`` has one row for each key and delivery (see ``latest_version``). "Before" is the next smaller number
    present, whatever gaps the numbers have. Keys match null-safely through their canonical hash and values, and
    missing values equal missing ones only. A full outer join on (key, delivery) meets each delivery with the one
    before it, carried one step on: one side missing is an addition or removal, unequal row hashes a change. An
    empty table or a single delivery gives no rows; columns besides those named are not read. ``deliveries``: a table
    whose column ``snapshot`` has the numbers present, where that is cheaper to read than ``df``.
    """
    mark, ours, theirs, no, nxt, first = fresh("hash"), fresh("ours"), fresh("theirs"), fresh("no"), fresh("next"), fresh("first")
    # one row a delivery: each number, the one after it, and whether it is the first
    order = Window.orderBy(no)
    numbers = (df if deliveries is None else deliveries).select(F.col(snapshot).alias(no)).where(F.col(no).isNotNull()).distinct()
    steps = numbers.select(no, F.lead(no).over(order).alias(nxt), F.lag(no).over(order).isNull().alias(first))
    rows = df.select(*keys, F.col(snapshot).alias(snapshot), canonical_hash(*[F.col(v) for v in values]).alias(mark)).join(steps, F.col(snapshot) == F.col(no)).drop(no)
    named = {k: fresh("k") for k in keys}
    left = rows.where(~F.col(first)).select(*keys, snapshot, F.col(mark).alias(ours))
    right = rows.where(F.col(nxt).isNotNull()).select(*[F.col(k).alias(n) for k, n in named.items()], F.col(nxt).alias(no), F.col(mark).alias(theirs))
    same = F.col(snapshot) == F.col(no)
    for k, n in named.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    joined = left.join(right, same, "full_outer")
    here, there = F.col(ours).isNotNull(), F.col(theirs).isNotNull()
    kind = F.when(~there, "added").when(~here, "removed").when(F.col(ours) != F.col(theirs), "changed")
    return joined.select(*[F.when(here, F.col(k)).otherwise(F.col(n)).alias(k) for k, n in named.items()], F.coalesce(snapshot, no).alias(snapshot), kind.alias("change_type")).where(F.col("change_type").isNotNull())
