"""Processed sequence numbers as disjoint intervals: subtract, merge, and commit them with the output.

Intervals are closed ranges of longs. Work within a key is cut into position buckets whose totals are
carried over by a prefix sum of one row a bucket, so a key that holds a large part of all rows (or a table
without keys) is swept by many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcorpus.operators.commits import CommitLog
from sparkcorpus.session import cut_lineage, fresh

LOWEST, HIGHEST = -(2**62), 2**62


def _edges(df: DataFrame, keys: list[str], lo: str, hi: str, pos: str, **weights: str) -> DataFrame:
    """One row where an interval begins (+1 in its weight) and one behind its end (-1); empty or null ones none."""
    step = lambda c, d: F.struct(c.alias(pos), *[F.lit(d if own else 0).cast("long").alias(w) for w, own in weights.items()])
    at = fresh("at")
    return df.where(F.col(lo) <= F.col(hi)).select(*keys, F.explode(F.array(step(F.col(lo).cast("long"), 1), step(F.col(hi).cast("long") + 1, -1))).alias(at)).select(*keys, f"{at}.*")


def _bucketed(keys: list[str], pos: str, width: int | None) -> Column:
    return F.floor(F.col(pos) / F.lit(width)) if width else F.lit(0).cast("long")


def _covered(edges: DataFrame, keys: list[str], pos: str, have: str, done: str, lo: str, hi: str, width: int | None) -> DataFrame:
    """Maximal ranges with ``have`` above and ``done`` at zero, from summed edges."""
    bucket, on, was, nxt = fresh("bucket"), fresh("on"), fresh("was"), fresh("next")
    rows = edges.groupBy(*keys, pos).agg(F.sum(have).alias(have), F.sum(done).alias(done)).withColumn(bucket, _bucketed(keys, pos, width))
    inside = Window.partitionBy(*keys, bucket).orderBy(pos)
    if width:
        # read three times below: the edges are written once
        rows = cut_lineage(rows, "edges")
        of = [fresh("have"), fresh("done")]
        across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.groupBy(*keys, bucket).agg(F.sum(have).alias(of[0]), F.sum(done).alias(of[1]))
        totals = totals.withColumns({c: F.coalesce(F.sum(c).over(across), F.lit(0)) for c in of})
        rows = _rejoin(rows, totals, [*keys, bucket])
        base_have, base_done = F.col(of[0]), F.col(of[1])
    else:
        base_have = base_done = F.lit(0)
    run_have, run_done = F.sum(have).over(inside) + base_have, F.sum(done).over(inside) + base_done
    rows = rows.withColumns({on: (run_have > 0) & (run_done <= 0), was: (run_have - F.col(have) > 0) & (run_done - F.col(done) <= 0)}).where(F.col(on) != F.col(was))
    rows = rows.select(*keys, pos, bucket, on)
    follow = F.lead(pos).over(inside)
    if width:
        rows = cut_lineage(rows, "turns")
        first = fresh("first")
        behind = Window.partitionBy(*keys).orderBy(bucket)
        firsts = rows.groupBy(*keys, bucket).agg(F.min(pos).alias(first)).withColumn(first, F.lead(first).over(behind))
        rows = _rejoin(rows, firsts, [*keys, bucket])
        follow = F.coalesce(follow, F.col(first))
    rows = rows.withColumn(nxt, follow).where(F.col(on))
    return rows.select(*keys, F.col(pos).alias(lo), (F.col(nxt) - 1).alias(hi))


def _rejoin(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    named = {k: fresh("j") for k in keys}
    same = None
    for k, n in named.items():
        test = F.col(k).eqNullSafe(F.col(n))
        same = test if same is None else same & test
    return rows.join(small.withColumnsRenamed(named), same, "left").drop(*named.values())


def subtract_intervals(available: DataFrame, processed: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", width: int | None = None) -> DataFrame:
    """Available ranges minus processed ones, by key: disjoint maximal gaps (``keys``, ``lo``, ``hi``).

    Either side may overlap itself, repeat rows or come unordered. Ranges with a null or reversed bound are empty;
    null keys are a key like any other. ``width`` cuts a key's positions into buckets of that many numbers that
    are swept in parallel; leave it out where no key has many intervals.
    """
    pos, have, done = fresh("pos"), fresh("have"), fresh("done")
    a = _edges(available, keys, lo, hi, pos, **{have: True, done: False})
    p = _edges(processed, keys, lo, hi, pos, **{have: False, done: True})
    return _covered(a.unionByName(p), keys, pos, have, done, lo, hi, width)


def merge_intervals(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", width: int | None = None) -> DataFrame:
    """The same numbers as disjoint maximal ranges; touching ones become one."""
    pos, have, done = fresh("pos"), fresh("have"), fresh("done")
    return _covered(_edges(df, keys, lo, hi, pos, **{have: True, done: False}), keys, pos, have, done, lo, hi, width)


def ranges_of(df: DataFrame, number: str, lo: str = "lo", hi: str = "hi", width: int = 1_000_000) -> DataFrame:
    """Disjoint ranges of the sequence numbers present in ``number``; nulls are none, repeats count once."""
    rows = df.where(F.col(number).isNotNull()).select(F.col(number).cast("long").alias(lo)).distinct()
    return merge_intervals(rows.withColumn(hi, F.col(lo)), [], lo, hi, width)


def ranges_of_files(df: DataFrame, number: str, lo: str = "lo", hi: str = "hi", width: int = 1_000_000) -> DataFrame:
    """``ranges_of`` for a table of parquet files whose sequence numbers are unique, mostly from the files' footers.

    A file whose statistics show as many rows as numbers between its least and greatest is one range and isn't read;
    only of the others the column is. Files that can't be opened so are read as well.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return ranges_of(df, number, lo, hi, width)

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame([(name, *_dense(name, number)) for name in part["file"]], columns=["file", "dense", lo, hi])

    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), spark.sparkContext.defaultParallelism * 4))
    seen = names.mapInPandas(footers, f"file string, dense boolean, {lo} long, {hi} long").persist()
    dense = seen.where("dense").select(lo, hi)
    rest = [r[0] for r in seen.where("not dense").select("file").collect()]
    if rest:
        column = spark.read.schema(df.select(number).schema).parquet(*rest)
        dense = dense.unionByName(ranges_of(column, number, lo, hi, width))
    return merge_intervals(dense, [], lo, hi, width)


def _dense(name: str, number: str) -> tuple[bool, int | None, int | None]:
    """Whether a file holds every number between its least and greatest, and these two, from its footer."""
    try:
        fs, path = pa_fs.FileSystem.from_uri(name)
        with fs.open_input_file(path) as f:
            meta = pq.ParquetFile(f).metadata
        column = [c.path for c in (meta.schema.column(k) for k in range(meta.num_columns))].index(number)
        stats = [meta.row_group(k).column(column).statistics for k in range(meta.num_row_groups)]
        if not stats or any(s is None or not s.has_min_max or s.null_count for s in stats):
            return False, None, None
        low, high = int(min(s.min for s in stats)), int(max(s.max for s in stats))
        return high - low + 1 == meta.num_rows, low, high
    except (OSError, ValueError, TypeError):
        return False, None, None


class IntervalLedger:
    """A table of outputs and the intervals they came from, committed together.

    Each run writes its output and the merged intervals into a new version folder and then publishes the version
    (see ``CommitLog``: it relies on exclusive creation and rename, as HDFS and local disks have them; object stores need
    a committer of their own). A run that dies before that leaves nothing that a reader sees, so its numbers are gaps
    again for the next run; numbers that became available late lie in gaps as well. Nothing is skipped and nothing is
    processed twice.
    """

    def __init__(self, spark: SparkSession, root: str, width: int = 1_000_000):
        self.spark, self.root, self.width = spark, root.rstrip("/"), width
        self.log = CommitLog(spark, self.root)

    def version(self) -> int:
        """The last published version, 0 before any."""
        return self.log.version()

    def processed(self) -> DataFrame:
        """Disjoint ranges that published runs have processed."""
        _, last = self.log.last()
        if last is None:
            return self.spark.createDataFrame([], "lo long, hi long")
        return self.spark.read.schema("lo long, hi long").parquet(f"{self.root}/{last['folders'][-1]}/intervals")

    def outputs(self) -> DataFrame | None:
        """Everything published runs have written, None before the first."""
        _, last = self.log.last()
        return self.spark.read.parquet(*[f"{self.root}/{f}/output" for f in last["folders"]]) if last else None

    def pending(self, source: DataFrame, number: str, available: DataFrame | None = None) -> DataFrame:
        """Rows of ``source`` whose sequence number no published run has processed; a null number is never due."""
        return self._within(source, number, cut_lineage(self._gaps(source, number, available), "gaps"))

    def _gaps(self, source: DataFrame, number: str, available: DataFrame | None) -> DataFrame:
        have = ranges_of(source, number, width=self.width) if available is None else available
        return subtract_intervals(have, self.processed(), [], width=self.width)

    def run(self, source: DataFrame, number: str, process: Callable[[DataFrame], DataFrame], available: DataFrame | None = None) -> int | None:
        """Process what is pending and publish; the new version, or None where another run published first.

        ``available``: the ranges (lo, hi) of the numbers in ``source``, from a catalogue, partitions or
        ``ranges_of_files``; without it the numbers are read. They must not claim numbers that may still arrive.
        """
        base, last = self.log.last()
        folder = f"runs/{base + 1:08d}-{uuid.uuid4().hex}"
        # the gaps are written first: what is processed is what they claim, even if the source grows meanwhile
        self._gaps(source, number, available).write.parquet(f"{self.root}/{folder}/gaps")
        gaps = self.spark.read.schema("lo long, hi long").parquet(f"{self.root}/{folder}/gaps")
        merge_intervals(self.processed().unionByName(gaps), [], width=self.width).write.parquet(f"{self.root}/{folder}/intervals")
        process(self._within(source, number, gaps)).write.parquet(f"{self.root}/{folder}/output")
        return self.log.publish(base, {"folders": [*(last["folders"] if last else []), folder]})

    def _within(self, rows: DataFrame, number: str, ranges: DataFrame) -> DataFrame:
        """Rows whose number lies in a range. The ends of all ranges reach the scan, which skips what lies before them;
        ranges are cut at bucket borders, so the join has an equality to hash on."""
        lo, hi, piece = fresh("lo"), fresh("hi"), fresh("piece")
        ends = ranges.agg(F.min("lo"), F.max("hi")).first()
        n = F.col(number).cast("long")
        if ends[0] is None:
            return rows.where("false")
        cut = ranges.select(F.explode(F.sequence(F.floor(F.col("lo") / self.width), F.floor(F.col("hi") / self.width))).alias(piece), F.col("lo").alias(lo), F.col("hi").alias(hi))
        return rows.where(n.between(*ends)).join(cut, (F.floor(n / self.width) == F.col(piece)) & n.between(F.col(lo), F.col(hi)), "left_semi")
