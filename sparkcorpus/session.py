"""Session defaults and small helpers shared by every operator."""

from __future__ import annotations

import itertools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine relies on; a session that has its own values keeps them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_names = itertools.count()


def build_session(app: str = "sparkcorpus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` (dots as double underscores) overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(stem: str) -> str:
    """A column name that no input column is expected to have."""
    return f"__{stem}_{next(_names)}"


def shared_dir(spark: SparkSession, stem: str) -> str:
    """A new path under the folder that all executors share (``spark.checkpoint.dir``); it is deleted when the application ends.

    Only a local session without that setting, as in tests, falls back to a folder beside the warehouse. On a cluster a
    missing setting is an error, because executors that write to their own disks would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    folder = f"{base.rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(hadoop).deleteOnExit(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


#: Shared folders made so far, by application.
_made: dict[str, list[str]] = {}


def clear_shared(spark: SparkSession) -> int:
    """Delete the shared folders made so far, for long-lived sessions: no result that reads them may be used any more."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = _made.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
    return len(folders)


def cut_lineage(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors and is computed once."""
    path = shared_dir(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
