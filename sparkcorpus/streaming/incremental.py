"""Structured Streaming into the store: each micro-batch is an upsert, replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkcorpus.operators.markdown import article_markdown
from sparkcorpus.operators.store import Store


def upsert_stream(lines: DataFrame, store: Store, encyclopedias: DataFrame, checkpoint: str, json_col: str = "value") -> StreamingQuery:
    """Upsert a stream of article JSON; a batch that is run again after a failure writes the same rows again."""

    def write(batch: DataFrame, _: int) -> None:
        store.upsert_articles(article_markdown(batch.select(json_col), json_col), encyclopedias)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str, by: list[str], window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """window_start, ``by``, n by event time; on a stream, rows later than the watermark are left out."""
    at = F.col(time_col).cast("timestamp")
    rows = events.withColumn("__at", at)
    if events.isStreaming:
        rows = rows.withWatermark("__at", lateness)
    return rows.groupBy(F.window("__at", window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
