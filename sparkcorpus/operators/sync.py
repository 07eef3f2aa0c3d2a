"""Comparing what a site lists with what the store holds, and an index with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkcorpus.functions.urls import host, permalink


def newest_entries(entries: DataFrame) -> DataFrame:
    """One entry for each url: the one with the newest lastmod; missing lastmods are oldest, ties go to the smallest row."""
    rest = [c for c in entries.columns if c not in ("url", "lastmod")]
    best = F.max_by(F.struct("lastmod", *rest), F.struct(F.col("lastmod")))
    return entries.groupBy("url").agg(best.alias("b")).select("url", "b.*")


def located(entries: DataFrame, encyclopedias: DataFrame) -> DataFrame:
    """Entries with encyclopedia_id (of the url's host) and permalink; unknown hosts and pages without permalink are left out."""
    hosts = encyclopedias.select(F.lower("host").alias("h"), F.col("encyclopedia_id").alias("e"))
    rows = entries.drop("encyclopedia_id", "permalink").withColumn("permalink", permalink(F.col("url")))
    return rows.join(hosts, host(F.col("url")) == F.col("h")).withColumn("encyclopedia_id", F.col("e")).drop("h", "e").where("permalink <> ''")


def categorised(entries: DataFrame, stored: DataFrame, encyclopedia_ids: list[int] | None = None) -> DataFrame:
    """encyclopedia_id, permalink, id, url, lastmod, changed_at, status (new, modified, deleted, unchanged).

    A full outer join on (encyclopedia_id, permalink). Modified: listed later than stored (equal is unchanged) or stored
    without a time. ``encyclopedia_ids`` restricts both sides, so that articles of sites not looked at aren't deleted.
    Of several entries of a key the newest counts.
    """
    if encyclopedia_ids is not None:
        entries = entries.where(F.col("encyclopedia_id").isin(encyclopedia_ids))
        stored = stored.where(F.col("encyclopedia_id").isin(encyclopedia_ids))
    key = ["encyclopedia_id", "permalink"]
    listed = entries.groupBy(*key).agg(F.max(F.struct("lastmod", "url")).alias("l")).select(*key, "l.lastmod", "l.url", F.lit(True).alias("listed"))
    both = listed.join(stored.select(*key, "id", "changed_at", F.lit(True).alias("held")), key, "full_outer")
    later = F.col("changed_at").isNull() | (F.col("lastmod") > F.col("changed_at"))
    status = F.when(F.col("held").isNull(), "new").when(F.col("listed").isNull(), "deleted").when(later, "modified").otherwise("unchanged")
    return both.select(*key, "id", "url", "lastmod", "changed_at", status.alias("status"))


def guarded(plan: DataFrame, complete: bool) -> DataFrame:
    """Without deletions where not every site map could be read."""
    return plan if complete else plan.where("status <> 'deleted'")


def status_counts(plan: DataFrame) -> DataFrame:
    """status, n of a plan."""
    return plan.groupBy("status").agg(F.count("*").alias("n"))


def index_times(index: DataFrame) -> DataFrame:
    """source_article_id, last_updated: the oldest chunk of each article, so that a partly done article is not up to date."""
    return index.groupBy("source_article_id").agg(F.min("last_updated").alias("last_updated"))


def index_plan(source: DataFrame, index: DataFrame, updated_at: str = "changed_at") -> DataFrame:
    """id, action (create, delete, update, skip) by a full outer join of source and index; a source row without a time is never newer."""
    have = index_times(index).select(F.col("source_article_id").alias("id"), "last_updated", F.lit(True).alias("indexed"))
    both = source.select("id", F.col(updated_at).alias("u"), F.lit(True).alias("present")).join(have, "id", "full_outer")
    action = F.when(F.col("indexed").isNull(), "create").when(F.col("present").isNull(), "delete").when(F.col("u") > F.col("last_updated"), "update").otherwise("skip")
    return both.select("id", action.alias("action"))


def due_for_dump(articles: DataFrame, index: DataFrame, updated_at: str = "changed_at") -> DataFrame:
    """Articles without chunks or newer than any of their chunks: one joined row an article instead of one a chunk."""
    times = index_times(index).withColumnRenamed("source_article_id", "id")
    rows = articles.join(times, "id", "left")
    return rows.where(F.col("last_updated").isNull() | (F.col(updated_at) > F.col("last_updated"))).drop("last_updated")


def observed_counts(df: DataFrame, **conditions) -> tuple[DataFrame, Observation]:
    """``df`` counting rows by condition while it is written, without a pass of its own."""
    seen = Observation()
    return df.observe(seen, *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()]), seen
