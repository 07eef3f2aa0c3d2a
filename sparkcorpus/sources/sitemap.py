"""Site maps and article pages: XML as columns, and fetching through an injected function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.functions.timestamps import strip

URLSET = "url array<struct<loc: string, lastmod: string>>"


class TooManyRequests(OSError):
    """What a fetcher raises when the server asks to slow down."""


def parse_sitemaps(documents: DataFrame, xml_col: str) -> DataFrame:
    """url, lastmod_text, lastmod of every entry that has both; other columns of ``documents`` are kept.

    A document that is no urlset ends the job with an error, an empty one gives no rows.
    """
    xml = F.col(xml_col)
    checked = F.when(xml.rlike(r"(?s)<(?:\w+:)?urlset[\s>/]") & xml.rlike(r"(?s)(?:</(?:\w+:)?urlset\s*>|<urlset[^>]*/>)\s*\z"), xml).otherwise(F.raise_error(F.lit("malformed site map")))
    rest = [c for c in documents.columns if c not in (xml_col, "url", "lastmod", "lastmod_text")]
    rows = documents.where(xml.isNotNull()).select(*rest, F.explode(F.from_xml(checked, URLSET)["url"]).alias("e"))
    rows = rows.select(*rest, strip(F.col("e.loc")).alias("url"), strip(F.col("e.lastmod")).alias("lastmod_text")).where("url <> '' and lastmod_text <> ''")
    return rows.withColumn("lastmod", F.expr("try_cast(lastmod_text as timestamp)"))


def with_retries(fetch: Callable[[str], str], attempts: int, pause: float, only: type[Exception] = OSError, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """A fetcher that tries again, with doubling pauses, on ``only``; what fails in the end, or otherwise, gives None."""

    def run(url: str) -> str | None:
        for attempt in range(attempts):
            try:
                return fetch(url)
            except only:
                if attempt + 1 < attempts:
                    sleep(pause * 2**attempt)
            except Exception:  # noqa: BLE001
                return None
        return None

    return run


def fetch_sitemaps(spark: SparkSession, urls: dict[int, str], fetch: Callable[[str], str], concurrent: int = 6) -> tuple[DataFrame, set[int]]:
    """The documents that could be read (encyclopedia_id, xml), and the ids of their sites; one failure leaves the others."""
    get = with_retries(fetch, 3, 1.0)
    with ThreadPoolExecutor(concurrent) as pool:
        texts = dict(zip(urls, pool.map(get, urls.values())))
    good = {i: t for i, t in texts.items() if t is not None}
    return spark.createDataFrame(list(good.items()), "encyclopedia_id int, xml string"), set(good)


def fetched(urls: DataFrame, url_col: str, fetch: Callable[[str], str], concurrent: int = 10, tasks: int = 8, pause: float = 5.0) -> DataFrame:
    """``url_col`` and ``body`` of every url whose ``<url>.json`` could be read; slowing down is the only failure tried again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = with_retries(fetch, 7, pause, TooManyRequests)
        with ThreadPoolExecutor(max(1, concurrent // tasks)) as pool:
            for part in batches:
                bodies = list(pool.map(get, [u + ".json" for u in part[url_col]]))
                yield part.assign(body=bodies).dropna(subset=["body"])

    return urls.select(url_col).where(F.col(url_col).isNotNull()).repartition(tasks, url_col).mapInPandas(run, f"{url_col} string, body string")
