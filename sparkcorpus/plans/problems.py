"""The general data problems as whole-table queries: p1, p2 and p6."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.functions.urls import host
from sparkcorpus.operators.instants import normalise_instants
from sparkcorpus.operators.intervals import HIGHEST, LOWEST, IntervalLedger, subtract_intervals
from sparkcorpus.operators.snapshots import changes_between, latest_version
from sparkcorpus.session import shared_dir, table


def sitemap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-map rows with ``utc_us`` and the encyclopedia of the host where none was delivered."""
    hosts = table(spark, sf_dir, "encyclopedias").select(F.lower("host").alias("of_host"), F.col("encyclopedia_id").alias("host_id"))
    rows = table(spark, sf_dir, "sitemap_entries").select("snapshot_no", "url", "lastmod", "encyclopedia_id", "permalink", "received_at")
    rows = normalise_instants(rows, "lastmod", "utc_us", ["permalink"], "received_at", by=["encyclopedia_id"])
    rows = rows.join(hosts, host(F.col("url")) == F.col("of_host"), "left")
    return rows.withColumn("encyclopedia_id", F.coalesce("encyclopedia_id", "host_id")).drop("of_host", "host_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, snapshot_no, record_key, change_type of what differs between consecutive deliveries."""
    sitemap = sitemap_records(spark, sf_dir)
    sitemap = latest_version(sitemap, ["encyclopedia_id", "permalink", "snapshot_no"], "utc_us", [])
    site = changes_between(sitemap, ["encyclopedia_id", "permalink"], "snapshot_no", ["utc_us"], table(spark, sf_dir, "sitemap_entries"))
    site_key = F.concat(F.coalesce(F.col("encyclopedia_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("permalink", F.lit("")))
    values = ["utc_us", "permalink", "encyclopedia_id"]
    meta = table(spark, sf_dir, "article_metadata").withColumn("utc_us", F.unix_micros("changed_at"))
    meta = changes_between(latest_version(meta, ["id", "snapshot_no"], "utc_us", values), ["id"], "snapshot_no", values, table(spark, sf_dir, "article_metadata"))
    cols = lambda df, feed, key: df.select(F.lit(feed).alias("feed"), "snapshot_no", key.alias("record_key"), "change_type")
    return cols(site, "sitemap", site_key).unionByName(cols(meta, "metadata", F.col("id").cast("string")))


_DAY_US = 86_400_000_000


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, reason of the articles due in the next run of the index.

    An article's sequence number is the instant of the version that holds; no instant is the lowest number, which any
    chunk covers. What a chunk leaves undone of its article are all numbers behind its own; these ranges, merged by the
    sweep over an article's chunks, are taken from all numbers, and what is left has been processed by every chunk,
    however many runs did the article in part. A gap of the available number is an article that is due. Chunks of one day are reduced to the
    oldest before anything is shuffled, so that an article with very many of them is a few rows.
    """
    rows = table(spark, sf_dir, "articles").select("id", "row_id", "changed_at", "received_at", "encyclopedia_id", F.coalesce(F.col("xhtml_md").rlike(r"(?U)\S"), F.lit(False)).alias("has_text"))
    rows = normalise_instants(rows, "changed_at", "utc_us", ["id"], "received_at", by=["encyclopedia_id"])
    rows = latest_version(rows.where(F.col("id").isNotNull()), ["id"], "utc_us", ["received_at", "row_id", "has_text"]).where("has_text")
    at = F.coalesce("utc_us", F.lit(LOWEST))
    available = rows.select(F.col("id").alias("article_id"), at.alias("lo"), at.alias("hi"))
    done = F.coalesce(F.unix_micros("last_updated"), F.lit(LOWEST))
    chunks = table(spark, sf_dir, "article_chunks").groupBy(F.col("source_article_id").alias("article_id"), F.floor(done / _DAY_US).alias("day")).agg(F.min(done).alias("done"))
    undone = chunks.select("article_id", (F.col("done") + 1).alias("lo"), F.lit(HIGHEST).alias("hi"))
    every = chunks.select("article_id", F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"))
    processed = subtract_intervals(every, undone, ["article_id"])
    gaps = subtract_intervals(available, processed, ["article_id"])
    known = processed.groupBy("article_id").agg(F.lit(True).alias("known"))
    return gaps.join(known, "article_id", "left").select("article_id", F.when(F.col("known"), "changed").otherwise("added").alias("reason"))


class _Failed(Exception):
    """A run that ends before it has published."""


def p2_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, run_id of the run that processed each site-map entry, when the runs of the index in ``index_runs`` are
    replayed in order: each is given what had arrived when it started, entries come late and out of order, a run that
    failed dies before it publishes, and one that is running is left out."""
    runs = table(spark, sf_dir, "index_runs").where("index_name = 'article_chunks' and status <> 'running'").orderBy("started_at").select("run_id", "started_at", "status").collect()
    entries = table(spark, sf_dir, "sitemap_entries").select("entry_id", "received_at")
    ledger = IntervalLedger(spark, shared_dir(spark, "ledger"))

    def work(run, due: DataFrame) -> DataFrame:
        if run["status"] != "success":
            due.count()
            raise _Failed
        return due.select("entry_id", F.lit(run["run_id"]).alias("run_id"))

    for run in runs:
        try:
            ledger.run(entries.where(F.col("received_at") <= F.lit(run["started_at"])), "entry_id", partial(work, run))
        except _Failed:
            continue
    done = ledger.outputs()
    return done if done is not None else entries.select("entry_id", F.lit(0).alias("run_id")).where("false")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, row_key, utc_us of every delivered value that denotes an instant."""
    a = normalise_instants(table(spark, sf_dir, "articles").select("row_id", "id", "changed_at", "received_at", "encyclopedia_id"), "changed_at", "utc_us", ["id"], "received_at", by=["encyclopedia_id"])
    s = normalise_instants(table(spark, sf_dir, "sitemap_entries").select("entry_id", "permalink", "lastmod", "received_at", "encyclopedia_id"), "lastmod", "utc_us", ["permalink"], "received_at", by=["encyclopedia_id"])
    cols = lambda df, feed, key: df.where("utc_us is not null").select(F.lit(feed).alias("feed"), F.col(key).alias("row_key"), "utc_us")
    return cols(a, "article", "row_id").unionByName(cols(s, "sitemap", "entry_id"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_ledger": p2_ledger, "p6_found": p6_found}

# -- the same in SQL: notations by pattern, offsets by trial (summer time where the clock then shows the value, else standard time)

_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ZONE = r"(Z|UTC|GMT|CEST|CET|[+-]\d{2}(?::?\d{2})?)?"
_TIME = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)? *" + _ZONE
_SHAPES = (
    (r"(?i)^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:(?:T| +)" + _TIME + r"(?:\[[A-Za-z_/+-]+\])?)?$", r"\1|\2|\3|\4|\5|\6|\7|\8"),
    (r"(?i)^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})" + _ZONE + "$", r"\1|\2|\3|\4|\5|\6||\7"),
    (r"(?i)^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:(?:T|,? +)(?:kl\.? *)?" + _TIME + ")?$", r"\3|\2|\1|\4|\5|\6|\7|\8"),
    (r"(?i)^(?:\pL{2,9}\.?,? +)?(\d{1,2})\.? +(\pL{3,9}),? +(\d{4})(?:,? +(?:kl\.? *)?" + _TIME + ")?$", r"\3|\2|\1|\4|\5|\6|\7|\8"),
)


def _instants_sql(source: str) -> str:
    """SQL for feed, row_key, utc_us from a table expression with feed, row_key, v; null where a value denotes no instant."""
    parts = " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_replace(t, '{p}', '{g}')" for p, g in _SHAPES)
    return rf"""(WITH t AS (SELECT feed, row_key, regexp_replace(regexp_replace(v, '^{_WS}+', ''), '{_WS}+$', '') AS t FROM {source}),
    p AS (SELECT feed, row_key, t, string_split(CASE {parts} END, '|') AS p FROM t),
    m AS (SELECT *, CASE WHEN regexp_matches(p[2], '^\d+$') THEN lpad(p[2], 2, '0') ELSE lpad(((strpos('janfebmaraprmajjunjulaugsepoktnovdec', replace(replace(lower(left(p[2], 3)), 'may', 'maj'), 'oct', 'okt')) + 2) // 3)::VARCHAR, 2, '0') END AS month, upper(p[8]) AS z FROM p),
    w AS (SELECT feed, row_key, t, z, CASE WHEN p[1] <> '0000' THEN epoch_us(try_cast(p[1] || '-' || month || '-' || lpad(p[3], 2, '0') || ' ' || lpad(p[4], 2, '0') || ':' || lpad(p[5], 2, '0') || ':' || lpad(p[6], 2, '0') || '.' || rpad(left(p[7], 6), 6, '0') AS TIMESTAMP)) END AS us FROM m),
    o AS (SELECT *, CASE WHEN z IN ('Z', 'UTC', 'GMT') THEN 0 WHEN z = 'CET' THEN 60 WHEN z = 'CEST' THEN 120 WHEN z <> '' THEN (CASE WHEN left(z, 1) = '-' THEN -1 ELSE 1 END) * (substring(z, 2, 2)::INT * 60 + CASE WHEN length(replace(z, ':', '')) > 3 THEN right(z, 2)::INT ELSE 0 END) END AS off FROM w)
    SELECT feed, row_key, CASE WHEN regexp_matches(t, '^-?\d{{6,11}}$') THEN t::BIGINT * 1000000 WHEN regexp_matches(t, '^-?\d{{12,14}}$') THEN t::BIGINT * 1000 WHEN off IS NOT NULL THEN us - off::BIGINT * 60000000
        WHEN timezone('Europe/Copenhagen', make_timestamptz(us - 7200000000)) = make_timestamp(us) THEN us - 7200000000 ELSE us - 3600000000 END AS utc_us FROM o)"""


_ARTICLE_VALUES = "(SELECT 'article' AS feed, row_id AS row_key, changed_at AS v FROM articles)"
_SITEMAP_VALUES = "(SELECT 'sitemap' AS feed, entry_id AS row_key, lastmod AS v FROM sitemap_entries)"
_CHANGES = """SELECT '{feed}' AS feed, s.snapshot_no, s.record_key, s.change_type FROM (WITH r AS ({rows}),
    n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM r)),
    a AS (SELECT r.* FROM r JOIN n USING (snapshot_no) WHERE n.before IS NOT NULL), b AS (SELECT n.snapshot_no, r.record_key, r.state FROM r JOIN n ON r.snapshot_no = n.before)
    SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.record_key, b.record_key) AS record_key,
        CASE WHEN b.record_key IS NULL THEN 'added' WHEN a.record_key IS NULL THEN 'removed' WHEN a.state <> b.state THEN 'changed' END AS change_type
    FROM a FULL OUTER JOIN b ON a.snapshot_no = b.snapshot_no AND a.record_key = b.record_key) s WHERE s.change_type IS NOT NULL"""
_SITEMAP_ROWS = f"""SELECT s.snapshot_no, coalesce(s.encyclopedia_id, e.encyclopedia_id) || '/' || s.permalink AS record_key, coalesce(max(i.utc_us)::VARCHAR, '-') AS state FROM sitemap_entries s
    JOIN {_instants_sql(_SITEMAP_VALUES)} i ON i.row_key = s.entry_id LEFT JOIN encyclopedias e ON e.host = lower(regexp_extract(s.url, '^[A-Za-z]+://([^/?#]*)', 1)) GROUP BY ALL"""
_METADATA_ROWS = """SELECT snapshot_no, id::VARCHAR AS record_key, coalesce(epoch_us(changed_at)::VARCHAR, '-') || '|' || coalesce(permalink, '-') || '|' || coalesce(encyclopedia_id::VARCHAR, '-') AS state FROM article_metadata
    QUALIFY row_number() OVER (PARTITION BY snapshot_no, id ORDER BY changed_at DESC NULLS LAST, permalink DESC NULLS LAST, encyclopedia_id DESC NULLS LAST) = 1"""

ORACLES = {
    "p1_found": _CHANGES.format(feed="sitemap", rows=_SITEMAP_ROWS) + " UNION ALL " + _CHANGES.format(feed="metadata", rows=_METADATA_ROWS),
    "p2_found": rf"""SELECT id AS article_id, CASE WHEN c.u IS NULL THEN 'added' ELSE 'changed' END AS reason FROM
        (SELECT a.id, a.xhtml_md, i.utc_us FROM articles a JOIN {_instants_sql(_ARTICLE_VALUES)} i ON i.row_key = a.row_id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY i.utc_us DESC NULLS LAST, a.received_at DESC, a.row_id DESC) = 1) a
        LEFT JOIN (SELECT source_article_id, min(epoch_us(last_updated)) AS u FROM article_chunks GROUP BY 1) c ON c.source_article_id = a.id
        WHERE regexp_matches(coalesce(a.xhtml_md, ''), '[^\s\x0B\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]') AND (c.u IS NULL OR a.utc_us > c.u)""",
    "p2_ledger": """SELECT entry_id, run_id FROM (SELECT s.entry_id, r.run_id, row_number() OVER (PARTITION BY s.entry_id ORDER BY r.started_at) AS n FROM sitemap_entries s
        JOIN index_runs r ON r.index_name = 'article_chunks' AND r.status = 'success' AND s.received_at <= r.started_at) WHERE n = 1""",
    "p6_found": f"SELECT * FROM (SELECT * FROM {_instants_sql(_ARTICLE_VALUES)} UNION ALL SELECT * FROM {_instants_sql(_SITEMAP_VALUES)}) WHERE utc_us IS NOT NULL",
}
