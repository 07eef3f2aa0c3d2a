"""Whole-table queries for every operator of the engine, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.engine import Engine
from sparkcorpus.functions import text as tx
from sparkcorpus.functions import analysis, tokens, urls, vectors
from sparkcorpus.operators import cells, chunking, embedding, fulltext, fusion, markdown, nearest, providers, store, sync
from sparkcorpus.operators.instants import CANDIDATES, normalise_instants
from sparkcorpus.plans.problems import _ARTICLE_VALUES, _SITEMAP_VALUES, _instants_sql
from sparkcorpus.session import shared_dir, table
from sparkcorpus.sources import jsonl, sitemap
from sparkcorpus.streaming.incremental import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space as Unicode has it, for the SQL side.
_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ARTICLES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, row_id DESC) AS rn FROM articles) WHERE rn = 1)"
#: The same with the instant of the delivered changed_at.
_DATED = f"(SELECT x.*, i.utc_us AS changed_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, row_id DESC) AS rn FROM articles) x JOIN {_instants_sql(_ARTICLE_VALUES)} i ON i.row_key = x.row_id WHERE x.rn = 1)"
_URL = "CASE WHEN coalesce(a.permalink, '') <> '' THEN e.url_base || a.permalink END"
_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _dated(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a delivered text as a timestamp, null where it denotes none; values without zone are local time of the sites."""
    rows = normalise_instants(df, column, "__us", [], "", zone=CANDIDATES[0])
    return rows.withColumn(column, F.timestamp_micros("__us")).drop("__us")


def current_articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The row of each article that was delivered last, as upserts in that order leave it; changed_at is the instant it was delivered with."""
    rows = table(spark, sf_dir, "articles")
    keep = [c for c in (columns or rows.columns) if c not in ("id", "received_at", "row_id", "changed_at")]
    return _dated(store.last_of(rows.select("id", "received_at", "row_id", "changed_at", *keep), ["id"], ["received_at", "row_id"]), "changed_at")


def _every_hundredth(df: DataFrame, key: str) -> DataFrame:
    """The stated set of queries: every row whose id is divisible by 100."""
    return df.where(F.col(key) % 100 == 0)


# -- scans and lookups


@query(f"SELECT a.id, a.headword, {_URL} AS url, 0.0::DOUBLE AS rank, count(*) OVER () AS total FROM {_ARTICLES} a LEFT JOIN encyclopedias e USING (encyclopedia_id) WHERE a.id IN (SELECT source_article_id FROM article_chunks WHERE chunk_sequence_id = 0)")
def articles_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of the articles whose ids are asked for (here: those with a first chunk), with their number and url."""
    ids = table(spark, sf_dir, "article_chunks").where("chunk_sequence_id = 0").select(F.col("source_article_id").alias("id"))
    docs = current_articles(spark, sf_dir, "headword", "permalink", "encyclopedia_id").join(ids, "id", "left_semi")
    rows = docs.join(table(spark, sf_dir, "encyclopedias").select("encyclopedia_id", "url_base"), "encyclopedia_id", "left")
    url = F.when(F.coalesce("permalink", F.lit("")) != "", F.concat("url_base", "permalink"))
    return rows.select("id", "headword", url.alias("url"), F.lit(0.0).alias("rank"), F.lit(docs.count()).cast("long").alias("total"))


@query(f"SELECT id, coalesce(changed_us, 0) AS changed_us FROM {_DATED} a")
def article_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's time, the epoch where it has none."""
    return current_articles(spark, sf_dir, "created_at").select("id", F.unix_micros(F.coalesce("changed_at", F.timestamp_seconds(F.lit(0)))).alias("changed_us"))


@query(f"SELECT id, permalink, encyclopedia_id, changed_us FROM {_DATED} a")
def article_metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_articles(spark, sf_dir, "permalink", "encyclopedia_id").select("id", "permalink", "encyclopedia_id", F.unix_micros("changed_at").alias("changed_us"))


@query("SELECT source_article_id, epoch_us(min(last_updated)) AS updated_us FROM article_chunks GROUP BY source_article_id")
def index_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest chunk of each article of an index."""
    return sync.index_times(table(spark, sf_dir, "article_chunks")).select("source_article_id", F.unix_micros("last_updated").alias("updated_us"))


@query("SELECT m.index_name, m.source_table, m.source_column, m.embedding_model, m.chunk_size, m.chunk_overlap, m.chunking_strategy, coalesce(m.updated_at_column, 'changed_at') AS updated_at_column, coalesce(r.runs, 0) AS good_runs FROM vector_index_metadata m LEFT JOIN (SELECT index_name, count(*) AS runs FROM index_runs WHERE status = 'success' GROUP BY 1) r USING (index_name)")
def index_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of indexes with their successful runs."""
    runs = table(spark, sf_dir, "index_runs").where("status = 'success'").groupBy("index_name").agg(F.count("*").alias("good_runs"))
    rows = table(spark, sf_dir, "vector_index_metadata").join(runs, "index_name", "left")
    return rows.select("index_name", "source_table", "source_column", "embedding_model", "chunk_size", "chunk_overlap", "chunking_strategy", F.coalesce("updated_at_column", F.lit("changed_at")).alias("updated_at_column"), F.coalesce("good_runs", F.lit(0)).alias("good_runs"))


@query("SELECT row_id AS id, xhtml_md AS content FROM articles")
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source table and column by the catalogue's names."""
    row = table(spark, sf_dir, "vector_index_metadata").where("index_name = 'article_chunks'").first()
    return table(spark, sf_dir, row["source_table"]).select(F.col("row_id").alias("id"), F.col(row["source_column"]).alias("content"))


@query("SELECT source_article_id, count(*) AS chunks FROM article_chunks GROUP BY 1")
def chunks_per_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_chunks").groupBy("source_article_id").agg(F.count("*").alias("chunks"))


# -- urls


@query("SELECT s.entry_id, e.encyclopedia_id AS of_host, s.permalink AS of_url FROM sitemap_entries s LEFT JOIN encyclopedias e ON lower(regexp_extract(s.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) = e.host")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encyclopedia and permalink of every listed url; the delivered permalink is what must come out."""
    hosts = table(spark, sf_dir, "encyclopedias").select(F.lower("host").alias("h"), F.col("encyclopedia_id").alias("of_host"))
    rows = table(spark, sf_dir, "sitemap_entries").select("entry_id", "url")
    return rows.join(hosts, urls.host(F.col("url")) == F.col("h"), "left").select("entry_id", "of_host", urls.permalink(F.col("url")).alias("of_url"))


@query(f"SELECT a.id, {_URL} AS url, nullif(a.headword, '') AS title FROM {_ARTICLES} a LEFT JOIN encyclopedias e USING (encyclopedia_id)")
def article_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_articles(spark, sf_dir, "headword", "permalink", "encyclopedia_id").join(table(spark, sf_dir, "encyclopedias").select("encyclopedia_id", "url_base"), "encyclopedia_id", "left")
    return rows.select("id", F.when(F.coalesce("permalink", F.lit("")) != "", F.concat("url_base", "permalink")).alias("url"), F.nullif("headword", F.lit("")).alias("title"))


# -- full-text search

_QUERIES = "(SELECT doc_id AS query, headword FROM documents WHERE doc_id % 100 = 0)"


def _fts_sql(docs: str, id_col: str, text: str, k: int, extra: str = "") -> str:
    return f"""WITH q AS (SELECT query, list_distinct({_TOKENS.format('headword')}) AS lex FROM {_QUERIES}),
    ql AS (SELECT query, len(lex) AS n, unnest(lex) AS lexeme FROM q),
    p AS (SELECT id, lexeme, count(*) AS tf FROM (SELECT {id_col} AS id, unnest({_TOKENS.format(text)}) AS lexeme FROM {docs} {extra}) GROUP BY 1, 2),
    m AS (SELECT query, id, round(sum(tf / (tf + 1)) / any_value(n), 6) AS score FROM ql JOIN p USING (lexeme) GROUP BY 1, 2 HAVING count(*) = any_value(n))
    SELECT query, id, score, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query) AS total FROM m) WHERE rank <= {k}"""


def _headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_hundredth(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("query"), F.col("headword").alias("asked"))


@query(_fts_sql("documents", "doc_id", "text", 50))
def fts_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords of the stated documents as queries against all documents."""
    return fulltext.search(table(spark, sf_dir, "documents"), "doc_id", "text", _headwords(spark, sf_dir), "query", "asked", 50)


@query(_fts_sql("article_chunks", "id", "chunk_text", 10))
def fts_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search(table(spark, sf_dir, "article_chunks"), "id", "chunk_text", _headwords(spark, sf_dir), "query", "asked", 10)


@query(_fts_sql(_ARTICLES + " a", "id", "xhtml_md", 50, "WHERE encyclopedia_id = 15"))
def fts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among given ids (here: the articles of one encyclopedia)."""
    docs = current_articles(spark, sf_dir, "xhtml_md", "encyclopedia_id")
    return fulltext.search(docs, "id", "xhtml_md", _headwords(spark, sf_dir), "query", "asked", 50, ids=docs.where("encyclopedia_id = 15").select("id"))


@query("SELECT query, count(*) AS total FROM (" + _fts_sql("documents", "doc_id", "text", 1_000_000_000) + ") GROUP BY query")
def fts_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.matches(table(spark, sf_dir, "documents"), "doc_id", "text", _headwords(spark, sf_dir), "query", "asked").groupBy("query").agg(F.count("*").alias("total"))


@query(f"SELECT q.query, coalesce(list(r.id ORDER BY r.rank) FILTER (r.id IS NOT NULL), []::BIGINT[]) AS ids FROM {_QUERIES} q LEFT JOIN (" + _fts_sql("documents", "doc_id", "text", 5) + ") r USING (query) GROUP BY q.query")
def fts_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of ids for each query, empty where nothing matches."""
    asked = _headwords(spark, sf_dir)
    found = fulltext.search(table(spark, sf_dir, "documents"), "doc_id", "text", asked, "query", "asked", 5)
    lists = found.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return asked.select("query").join(lists, "query", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


@query(f"SELECT lexeme, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS lexeme FROM documents) GROUP BY 1")
def lexeme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of all documents, by lexeme."""
    return fulltext.postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("lexeme").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


def _danish_sql() -> str:
    """Stems of all words by the published algorithm, step by step; ``s`` is where the part that may be cut begins."""
    tail = "substring(w, s + 1)"
    ends = lambda pattern: f"regexp_matches({tail}, '({pattern})$')"
    cut = lambda pattern: f"left(w, length(w) - length(regexp_extract({tail}, '({pattern})$', 1)))"
    doubled = f"CASE WHEN {ends('gd|dt|gt|kt')} THEN left(w, length(w) - 1) ELSE w END"
    main = "|".join(analysis.MAIN_SUFFIXES)
    steps = (
        f"CASE WHEN {ends(main)} THEN {cut(main)} WHEN {ends('s')} AND length(w) > 1 AND contains('abcdfghjklmnoprtvyzå', right(left(w, length(w) - 1), 1)) THEN left(w, length(w) - 1) ELSE w END",
        doubled,
        "CASE WHEN w LIKE '%igst' THEN left(w, length(w) - 2) ELSE w END",
        f"CASE WHEN length({tail}) >= 2 AND right(w, 1) = right(left(w, length(w) - 1), 1) AND NOT contains('aeiouyæøå', right(w, 1)) THEN left(w, length(w) - 1) ELSE w END",
    )
    sql = "SELECT word, word AS w, CASE WHEN r = '' THEN length(word) ELSE greatest(length(r), 3) END AS s FROM (SELECT word, regexp_extract(word, '^.*?[aeiouyæøå][^aeiouyæøå]') AS r FROM (SELECT DISTINCT word FROM t))"
    for step in steps[:3]:
        sql = f"SELECT word, s, {step} AS w FROM ({sql})"
    # a suffix goes and then, within what may be cut, the last letter of a doubled ending
    sql = f"SELECT word, s, w, {ends('løst')} AS l, {ends('elig|els|lig|ig')} AS x FROM ({sql})"
    sql = f"SELECT word, s, x AND NOT l AS x, CASE WHEN l THEN left(w, length(w) - 1) WHEN x THEN {cut('elig|els|lig|ig')} ELSE w END AS w FROM ({sql})"
    sql = f"SELECT word, s, CASE WHEN x THEN {doubled} ELSE w END AS w FROM ({sql})"
    return f"SELECT word, {steps[3]} AS lexeme FROM ({sql})"


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS word FROM documents), k AS (SELECT * FROM t WHERE NOT list_contains({sorted(analysis.STOP_WORDS)!r}, word)), m AS ({_danish_sql()})
    SELECT lexeme, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k JOIN m USING (word) GROUP BY 1""")
def danish_lexeme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``lexeme_counts``, without stop words and stemmed."""
    return fulltext.postings(table(spark, sf_dir, "documents"), "doc_id", "text", "danish").groupBy("lexeme").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


# -- vector search

_NEAR = """SELECT query, id, distance, rank FROM (SELECT q.vec_id AS query, i.vec_id AS id, round(list_cosine_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6), i.vec_id) AS rank
    FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0) WHERE rank <= {k}"""


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index = table(spark, sf_dir, "embeddings")
    return nearest.nearest(index, "vec_id", "embedding", _every_hundredth(index, "vec_id"), "vec_id", "embedding", 64, k)


@query(_NEAR.format(k=5))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 5)


@query(_NEAR.format(k=5))
def vector_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from cells, all of which are probed, so that nothing is left out."""
    index, path = table(spark, sf_dir, "embeddings"), shared_dir(spark, "cells")
    made = cells.build(index, "vec_id", "embedding", 64, path)
    return cells.search(spark, path, _every_hundredth(index, "vec_id"), "vec_id", "embedding", 64, 5, made)


@query(f"""WITH n AS ({_NEAR.format(k=5)}) SELECT n.query, n.rank, n.id, n.distance, nullif(d.headword, '') AS title FROM n LEFT JOIN documents d ON d.doc_id = n.id""")
def vector_topk_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors with the title of the document they stand for; titles are joined after the limit."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.nullif("headword", F.lit("")).alias("title"))
    return _nearest(spark, sf_dir, 5).join(docs, "id", "left").select("query", "rank", "id", "distance", "title")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("length"), F.transform(vectors.l2_normalised(v), lambda x: F.round(x, 6)).alias("unit"))


@query("SELECT coalesce(len(embedding), -1) = 64 AS right_size, count(*) AS chunks FROM article_chunks GROUP BY 1")
def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_chunks").groupBy(vectors.right_size(F.col("embedding"), 64).alias("right_size")).agg(F.count("*").alias("chunks"))


@query("SELECT id, embedding FROM article_chunks")
def blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to little-endian blobs and back."""
    return table(spark, sf_dir, "article_chunks").select("id", vectors.from_blob(vectors.to_blob("embedding")).alias("embedding"))


@query()
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank document embedded by the deterministic provider."""
    return embedding.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "mock_model").select("doc_id", "embedding")


@query("""SELECT id, list_transform(range(4), lambda d: round(list_avg(list_transform(range(m), lambda j: embedding[j * 4 + d + 1]::DOUBLE)), 5)) AS mean, list_transform(embedding[(m - 1) * 4 + 1 : m * 4], lambda x: round(x::DOUBLE, 5)) AS last
    FROM (SELECT id, embedding, id % 16 + 1 AS m FROM article_chunks WHERE len(embedding) = 64)""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors as the hidden states of sixteen tokens, of which the first few are no padding, pooled in both ways."""
    pooled = "mean array<double>, last array<double>"

    @F.pandas_udf(pooled)
    def pool(ids: pd.Series, rows: pd.Series) -> pd.DataFrame:
        hidden = np.stack(rows.to_list()).astype(np.float64).reshape(-1, 16, 4)
        mask = (np.arange(16)[None, :] <= (ids.to_numpy() % 16)[:, None]).astype(np.int64)
        means, lasts = providers.mean_pooled(hidden, mask), providers.last_token_pooled(hidden, mask)
        return pd.DataFrame({"mean": list(means.round(5)), "last": list(lasts.round(5))})

    rows = table(spark, sf_dir, "article_chunks").where(vectors.right_size(F.col("embedding"), 64))
    return rows.select("id", pool("id", "embedding").alias("p")).select("id", "p.mean", "p.last")


# -- fusion

_LISTS = f"""WITH s AS ({_NEAR.format(k=50)}), t AS ({_NEAR.format(k=50).replace('i.embedding::DOUBLE[]', 'list_reverse(i.embedding)::DOUBLE[]')}),
    r AS (SELECT query, id, rank, 1 AS list_no FROM s UNION ALL SELECT query, id, rank, 2 AS list_no FROM t)"""


def _two_lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    index = table(spark, sf_dir, "embeddings")
    asked = _every_hundredth(index, "vec_id")
    turned = index.withColumn("embedding", F.reverse("embedding"))
    return [nearest.nearest(i, "vec_id", "embedding", asked, "vec_id", "embedding", 64, 50) for i in (index, turned)]


def _fused_sql(place: str) -> str:
    return f"""{_LISTS}, f AS (SELECT query, id, round(sum(CASE list_no WHEN 1 THEN 1.2 ELSE 0.8 END / (60 + place)), 9) AS score, min((list_no, rank)) AS seen FROM (SELECT *, {place} AS place FROM r) GROUP BY 1, 2)
    SELECT query, id, score, rank FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen, id) AS rank FROM f) WHERE rank <= 10"""


@query(_fused_sql("rank"))
def rrf_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_two_lists(spark, sf_dir), 10, weights=[1.2, 0.8])


@query(_fused_sql("row_number() OVER (PARTITION BY query, id ORDER BY list_no)"))
def rrf_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_two_lists(spark, sf_dir), 10, weights=[1.2, 0.8], mode="reference")


@query(f"""WITH v AS ({_NEAR.format(k=50)}), k AS ({_fts_sql('documents', 'doc_id', 'text', 50)}),
    r AS (SELECT query, id, rank, 1 AS list_no FROM v UNION ALL SELECT query, id, rank, 2 AS list_no FROM k),
    f AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list_no, rank)) AS seen FROM r GROUP BY 1, 2)
    SELECT query, id, score, rank FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen, id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and text hits of the same query number, fused."""
    text = fulltext.search(table(spark, sf_dir, "documents"), "doc_id", "text", _headwords(spark, sf_dir), "query", "asked", 50)
    weights = fusion.QUERY_WEIGHTS["unclear"]
    return fusion.fuse([_nearest(spark, sf_dir, 50), text], 10, weights=[weights["semantic"], weights["fulltext"]])


# -- chunking


@query("""SELECT doc_id, i AS chunk, substring(text, (i * 462 + 1)::BIGINT, 512) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 512) / 462.0)::BIGINT))) AS i FROM documents WHERE text <> '')""")
def chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chars(F.col("text"), 512, 50)).alias("chunk", "piece"))


_SPLIT = f"list_filter(regexp_split_to_array(text, '{_WS}+'), lambda t: t <> '')"


@query(f"""SELECT doc_id, i AS chunk, CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(list_slice(w, i * 45 + 1, i * 45 + 50), ' ') END AS piece FROM
    (SELECT doc_id, text, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 50) / 45.0)::BIGINT))) AS i FROM (SELECT doc_id, text, {_SPLIT} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0)""")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.words(F.col("text"), 50, 5)).alias("chunk", "piece"))




def _parts(levels: int) -> str:
    return f"string_split(regexp_replace(text, '(#{{1,{levels}}}{_WS}+[^\\n]+)', chr(1) || '\\1' || chr(2), 'g'), chr(1))"



@query(f"""WITH p AS (SELECT doc_id, {_parts(3)} AS parts FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(range(2, len(parts) + 1)) AS i, parts FROM p),
    c AS (SELECT doc_id, i, {_strip(_strip("split_part(parts[i], chr(2), 1)") + " || chr(10) || " + _strip("split_part(parts[i], chr(2), 2)"))} AS section FROM u),
    d AS (SELECT doc_id, section, min(i) AS i FROM c WHERE section <> '' GROUP BY 1, 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk, section FROM d""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sections(F.col("text"))).alias("chunk", "section"))


@query(f"""WITH p AS (SELECT doc_id, {_parts(6)} AS parts FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, parts FROM p),
    c AS (SELECT doc_id, i, CASE WHEN i = 1 THEN '' ELSE {_strip("split_part(parts[i], chr(2), 1)")} END AS heading, CASE WHEN i = 1 THEN {_strip("parts[1]")} ELSE {_strip("split_part(parts[i], chr(2), 2)")} END AS content FROM u),
    d AS (SELECT doc_id, heading, content, min(i) AS i FROM c WHERE i > 1 OR content <> '' GROUP BY 1, 2, 3)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_no, heading, content FROM d""")
def sections_with_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sections_with_headings(F.col("text"))).alias("section_no", "s"))
    return rows.select("doc_id", "section_no", "s.heading", "s.content")


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", "semantic_chunks", 250, 30)


def _cleaned_sql() -> str:
    """Clean Markdown in SQL: a mark before each place where a heading may begin stands in for the look-ahead."""
    out = f"regexp_replace(coalesce(text, ''), '(#{{1,6}}{_WS})', chr(1) || '\\1', 'g')"
    for name in (f"Se{_WS}+også", "Relateret", f"Eksterne{_WS}+links?", f"External{_WS}+links?", f"Det{_WS}+sker"):
        out = f"regexp_replace({out}, '(?i)\\x01#{{2,6}}{_WS}+{name}[^\\x01]*', '', 'g')"
    return _strip(f"regexp_replace(replace({out}, chr(1), ''), '\\n\\n\\n+', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, {_cleaned_sql()} AS cleaned FROM documents")
def cleaned_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_markdown(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, coalesce(len({_SPLIT}), 0) AS words, coalesce(array_to_string({_SPLIT}, ' '), '') AS joined FROM documents")
def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("words"), F.array_join(words, " ").alias("joined"))


_REBUILT = f"""array_to_string(list_transform(w, lambda t, i: CASE WHEN i = 1 OR list_contains([',', '.', '!', '?', ';', ':', ')', ']', '}}', '"', chr(39)], t) OR list_contains(['(', '[', '{{', '"', chr(39)], right(w[i - 1], 1)) THEN '' ELSE ' ' END || t), '')"""


@query(f"SELECT doc_id, coalesce({_REBUILT}, '') AS rebuilt FROM (SELECT doc_id, {_SPLIT} AS w FROM documents)")
def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.reconstruct(tx.tokenize(F.col("text"))).alias("rebuilt"))


@query(f"SELECT doc_id, CASE WHEN len(w) <= 20 THEN text ELSE array_to_string(list_slice(w, 1, 20), ' ') END AS short, 'query: ' || text AS as_query, 'Document: ' || text AS as_passage FROM (SELECT doc_id, text, {_SPLIT} AS w FROM documents)")
def prefixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_words(text, 20).alias("short"), tx.prefixed(text, F.lit("query"), "e5").alias("as_query"), tx.prefixed(text, F.lit("passage"), "jina").alias("as_passage"))


@query("SELECT doc_id, coalesce(length(text), 0) // 4 AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as they are counted without an encoder."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_count(F.col("text")).alias("tokens"))


@query()
def chunk_tokens(spark: SparkSession, sf_dir: str, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """Windows of 256 tokens, 32 into each other, by the tokenizer file at ``tokenizer``."""
    rows = table(spark, sf_dir, "documents")
    return chunking.chunked(rows, "doc_id", "text", "tokens", 256, 32, tokens.tokenizer_file(tokenizer))


# -- sync

_ENTRIES = f"(SELECT s.url, s.permalink, s.encyclopedia_id, i.utc_us AS lastmod FROM sitemap_entries s JOIN {_instants_sql(_SITEMAP_VALUES)} i ON i.row_key = s.entry_id)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(table(spark, sf_dir, "sitemap_entries").select("url", "permalink", "encyclopedia_id", "lastmod"), "lastmod")


@query(f"SELECT url, max(lastmod) AS lastmod_us FROM {_ENTRIES} GROUP BY url")
def sitemap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.newest_entries(_entries(spark, sf_dir)).select("url", F.unix_micros("lastmod").alias("lastmod_us"))


_PLAN = f"""SELECT coalesce(l.encyclopedia_id, a.encyclopedia_id) AS encyclopedia_id, coalesce(l.permalink, a.permalink) AS permalink, a.id,
    CASE WHEN a.held IS NULL THEN 'new' WHEN l.listed IS NULL THEN 'deleted' WHEN a.changed_us IS NULL OR l.lastmod > a.changed_us THEN 'modified' ELSE 'unchanged' END AS status
    FROM (SELECT encyclopedia_id, permalink, max(lastmod) AS lastmod, true AS listed FROM {_ENTRIES} GROUP BY 1, 2) l
    FULL OUTER JOIN (SELECT encyclopedia_id, permalink, id, changed_us, true AS held FROM {_DATED} x) a ON l.encyclopedia_id = a.encyclopedia_id AND l.permalink = a.permalink"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.categorised(_entries(spark, sf_dir), current_articles(spark, sf_dir, "permalink", "encyclopedia_id"))


@query(_PLAN)
def sync_categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("encyclopedia_id", "permalink", "id", "status")


@query(f"SELECT status, count(*) AS n FROM ({_PLAN}) GROUP BY 1")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.status_counts(_plan(spark, sf_dir))


@query(f"SELECT status, count(*) AS n FROM ({_PLAN}) WHERE status <> 'deleted' GROUP BY 1")
def sync_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a plan for which a site map was missing."""
    return sync.status_counts(sync.guarded(_plan(spark, sf_dir), complete=False))


@query(f"""SELECT coalesce(a.id, i.id) AS id, CASE WHEN i.id IS NULL THEN 'create' WHEN a.id IS NULL THEN 'delete' WHEN a.changed_us > i.u THEN 'update' ELSE 'skip' END AS action
    FROM {_DATED} a FULL OUTER JOIN (SELECT source_article_id AS id, epoch_us(min(last_updated)) AS u FROM article_chunks GROUP BY 1) i ON a.id = i.id""")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.index_plan(current_articles(spark, sf_dir, "headword"), table(spark, sf_dir, "article_chunks"))


@query(f"SELECT DISTINCT a.id, a.headword, a.permalink FROM {_DATED} a LEFT JOIN article_chunks c ON a.id = c.source_article_id WHERE c.source_article_id IS NULL OR a.changed_us > epoch_us(c.last_updated)")
def incremental_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.due_for_dump(current_articles(spark, sf_dir, "headword", "permalink"), table(spark, sf_dir, "article_chunks")).select("id", "headword", "permalink")


@query(f"SELECT id, headword, xhtml_md, permalink, encyclopedia_id, changed_us, epoch_us(created_at) AS created_us FROM {_DATED} a")
def full_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as JSON lines and read again."""
    lines = jsonl.article_lines(current_articles(spark, sf_dir, "headword", "xhtml_md", "permalink", "encyclopedia_id", "created_at"))
    us = lambda c: F.unix_micros(F.expr(f"try_cast({c} as timestamp)"))
    rows = jsonl.parsed_lines(lines, jsonl.ARTICLE, ["id"]).where("valid")
    return rows.select("id", "headword", "xhtml_md", "permalink", "encyclopedia_id", us("changed_at").alias("changed_us"), us("created_at").alias("created_us"))


def _not_blank(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '[^{_WS[1:-1]}]')"


@query(f"SELECT source_article_id, chunk_sequence_id, chunk_text, embedding FROM article_chunks WHERE len(embedding) = 64 AND {_not_blank('chunk_text')}")
def embedding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as JSON lines and read again, without those an import refuses."""
    rows = jsonl.parsed_lines(jsonl.chunk_lines(table(spark, sf_dir, "article_chunks")), jsonl.EMBEDDING, ["article_id", "chunk_idx"])
    rows = rows.where(F.col("valid") & ~tx.is_blank(F.col("chunk_text")) & vectors.right_size(F.col("embedding"), 64))
    return rows.select(F.col("article_id").cast("long").alias("source_article_id"), F.col("chunk_idx").alias("chunk_sequence_id"), "chunk_text", "embedding")


@query(f"SELECT coalesce(encyclopedia_id, 0) AS encyclopedia_id, url, {_strip('lastmod')} AS lastmod_text FROM sitemap_entries WHERE {_strip('lastmod')} <> ''")
def sitemap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site maps of at most about a thousand entries written as XML from the listed entries, and parsed again."""
    rows = table(spark, sf_dir, "sitemap_entries").where("lastmod is not null").withColumn("encyclopedia_id", F.coalesce("encyclopedia_id", F.lit(0)))
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.concat(F.lit("<url><loc>"), escaped("url"), F.lit("</loc><lastmod>"), escaped("lastmod"), F.lit("</lastmod></url>"))
    docs = rows.groupBy("encyclopedia_id", F.floor(F.col("entry_id") / 1000).alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("body"), F.lit("</urlset>"))
    return sitemap.parse_sitemaps(docs.select("encyclopedia_id", xml.alias("xml")), "xml").select("encyclopedia_id", "url", "lastmod_text")


# -- store


_SINCE = "SELECT * FROM (SELECT *, {prio} AS prio, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, row_id DESC) AS rn FROM articles WHERE received_at {test} TIMESTAMPTZ '2024-01-01 00:00:00+00') WHERE rn = 1"


@query(f"SELECT id, headword, xhtml_md, permalink, encyclopedia_id, row_id FROM ({_SINCE.format(prio=2, test='>=')} UNION ALL {_SINCE.format(prio=1, test='<')}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio DESC) = 1")
def upsert_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrived since a day, upserted into what had arrived before."""
    columns = ["id", "headword", "xhtml_md", "permalink", "encyclopedia_id", "row_id"]
    rows = table(spark, sf_dir, "articles").select(*columns, "received_at")
    cut = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    held = lambda df: store.last_of(df, ["id"], ["received_at", "row_id"]).select(*columns)
    return store.upserted(held(rows.where(F.col("received_at") < cut)), held(rows.where(F.col("received_at") >= cut)), ["id"])


def _store(spark: SparkSession, sf_dir: str, articles: bool = True, chunks: bool = True) -> store.Store:
    """A store of the delivered articles and the index as it was left."""
    out = store.Store(spark, shared_dir(spark, "store"), buckets=8)
    if articles:
        out.write("articles", store.ARTICLES, current_articles(spark, sf_dir, "headword", "xhtml", "xhtml_md", "permalink", "encyclopedia_id", "created_at").drop("received_at", "row_id"))
    out.create_index("article_chunks", model="mock_model", size=700, overlap=70, strategy="characters")
    if chunks:
        out.write("article_chunks", store.CHUNKS, table(spark, sf_dir, "article_chunks").select("id", "embedding", "source_article_id", "chunk_sequence_id", "chunk_text", "last_updated"))
    return out


@query(f"SELECT c.id, c.source_article_id FROM article_chunks c WHERE c.source_article_id IS NULL OR c.source_article_id NOT IN (SELECT id FROM {_ARTICLES} a WHERE encyclopedia_id = 15)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the store keeps when the articles of one encyclopedia are deleted."""
    own = _store(spark, sf_dir)
    own.delete_articles(own.articles().where("encyclopedia_id = 15").select("id"))
    return own.index("article_chunks").select("id", "source_article_id")


@query(f"""SELECT count(*) FILTER (WHERE ok) AS created, count(*) FILTER (WHERE NOT ok) AS errors, count(DISTINCT (source_article_id, chunk_sequence_id)) FILTER (WHERE ok) AS stored
    FROM (SELECT *, coalesce({_not_blank('chunk_text')} AND len(embedding) = 64 AND source_article_id IS NOT NULL AND chunk_sequence_id IS NOT NULL, false) AS ok FROM article_chunks)""")
def precomputed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adding the stored chunks to an empty index creates, refuses and leaves; vectors of the right size stand for ones of the mock model's."""
    own = _store(spark, sf_dir, articles=False, chunks=False)
    short = F.when(vectors.right_size(F.col("embedding"), 64), F.slice("embedding", 1, 4))
    done = own.add_chunks("article_chunks", table(spark, sf_dir, "article_chunks").select("source_article_id", "chunk_sequence_id", "chunk_text", short.alias("embedding")))
    return own.index("article_chunks").agg(F.lit(done["created"]).cast("long").alias("created"), F.lit(done["errors"]).cast("long").alias("errors"), F.count("*").alias("stored"))


@query(f"""WITH d AS (SELECT a.id, a.xhtml_md, '# ' || coalesce(a.headword, '') || chr(10) || a.xhtml_md AS body, i.u IS NULL OR a.changed_us > i.u AS due FROM {_DATED} a
        LEFT JOIN (SELECT source_article_id AS id, epoch_us(min(last_updated)) AS u FROM article_chunks GROUP BY 1) i ON i.id = a.id),
    p AS (SELECT id, unnest(list_transform(generate_series(0, greatest(0, ceil((length(body) - 700) / 630.0)::BIGINT)), lambda k: substring(body, (k * 630 + 1)::BIGINT, 700))) AS piece FROM d WHERE due AND {_not_blank('xhtml_md')})
    SELECT id AS source_article_id, count(*) AS chunks FROM p WHERE {_not_blank('piece')} GROUP BY 1
    UNION ALL SELECT c.source_article_id, count(*) AS chunks FROM article_chunks c JOIN d ON d.id = c.source_article_id WHERE NOT coalesce(d.due, false) GROUP BY 1""")
def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each article after the index was brought up to date with the articles."""
    own = _store(spark, sf_dir)
    own.refresh_index("article_chunks")
    return own.index("article_chunks").groupBy("source_article_id").agg(F.count("*").alias("chunks"))


# -- the engine's surface

_ASKED = "(SELECT row_number() OVER (ORDER BY doc_id) AS query, headword FROM documents WHERE doc_id % 100 = 0)"


@query(f"""SELECT r.query, r.rank, r.id AS id_in_index, c.chunk_sequence_id AS chunk_seq, nullif(a.headword, '') AS title, {_URL} AS url
    FROM ({_fts_sql('article_chunks', 'id', 'chunk_text', 10).replace(_QUERIES, _ASKED)}) r JOIN article_chunks c ON c.id = r.id LEFT JOIN {_ARTICLES} a ON a.id = c.source_article_id LEFT JOIN encyclopedias e ON e.encyclopedia_id = a.encyclopedia_id""")
def engine_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated headwords as queries against the chunks of a store's index."""
    asked = [r[0] for r in _every_hundredth(table(spark, sf_dir, "documents"), "doc_id").orderBy("doc_id").select("headword").collect()]
    own = Engine(spark, _store(spark, sf_dir), table(spark, sf_dir, "encyclopedias"), "simple")
    return own.text_search_batch("article_chunks", asked, 10).select("query", "rank", "id_in_index", "chunk_seq", "title", "url")


@query(f"SELECT id, rank, url, title, total FROM (SELECT a.id, 0.0::DOUBLE AS rank, {_URL} AS url, nullif(a.headword, '') AS title, count(*) OVER () AS total FROM {_ARTICLES} a LEFT JOIN encyclopedias e USING (encyclopedia_id) WHERE a.id % 100 = 0) ORDER BY id LIMIT 100")
def engine_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a store by the stated ids, at most a hundred of them, with their number."""
    own = _store(spark, sf_dir)
    ids = [r[0] for r in _every_hundredth(own.articles().select("id"), "id").collect()]
    return Engine(spark, own, table(spark, sf_dir, "encyclopedias")).articles(ids=ids or [-1], limit=100).select("id", "rank", "url", "title", "total")


_COUNTED = "[length({0})::FLOAT, (length({0}) - length(replace({0}, 'a', '')))::FLOAT, (length({0}) - length(replace({0}, 'e', '')))::FLOAT, (length({0}) - length(replace({0}, 'n', '')))::FLOAT]"
#: The chunks as an index numbers them, with vectors that SQL can follow; and every stated headword that is not blank against them.
_INDEXED = f"""i AS (SELECT row_number() OVER (ORDER BY source_article_id, chunk_sequence_id) AS id, * FROM (SELECT source_article_id, chunk_sequence_id, max(chunk_text) AS chunk_text FROM article_chunks
        WHERE {_not_blank('chunk_text')} AND source_article_id IS NOT NULL AND chunk_sequence_id IS NOT NULL GROUP BY 1, 2)),
    q AS (SELECT row_number() OVER (ORDER BY doc_id) AS query, headword FROM documents WHERE doc_id % 100 = 0 AND {_not_blank('headword')}),
    d AS (SELECT q.query, i.id, round(list_cosine_distance({_COUNTED.replace('{0}', 'q.headword')}::DOUBLE[], {_COUNTED.replace('{0}', 'i.chunk_text')}::DOUBLE[]), 6) AS distance FROM q, i),
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) WHERE rank <= 50)"""


def _counted_engine(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[str]]:
    """An engine over a store whose index is embedded by ``_Counts``, and the stated headwords that are not blank."""
    own = _store(spark, sf_dir, chunks=False)
    rows = table(spark, sf_dir, "article_chunks").select("source_article_id", "chunk_sequence_id", "chunk_text")
    own.add_chunks("article_chunks", embedding.embedded(rows, "chunk_text", "mock_model", make=_counting))
    asked = _every_hundredth(table(spark, sf_dir, "documents"), "doc_id").where(~tx.is_blank(F.col("headword"))).orderBy("doc_id")
    return Engine(spark, own, table(spark, sf_dir, "encyclopedias"), "simple", _counting), [r[0] for r in asked.select("headword").collect()]


@query(f"""WITH {_INDEXED} SELECT v.query, v.rank, v.id AS id_in_index, v.distance, i.source_article_id, i.chunk_sequence_id AS chunk_seq, nullif(a.headword, '') AS title, {_URL} AS url
    FROM v JOIN i ON i.id = v.id LEFT JOIN {_ARTICLES} a ON a.id = i.source_article_id LEFT JOIN encyclopedias e ON e.encyclopedia_id = a.encyclopedia_id WHERE v.rank <= 5""")
def engine_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated headwords embedded and searched in a store's index, from cells that are all probed."""
    own, asked = _counted_engine(spark, sf_dir)
    made = own.store.build_cells("article_chunks")
    if not asked:
        return own.vector_search("article_chunks", "x").where("false").select("query", "rank", "id_in_index", "distance", "source_article_id", "chunk_seq", "title", "url")
    return own.vector_search_batch("article_chunks", [(x, "query") for x in asked], 5, made).select("query", "rank", "id_in_index", "distance", "source_article_id", "chunk_seq", "title", "url")


@query(f"""WITH {_INDEXED}, o AS (SELECT headword FROM q ORDER BY query LIMIT 1), w AS (SELECT list_distinct({_TOKENS.format('headword')}) AS lex FROM o),
    p AS (SELECT id, lexeme, count(*) AS tf FROM (SELECT id, unnest({_TOKENS.format('chunk_text')}) AS lexeme FROM i) GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(sum(tf / (tf + 1)) / any_value(len(lex)), 6) AS score FROM p JOIN w ON list_contains(lex, lexeme) GROUP BY 1 HAVING count(*) = any_value(len(lex)))),
    r AS (SELECT id, rank, 1 AS list_no, 0.8 AS weight FROM v WHERE query = 1 UNION ALL SELECT id, rank, 2 AS list_no, 1.2 AS weight FROM t WHERE rank <= 50),
    f AS (SELECT id, round(sum(weight / (60 + rank)), 9) AS score, min((list_no, rank)) AS seen FROM r GROUP BY 1)
    SELECT rank, id AS id_in_index, score, 'fused' AS score_kind FROM (SELECT *, row_number() OVER (ORDER BY score DESC, seen, id) AS rank FROM f) WHERE rank <= 10""")
def engine_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stated headword as an entity: vector and text hits of a store's index, fused by the entity's weights."""
    own, asked = _counted_engine(spark, sf_dir)
    found = own.hybrid_search("article_chunks", asked[:1] or ["x"], asked[:1] or ["x"], "entity").select("rank", "id_in_index", "score", "score_kind")
    return found if asked else found.where("false")


# -- documents as Markdown


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered HTML body as Markdown."""
    return table(spark, sf_dir, "articles").select("row_id", markdown.markdown_of("xhtml").alias("markdown"))


@query()
def article_json_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article JSON to Markdown with the metadata section."""
    a = table(spark, sf_dir, "articles")
    doc = F.struct("id", F.col("headword").alias("title"), F.col("xhtml").alias("xhtml_body"), F.col("permalink").alias("url"), "changed_at", F.create_map(F.lit("source_system"), F.lit("delivery")).alias("metadata"))
    return markdown.article_markdown(a.select("row_id", F.to_json(doc).alias("json")), "json").select("row_id", "valid", "xhtml_md")


_BARE = _strip("{0}").replace(_WS, _WS[:-1] + r"\x1C-\x1F]")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'entity' WHEN doc_id % 3 = 1 THEN 'conceptual' ELSE 'unclear' END AS query_type,
    {_BARE.replace('{0}', "array_to_string(list_concat([" + _BARE.replace('{0}', 'h[1]') + "], h[2:], ['second line']), ' ')")} AS passage FROM (SELECT doc_id, string_split(coalesce(headword, ''), chr(10)) AS h FROM documents)""")
def hyde_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers parsed; the answers are written from headwords."""
    kind = F.when(F.col("doc_id") % 3 == 0, "ENTITY").when(F.col("doc_id") % 3 == 1, "[conceptual]").otherwise("MIXED")
    answer = F.concat(F.lit("QUERYTYPE: "), kind, F.lit("\nPASSAGE:  "), F.coalesce("headword", F.lit("")), F.lit("\nsecond line"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.parse_answer(answer).alias("a")).select("doc_id", "a.*")


@query()
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of at most 8,000 words over all documents: number and size of each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokenize(F.col("text"))).alias("n"))
    return embedding.request_batches(rows, "doc_id", "n").groupBy("batch").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))


@query(f"SELECT sum(least(len(w), 8000))::BIGINT AS tokens, count(*) AS texts, 0::BIGINT AS too_large FROM (SELECT coalesce({_SPLIT}, []) AS w FROM documents)")
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for the requests whatever the partitions: all words and texts are in one, and none is over the limit."""
    sizes = request_batches(spark, sf_dir)
    return sizes.agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"), F.coalesce(F.sum(F.when(F.col("tokens") > 8_000, 1).otherwise(0)), F.lit(0)).cast("long").alias("too_large"))


class _Counts:
    """A provider that SQL can follow: a text's length, and how many of three letters it has."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), *(float(t.count(c)) for c in "aen")] for t in texts]


def _counting(model: str) -> _Counts:
    return _Counts()


@query(f"SELECT doc_id, [length(text)::FLOAT, (length(text) - length(replace(text, 'a', '')))::FLOAT, (length(text) - length(replace(text, 'e', '')))::FLOAT, (length(text) - length(replace(text, 'n', '')))::FLOAT] AS embedding FROM documents WHERE {_not_blank('text')}")
def embed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank document embedded by an injected provider, each text with its own vector."""
    return embedding.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "mock_model", make=_counting).select("doc_id", "embedding")


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: the batch form of the streaming aggregation."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"]).select("event_type", F.unix_micros("window_start").alias("hour_us"), "n")
