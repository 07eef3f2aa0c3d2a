"""The engine's surface: searches, listings and upkeep over a store, each as a DataFrame."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.functions.text import parse_answer
from sparkcorpus.operators import cells, fulltext, fusion, nearest, providers
from sparkcorpus.operators.embedding import dimensions, embedded
from sparkcorpus.operators.markdown import article_markdown
from sparkcorpus.operators.store import Store
from sparkcorpus.operators.sync import categorised, guarded, located, newest_entries, status_counts
from sparkcorpus.session import cut_lineage
from sparkcorpus.sources.sitemap import fetch_sitemaps, fetched, parse_sitemaps


class NotFound(LookupError):
    """An index that doesn't exist."""


def parse_ids(values: list[str] | str | None) -> list[int] | None:
    """Ids given as repeated values, comma lists or a JSON array; nothing, or an empty list, is no filter."""
    if not values:
        return None
    out: list[int] = []
    for value in [values] if isinstance(values, str) else values:
        text = value.strip()
        parts = json.loads(text) if text.startswith("[") else [p for p in text.split(",") if p.strip()]
        out += [int(p) for p in parts]
    return out or None


def parse_encyclopedia_ids(text: str | None, known: set[int] | None = None) -> list[int] | None:
    """Ids of a comma list; nothing gives None, an unknown or malformed one is an error."""
    if not text or not text.strip():
        return None
    out = [int(p) for p in text.split(",")]
    if known is not None and not set(out) <= known:
        raise ValueError(f"unknown encyclopedia ids: {sorted(set(out) - known)}")
    return out


class Engine:
    """Searches over a store; ``encyclopedias`` maps hosts and url bases to ids."""

    def __init__(self, spark: SparkSession, store: Store, encyclopedias: DataFrame, analyser: str = "danish", make_provider=None):
        self.spark, self.store, self.encyclopedias, self.analyser, self.make = spark, store, encyclopedias, analyser, make_provider

    def info(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "tables": self.tables()}

    def tables(self) -> list[str]:
        return [n for n in self.store.names() if not n.startswith("_")]

    def indexes(self) -> DataFrame:
        return self.store.indexes()

    def index(self, name: str) -> dict:
        row = self.store.index_row(name)
        if row is None:
            raise NotFound(name)
        return row

    def _queries(self, queries: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i, q) for i, q in enumerate(queries, 1)], "query long, text string")

    def articles(self, query: str | None = None, ids: list[int] | None = None, limit: int = 50) -> DataFrame:
        """id, xhtml_md, rank, url, title, total of the articles found by text, by ids, or both."""
        if not 1 <= limit <= 100:
            raise ValueError("the limit must be between 1 and 100")
        if query is None and not ids:
            raise ValueError("a query or ids are needed")
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id long").distinct() if ids else None
        docs = self.store.articles()
        if query is None:
            found = docs.join(wanted, "id", "left_semi").select("id", F.lit(0.0).alias("score"))
            rows = found.withColumn("total", F.lit(found.count())).orderBy("id").limit(limit)
        else:
            rows = fulltext.search(docs, "id", "xhtml_md", self._queries([query]), "query", "text", limit, self.analyser, wanted).select("id", "score", "total")
        return self._enriched(rows, "id").select("id", "xhtml_md", F.col("score").alias("rank"), "url", "title", "total").orderBy(F.desc("rank"), "id")

    def _enriched(self, rows: DataFrame, article: str) -> DataFrame:
        """With url (null where base or permalink is missing), title and changed_at of the article; joined after the limit."""
        bases = self.encyclopedias.select(F.col("encyclopedia_id"), "url_base")
        docs = self.store.articles().select(F.col("id").alias("__article"), "xhtml_md", "permalink", "headword", "changed_at", "encyclopedia_id").join(bases, "encyclopedia_id", "left")
        out = rows.join(docs, F.col(article) == F.col("__article"), "left")
        url = F.when(F.coalesce("permalink", F.lit("")) != "", F.concat("url_base", "permalink"))
        return out.withColumns({"url": url, "title": F.nullif("headword", F.lit(""))}).drop("__article", "permalink", "headword", "url_base", "encyclopedia_id")

    def vector_search_batch(self, name: str, queries: list[tuple[str, str]], top_k: int = 5, probes: int | None = cells.PROBES) -> DataFrame:
        """query, rank, id_in_index, source_article_id, chunk_seq, chunk_text, distance, url, title, changed_at; a blank query is an error.

        Reads ``probes`` cells a query where the index has cells (see ``Store.build_cells``), the whole index where it
        has none or ``probes`` is None.
        """
        row = self.index(name)
        if any(not q.strip() for q, _ in queries):
            raise ValueError("a query is blank")
        asked = embedded(self._queries([q for q, _ in queries]), "text", row["embedding_model"], "vector", self.make)
        chunks = self.store.index(name)
        dims, folder = dimensions(row["embedding_model"]), self.store.cells(name) if probes else None
        if folder:
            found = cells.search(self.spark, folder, asked, "query", "vector", dims, top_k, probes)
        else:
            found = nearest.nearest(chunks, "id", "embedding", asked, "query", "vector", dims, top_k)
        return self._hits(found.withColumnRenamed("distance", "score"), chunks).withColumnRenamed("score", "distance")

    def vector_search(self, name: str, query: str, top_k: int = 5) -> DataFrame:
        return self.vector_search_batch(name, [(query, "query")], top_k)

    def _hits(self, found: DataFrame, chunks: DataFrame) -> DataFrame:
        rows = found.join(chunks.select("id", "source_article_id", F.col("chunk_sequence_id").alias("chunk_seq"), "chunk_text"), "id").withColumnRenamed("id", "id_in_index")
        return self._enriched(rows, "source_article_id").drop("xhtml_md").orderBy("query", "rank")

    def text_search_batch(self, name: str, queries: list[str], top_k: int = 50) -> DataFrame:
        """The best chunks of each query; a blank query has no rows."""
        self.index(name)
        chunks = self.store.index(name)
        return self._hits(fulltext.search(chunks, "id", "chunk_text", self._queries(queries), "query", "text", top_k, self.analyser).select("query", "id", "score", "rank"), chunks)

    def hybrid_search(self, name: str, semantic: list[str], keyword: list[str], query_type: str = "unclear", top_k: int = 10, depth: int = 50, rrf_k: int = 60, mode: str = "canonical") -> DataFrame:
        """Fused vector and text hits with ``score`` and ``score_kind``; a single list isn't fused and keeps its own score."""
        weights = fusion.QUERY_WEIGHTS[query_type]
        lists, kinds = [], []
        pick = lambda df, q: df.where(F.col("query") == q).select(F.lit(1).cast("long").alias("query"), F.col("id_in_index").alias("id"), "rank", *[c for c in ("distance", "score") if c in df.columns])
        if semantic:
            hits = self.vector_search_batch(name, [(q, "query") for q in semantic], depth)
            lists += [pick(hits, i) for i in range(1, len(semantic) + 1)]
            kinds += ["semantic"] * len(semantic)
        if keyword:
            hits = self.text_search_batch(name, keyword, depth)
            lists += [pick(hits, i) for i in range(1, len(keyword) + 1)]
            kinds += ["fulltext"] * len(keyword)
        if len(lists) == 1:
            kind = "distance" if kinds[0] == "semantic" else "text"
            found = lists[0].withColumnRenamed("distance", "score").where(F.col("rank") <= top_k).withColumn("score_kind", F.lit(kind))
        else:
            found = fusion.fuse(lists, top_k, rrf_k, [weights[k] for k in kinds], mode=mode).withColumn("score_kind", F.lit("fused"))
        return self._hits(found, self.store.index(name)).drop("query")

    def hyde_search(self, name: str, query: str, answer, top_k: int = 10) -> DataFrame:
        """Hybrid search with a generated passage beside the query; ``answer(query)`` gives the model's text."""
        row = self._queries([answer(query)]).select(parse_answer(F.col("text")).alias("a")).select("a.*").first()
        if not row["passage"]:
            raise ValueError("the answer has no passage")
        return self.hybrid_search(name, [query, row["passage"]], [query], row["query_type"], top_k)

    # -- upkeep

    def plan_sync(self, sitemaps: dict[int, str], fetch, encyclopedia_ids: list[int] | None = None) -> DataFrame:
        """What new, modified and deleted articles the sites list; nothing is deleted unless every site map could be read.

        ``sitemaps``: the address of each site's map by encyclopedia id. Ids that are asked for and have none are an error.
        """
        return self._plan(sitemaps, fetch, encyclopedia_ids)[0]

    def _plan(self, sitemaps: dict[int, str], fetch, encyclopedia_ids: list[int] | None) -> tuple[DataFrame, dict]:
        unknown = set(encyclopedia_ids or []) - set(sitemaps)
        if unknown:
            raise ValueError(f"unknown encyclopedia ids: {sorted(unknown)}")
        wanted = {i: u for i, u in sitemaps.items() if not encyclopedia_ids or i in encyclopedia_ids}
        documents, good = fetch_sitemaps(self.spark, wanted, fetch)
        entries = newest_entries(parse_sitemaps(documents, "xml").select("url", "lastmod"))
        plan = categorised(located(entries, self.encyclopedias), self.store.articles(), sorted(wanted))
        # written once: fetching and deleting must follow the same plan, whatever the store becomes meanwhile
        plan = cut_lineage(guarded(plan, good == set(wanted)), "plan")
        return plan, {"sitemaps": len(good), "sitemaps_wanted": len(wanted), "deletions_skipped": good != set(wanted)}

    def sync(self, sitemaps: dict[int, str], fetch, encyclopedia_ids: list[int] | None = None, dry_run: bool = False, skip_indexes: bool = False, skip_scraping: bool = False, indexes: list[str] | None = None) -> dict:
        """Plan, fetch, upsert, delete, refresh the indexes; the counts of each step. A dry run writes nothing, and each page is fetched once."""
        stats: dict = {}
        if not skip_scraping:
            plan, stats = self._plan(sitemaps, fetch, encyclopedia_ids)
            stats |= dict.fromkeys(("new", "modified", "unchanged", "deleted"), 0) | {r["status"]: r["n"] for r in status_counts(plan).collect()}
            bodies = cut_lineage(fetched(plan.where("status in ('new', 'modified')"), "url", fetch), "pages")
            stats["attempted"], stats["fetched"] = stats["new"] + stats["modified"], bodies.count()
            stats["written"], stats["failed"] = self.store.upsert_articles(article_markdown(bodies.select("body"), "body"), self.encyclopedias, dry_run)
            stats["removed"] = self.store.delete_articles(plan.where("status = 'deleted'").select("id"), dry_run)
        stats["indexes"] = {} if dry_run or skip_indexes else self.refresh_indexes(indexes)
        return stats

    def refresh_indexes(self, names: list[str] | None = None) -> dict[str, dict]:
        """Refresh the named indexes, by default all; one that fails reports its error and leaves the others."""
        out = {}
        for r in self.store.indexes().select("index_name").collect():
            if names is None or r[0] in names:
                try:
                    out[r[0]] = self.store.refresh_index(r[0], self.make)
                except Exception as e:  # noqa: BLE001
                    out[r[0]] = {"error": str(e)[:200]}
        return out

    def benchmark_embeddings(self, model: str = "intfloat/multilingual-e5-small", num_texts: int = 50, text_length: int = 200) -> dict:
        """Speed of a model's provider on random texts (see ``providers.benchmark``)."""
        return providers.benchmark(model, num_texts, text_length, self.make)


def sync_summary(stats: dict, dry_run: bool = False) -> str:
    """The counts of a sync as lines of text."""
    lines = [f"mode: {'dry run' if dry_run else 'live'}"]
    lines += [f"{k.replace('_', ' ')}: {v}" for k, v in stats.items() if k != "indexes"]
    if stats.get("deletions_skipped"):
        lines.append(f"deletions skipped: {stats['sitemaps']} of {stats['sitemaps_wanted']} site maps could be read")
    for name, done in stats.get("indexes", {}).items():
        lines.append(f"index {name}: " + (f"ERROR {done['error']}" if "error" in done else ", ".join(f"{v} {k}" for k, v in done.items())))
    return "\n".join(lines)
