"""Jobs for spark-submit: ``python -m sparkcorpus.cli COMMAND --root STORE ...``."""

from __future__ import annotations

import argparse
import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorpus.engine import Engine, parse_encyclopedia_ids, sync_summary
from sparkcorpus.functions.tokens import tokenizer_file
from sparkcorpus.operators.chunking import chunked
from sparkcorpus.operators.embedding import dimensions, embedded
from sparkcorpus.operators.providers import benchmark, routed
from sparkcorpus.operators.store import Store
from sparkcorpus.operators.sync import due_for_dump
from sparkcorpus.session import build_session
from sparkcorpus.sources import jsonl, sqlite
from sparkcorpus.sources.http import Fetcher


def dump_articles(store: Store, out: str, mode: str = "full", index_name: str | None = None) -> dict:
    """All articles, or those due for an index, as JSON lines in order of id; the counts."""
    articles = store.articles()
    total = articles.count()
    if mode == "incremental":
        row = store.index_row(index_name or "")
        if row is None:
            raise ValueError(f"no index {index_name}")
        articles = due_for_dump(articles, store.index(index_name), row["updated_at_column"] or "changed_at")
    elif mode != "full":
        raise ValueError(f"unknown mode: {mode}")
    head = {"dump_date": datetime.now(timezone.utc).isoformat(), "mode": mode, "index_name": index_name, "total_articles_in_db": total}
    jsonl.write_lines(jsonl.article_lines(articles.orderBy("id")), out, head)
    return {"total_articles": total, "dumped": articles.count()}


def generate_embeddings(spark, source: str, out: str, model: str, strategy: str = "sections", size: int = 512, overlap: int = 50, make=None, encoder=None, site: str | None = None) -> None:
    """Chunks and vectors of dumped articles as JSON lines; articles without text are left out."""
    rows = jsonl.read_articles(spark, source).where("valid")
    body = rows.where(F.col("xhtml_md").rlike(r"(?U)\S")).withColumn("body", F.concat(F.lit("# "), F.coalesce("headword", F.lit("")), F.lit("\n"), "xhtml_md"))
    chunks = embedded(chunked(body, "id", "body", strategy, size, overlap, encoder, site), "chunk_text", model, make=make)
    jsonl.write_lines(jsonl.chunk_lines(chunks), out, {"embedding_model": model, "dimensions": dimensions(model), "chunking_strategy": strategy, "chunk_size": size, "chunk_overlap": overlap})


def import_embeddings(store: Store, path: str, name: str) -> dict[str, int]:
    """Add the chunks of a file to an index; every line that can't be used is an error."""
    dims = dimensions(store.index_row(name)["embedding_model"])
    rows = jsonl.read_embeddings(store.spark, path, dims)
    bad = rows.where(~F.col("valid")).count()
    done = store.add_chunks(name, rows.where("valid").drop("valid"))
    return {"created": done["created"], "errors": done["errors"] + bad}


def export_sqlite(spark, database: str, name: str, out: str) -> None:
    """A vector table of a SQLite file as JSON lines, by article and chunk."""
    rows = sqlite.read_vectors(spark, database, name).orderBy("source_article_id", "chunk_sequence_id")
    jsonl.write_lines(jsonl.chunk_lines(rows), out, {"source": name})


def sitemap_addresses(encyclopedias: DataFrame, pattern: str = "{url_base}sitemap.xml") -> dict[int, str]:
    """The address of each site's map by encyclopedia id (a handful of sites)."""
    return {r["encyclopedia_id"]: pattern.format(**r.asDict()) for r in encyclopedias.collect()}


def sync_articles(engine: Engine, sitemaps: dict[int, str], fetch, ids: str | None = None, dry_run: bool = False, skip_indexes: bool = False, skip_scraping: bool = False, indexes: str | None = None) -> dict:
    """Bring the store up to date with its sites; ``ids`` and ``indexes`` are comma lists."""
    wanted = parse_encyclopedia_ids(ids, set(sitemaps))
    names = [n.strip() for n in indexes.split(",") if n.strip()] if indexes else None
    return engine.sync(sitemaps, fetch, wanted, dry_run, skip_indexes, skip_scraping, names)


def main(argv: list[str] | None = None, fetch=None) -> dict | None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["create-index", "update-indexes", "dump", "generate", "import", "export-sqlite", "sync", "benchmark", "build-cells"])
    parser.add_argument("--root", default="store")
    parser.add_argument("--index", default=None, help="an index; for sync a comma list of those to refresh")
    parser.add_argument("--input")
    parser.add_argument("--output")
    parser.add_argument("--mode", default="full")
    parser.add_argument("--model", default="mock_model")
    parser.add_argument("--strategy", default="sections")
    parser.add_argument("--chunk-size", type=int, default=512)
    parser.add_argument("--chunk-overlap", type=int, default=50)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--site", default=None, help="the site whose footers are cut from texts")
    parser.add_argument("--tokenizer", default=None, help="tokenizer file by which the strategy tokens counts")
    parser.add_argument("--service", default=None, help="address of an embedding service; its key is read from EMBEDDING_KEY")
    parser.add_argument("--models", default=None, help="folder of local models")
    parser.add_argument("--encyclopedias", default=None, help="parquet table of encyclopedia_id, host, url_base")
    parser.add_argument("--sitemap", default="{url_base}sitemap.xml", help="address of a site's map from the columns of its row")
    parser.add_argument("--encyclopedia-ids", default=None)
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--skip-vector-update", action="store_true")
    parser.add_argument("--skip-scraping", action="store_true")
    parser.add_argument("--texts", type=int, default=50)
    parser.add_argument("--text-length", type=int, default=200)
    a = parser.parse_args(argv)
    spark = build_session("sparkcorpus")
    encoder = tokenizer_file(a.tokenizer) if a.tokenizer else None
    make = None
    if a.service or a.models:
        make = routed(remote=a.service, key=os.environ.get("EMBEDDING_KEY"), folder=a.models, encoder=encoder, workers=spark.sparkContext.defaultParallelism)
    store = Store(spark, a.root, make=make, site=a.site, encoder=encoder)
    result = None
    if a.command == "create-index":
        store.create_index(a.index, model=a.model, strategy=a.strategy, size=a.chunk_size, overlap=a.chunk_overlap, force=a.force)
    elif a.command == "update-indexes":
        result = {n: store.refresh_index(n) for n in ([a.index] if a.index else [r[0] for r in store.indexes().select("index_name").collect()])}
    elif a.command == "dump":
        result = dump_articles(store, a.output, a.mode, a.index)
    elif a.command == "generate":
        generate_embeddings(spark, a.input, a.output, a.model, a.strategy, a.chunk_size, a.chunk_overlap, make, encoder, a.site)
    elif a.command == "import":
        result = import_embeddings(store, a.input, a.index)
    elif a.command == "sync":
        sites = spark.read.parquet(a.encyclopedias)
        engine = Engine(spark, store, sites, make_provider=make)
        result = sync_articles(engine, sitemap_addresses(sites, a.sitemap), fetch or Fetcher(), a.encyclopedia_ids, a.dry_run, a.skip_vector_update, a.skip_scraping, a.index)
        print(sync_summary(result, a.dry_run))
    elif a.command == "build-cells":
        result = store.build_cells(a.index)
    elif a.command == "benchmark":
        result = benchmark(a.model, a.texts, a.text_length, make)
    else:
        export_sqlite(spark, a.input, a.index, a.output)
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
