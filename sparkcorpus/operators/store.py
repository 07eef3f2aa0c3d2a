"""Versioned tables: upsert, delete with cascade, vector indexes and their catalogue.

A table is a folder of immutable parquet files in hash buckets; a version is a small file that names the folder of each
bucket, so readers see a whole version, a failed write leaves nothing, and a change rewrites only the buckets it touches.
Changes are anti joins and unions, never driver loops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcorpus.functions.text import is_blank
from sparkcorpus.functions.urls import host, permalink
from sparkcorpus.functions.vectors import right_size
from sparkcorpus.operators import cells
from sparkcorpus.operators.chunking import chunked
from sparkcorpus.operators.commits import CommitLog
from sparkcorpus.operators.embedding import dimensions, embedded
from sparkcorpus.operators.sync import index_plan
from sparkcorpus.session import cut_lineage

ARTICLES = "id bigint, headword string, xhtml string, xhtml_md string, permalink string, encyclopedia_id int, changed_at timestamp, created_at timestamp"
CHUNKS = "id bigint, embedding array<float>, source_article_id bigint, chunk_sequence_id int, chunk_text string, last_updated timestamp"
CATALOGUE = "index_name string, source_table string, source_column string, embedding_model string, chunk_size int, chunk_overlap int, chunking_strategy string, updated_at_column string, created_at timestamp, updated_at timestamp"


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``existing`` without a row in it. Keys compare null-safely by union with an anti join."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*existing.columns))


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of several rows of a key the one that comes last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def valid_articles(new: DataFrame) -> DataFrame:
    """Article JSON rows (see ``markdown.article_markdown``) with ``valid`` also requiring a url."""
    return new.withColumn("valid", F.col("valid") & (F.coalesce(F.col("url"), F.lit("")) != ""))


def article_rows(new: DataFrame, encyclopedias: DataFrame) -> DataFrame:
    """Rows of the articles table from valid article JSON; an unknown host leaves the row out, a missing creation time is the epoch."""
    hosts = encyclopedias.select(F.lower("host").alias("h"), "encyclopedia_id")
    rows = new.where("valid").join(hosts, host(F.col("url")) == F.col("h"))
    epoch = F.timestamp_seconds(F.lit(0))
    return rows.select("id", F.col("title").alias("headword"), F.col("xhtml_body").alias("xhtml"), "xhtml_md", permalink(F.col("url")).alias("permalink"), "encyclopedia_id", F.expr("try_cast(changed_at as timestamp)").alias("changed_at"), F.coalesce(F.expr("try_cast(created_at as timestamp)"), epoch).alias("created_at"))


#: Buckets a table is cut into by a hash of its key; what does not touch a bucket leaves its files alone.
BUCKETS = 64
#: What a table's buckets are cut by; others are one bucket.
_CUT_BY = {ARTICLES: "id", CHUNKS: "source_article_id"}


class Store:
    """Tables under a root folder. A table's rows lie in buckets by a hash of their article; a version (see ``CommitLog``)
    names the folder of each bucket, so a change writes the buckets it touches and takes over the others."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, make=None, site: str | None = None, encoder=None):
        """``buckets`` is for new tables. ``make`` gives the embedding provider of a model, ``encoder`` makes the tokenizer
        by whose tokens texts are chunked, ``site`` names the site whose footers are cut."""
        self.spark, self.root, self.buckets, self.make, self.site, self.encoder = spark, root.rstrip("/"), buckets, make, site, encoder
        self.fs = CommitLog(spark, self.root).fs

    def _log(self, name: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/{name}")

    def names(self) -> list[str]:
        top = self._log("").path("")
        if not self.fs.exists(top):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(top) if s.isDirectory())

    def version(self, name: str) -> int:
        """The newest version, 0 before any."""
        return self._log(name).version()

    def _bucket(self, schema: str, count: int) -> Column:
        key = _CUT_BY.get(schema)
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(count)).cast("int") if key else F.lit(0)

    def read(self, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """A table, or the given buckets of it."""
        _, last = self._log(name).last()
        folders = [f"{self.root}/{name}/{f}" for k, f in (last or {"files": {}})["files"].items() if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, name: str, schema: str, df: DataFrame | None = None, change=None, touched: DataFrame | None = None) -> int:
        """Publish a new version: ``df`` in place of the table, or ``change(old rows)`` in place of the buckets that the
        keys in ``touched`` lie in. If another writer published meanwhile, this is an error and changes nothing."""
        log = self._log(name)
        base, last = log.last()
        count = last["buckets"] if last else self.buckets if schema in _CUT_BY else 1
        at = self._bucket(schema, count)
        files = {}
        if df is None:
            # at most as many numbers as there are buckets
            hit = None if touched is None or last is None else sorted(r[0] for r in touched.toDF(_CUT_BY[schema]).select(at.alias("b")).distinct().collect())
            files = {} if hit is None else {k: f for k, f in last["files"].items() if int(k) not in hit}
            df = change(self.read(name, schema, hit))
        folder = f"v{base + 1:06d}_{uuid.uuid4().hex[:8]}"
        rows = df.withColumn("b", at)
        # rebalanced by bucket, so that a bucket is few files and one that holds very much is many tasks
        (rows if count == 1 else rows.hint("rebalance", "b")).write.partitionBy("b").parquet(f"{self.root}/{name}/{folder}")
        made = [s.getPath().getName() for s in self.fs.listStatus(log.path(folder)) if s.isDirectory()]
        files |= {n[2:]: f"{folder}/{n}" for n in made if n.startswith("b=")}
        if log.publish(base, {"buckets": count, "files": files}) is None:
            raise RuntimeError(f"{name} was changed by another writer")
        return base + 1

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete what none of a table's last ``keep`` versions uses, but not what another writer is making; the folders deleted."""
        log = self._log(name)
        at = log.version()
        used = {f.split("/")[0] for v in range(max(1, at - keep + 1), at + 1) for f in log.payload(v)["files"].values()}
        made = [s.getPath() for s in self.fs.listStatus(log.path("")) if s.isDirectory()]
        old = [p for p in made if p.getName().startswith("v") and p.getName() not in used and int(p.getName()[1:7]) <= at]
        for path in old:
            self.fs.delete(path, True)
        return len(old)

    # -- articles

    def articles(self) -> DataFrame:
        return self.read("articles", ARTICLES)

    def upsert_articles(self, new: DataFrame, encyclopedias: DataFrame, dry_run: bool = False) -> tuple[int, int]:
        """(written, failed) of article JSON rows; rows that aren't valid fail alone. ``new`` is read once, whatever it takes to make it."""
        judged = cut_lineage(valid_articles(new).select("id", "title", "xhtml_body", "xhtml_md", "url", "changed_at", "created_at", "valid"), "upsert")
        rows = last_of(article_rows(judged, encyclopedias), ["id"], ["changed_at", "created_at", "headword"])
        total, good = judged.count(), rows.count()
        if not dry_run and good:
            self.write("articles", ARTICLES, change=lambda old: upserted(old, rows, ["id"]), touched=rows.select("id"))
        return good, total - good

    def delete_articles(self, ids: DataFrame, dry_run: bool = False) -> int:
        """Number of articles deleted, with their chunks in every index.

        The indexes go first, and whether or not an article is still there: a run that dies in between and is repeated
        leaves no chunk without its article.
        """
        gone = cut_lineage(ids.select(F.col(ids.columns[0]).cast("long").alias("id")).where("id is not null").distinct(), "gone")
        count = self.articles().join(gone, "id", "left_semi").count()
        if dry_run or gone.isEmpty():
            return count
        for row in self.indexes().select("index_name").collect():
            self._drop(row[0], CHUNKS, "source_article_id", gone)
        self._drop("articles", ARTICLES, "id", gone)
        return count

    def _drop(self, name: str, schema: str, key: str, gone: DataFrame) -> int:
        """Number of rows of a table that go because their key is in ``gone``."""
        gone = gone.toDF(key)
        hit = self.read(name, schema).join(gone, key, "left_semi")
        found = hit.count()
        if found:
            self.write(name, schema, change=lambda old: old.join(gone, key, "left_anti").select(*old.columns), touched=hit.select(key))
        return found

    # -- indexes

    def indexes(self) -> DataFrame:
        return self.read("_catalogue", CATALOGUE)

    def index_row(self, name: str) -> dict | None:
        row = self.indexes().where(F.col("index_name") == name).first()
        return row.asDict() if row else None

    def index(self, name: str) -> DataFrame:
        return self.read(name, CHUNKS)

    def create_index(self, name: str, source_table: str = "articles", source_column: str = "xhtml_md", model: str = "mock_model", size: int = 512, overlap: int = 50, strategy: str = "tokens", updated_at: str = "changed_at", force: bool = False) -> None:
        """An empty index and its catalogue row; an existing one is an error unless forced."""
        if self.index_row(name) and not force:
            raise ValueError(f"index {name} exists")
        if size <= overlap:
            raise ValueError("the chunk size must exceed the overlap")
        dimensions(model)
        self.write(name, CHUNKS, self.spark.createDataFrame([], CHUNKS))
        row = self.spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("index_name", name), ("source_table", source_table), ("source_column", source_column), ("embedding_model", model))], F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), F.lit(strategy).alias("chunking_strategy"), F.lit(updated_at).alias("updated_at_column"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
        self.write("_catalogue", CATALOGUE, upserted(self.indexes(), row, ["index_name"]))

    def update_index_row(self, name: str, **values) -> None:
        """Set the given fields of a catalogue row; updated_at becomes now."""
        unknown = set(values) - set(self.indexes().columns)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        mine = F.col("index_name") == name
        changed = {k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}
        self.write("_catalogue", CATALOGUE, self.indexes().withColumns(changed | {"updated_at": F.when(mine, F.current_timestamp()).otherwise(F.col("updated_at"))}))

    def build_cells(self, name: str) -> int:
        """Make the approximate search of an index's present version; the number of cells. A later version needs a new one."""
        at, dims = self.version(name), dimensions(self.index_row(name)["embedding_model"])
        log = CommitLog(self.spark, f"{self.root}/_cells/{name}")
        folder = f"v{at:06d}_{uuid.uuid4().hex[:8]}"
        made = cells.build(self.index(name), "id", "embedding", dims, f"{log.root}/{folder}")
        if log.publish(log.version(), {"of": at, "folder": folder}) is None:
            raise RuntimeError(f"the cells of {name} were made by another writer")
        return made

    def cells(self, name: str) -> str | None:
        """The folder of the cells of an index's present version, None where there are none."""
        log = CommitLog(self.spark, f"{self.root}/_cells/{name}")
        _, last = log.last()
        return f"{log.root}/{last['folder']}" if last and last["of"] == self.version(name) else None

    def add_chunks(self, name: str, chunks: DataFrame) -> dict[str, int]:
        """Upsert chunks with vectors on (article, sequence): {created, errors}.

        A blank text, a missing number or a vector of another dimension is an error and leaves only that row out. A
        chunk that exists keeps its id; new ones get the next ones in order of (article, sequence).
        """
        dims = dimensions(self.index_row(name)["embedding_model"])
        good = ~is_blank(F.col("chunk_text")) & F.col("source_article_id").isNotNull() & F.col("chunk_sequence_id").isNotNull() & right_size(F.col("embedding"), dims)
        judged = chunks.withColumn("good", F.coalesce(good, F.lit(False)))
        counts = judged.agg(F.count("*"), F.sum(F.col("good").cast("int"))).first()
        key = ["source_article_id", "chunk_sequence_id"]
        new = last_of(judged.where("good").select(F.col(key[0]).cast("long"), F.col(key[1]).cast("int"), "chunk_text", "embedding"), key, ["chunk_text"])
        if counts[1]:
            old = self.index(name)
            kept = new.join(old.select(*key, "id"), key, "left")
            rows = cut_lineage(numbered_rows(kept, "id", self._top(name), key).withColumn("last_updated", F.current_timestamp()).select(*old.columns), "chunks")
            self.write(name, CHUNKS, change=lambda old: upserted(old, rows, key), touched=rows.select("source_article_id"))
        return {"created": int(counts[1] or 0), "errors": int(counts[0] - (counts[1] or 0))}

    def _top(self, name: str) -> int:
        return self.index(name).agg(F.max("id")).first()[0] or 0

    def remove_article(self, name: str, article_id: int) -> int:
        """Number of chunks removed from an index."""
        return self._drop(name, CHUNKS, "source_article_id", self.spark.createDataFrame([(article_id,)], "id long"))

    def refresh_index(self, name: str, make=None) -> dict[str, int]:
        """Bring an index up to date with its source: {created, deleted, errors}.

        Chunks of deleted and changed articles go, new and changed articles are chunked and embedded by the catalogue's
        settings. Articles without text are errors and get no chunks. Nothing is written where nothing is due.
        """
        row = self.index_row(name)
        if row is None:
            raise ValueError(f"no index {name}")
        source = self.articles() if row["source_table"] == "articles" else self.spark.table(row["source_table"])
        old = self.index(name)
        plan = cut_lineage(index_plan(source, old, row["updated_at_column"] or "changed_at").where("action <> 'skip'"), "plan")
        stale = plan.where("action in ('delete', 'update')").select(F.col("id").alias("source_article_id"))
        due = source.join(plan.where("action in ('create', 'update')").select("id"), "id", "left_semi")
        text = F.col(row["source_column"])
        errors = due.where(is_blank(text)).count()
        headed = due.where(~is_blank(text)).withColumn("body", F.concat(F.lit("# "), F.coalesce("headword", F.lit("")), F.lit("\n"), text))
        pieces = embedded(chunked(headed, "id", "body", row["chunking_strategy"], row["chunk_size"], row["chunk_overlap"], self.encoder, self.site), "chunk_text", row["embedding_model"], make=make or self.make)
        new = numbered_rows(pieces.withColumn("id", F.lit(None).cast("long")), "id", self._top(name), ["source_article_id", "chunk_sequence_id"]).withColumn("last_updated", F.current_timestamp())
        # embedded once: what is counted is what is written
        new = cut_lineage(new.select(*old.columns), "chunks")
        created, deleted = new.count(), old.join(stale, "source_article_id", "left_semi").count()
        if created or deleted:
            rows = lambda kept: kept.join(stale, "source_article_id", "left_anti").select(*kept.columns).unionByName(new)
            self.write(name, CHUNKS, change=rows, touched=plan.select("id"))
        return {"created": created, "deleted": deleted, "errors": errors}


def numbered_rows(df: DataFrame, id_col: str, top: int, order: list[str]) -> DataFrame:
    """Rows without an id get the numbers after ``top`` in the given order.

    Each sorted range counts its rows; a range's numbers begin behind the counts of the ranges before it, so no task
    sees all rows.
    """
    # written once: the ranges are sampled, and both uses below must see the same ones
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    parts = parts.withColumn("__missing", F.col(id_col).isNull().cast("long"))
    counts = parts.groupBy("__part").agg(F.sum("__missing").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.sum("__missing").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("__within", within).join(before, "__part")
    return out.withColumn(id_col, F.coalesce(F.col(id_col), F.lit(top) + F.col("__before") + F.col("__within"))).drop("__part", "__missing", "__within", "__before")
