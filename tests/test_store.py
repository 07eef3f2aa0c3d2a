import json
import sqlite3
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcorpus import cli
from sparkcorpus.engine import Engine, NotFound, parse_encyclopedia_ids, parse_ids, sync_summary
from sparkcorpus.operators import sync
from sparkcorpus.operators.embedding import HashProvider, RetryingProvider, WindowLimiter, dimensions, request_batches
from sparkcorpus.operators.markdown import article_markdown
from sparkcorpus.operators.store import ARTICLES, Store
from sparkcorpus.sources import jsonl, sitemap, sqlite
from sparkcorpus.streaming.incremental import upsert_stream, windowed_counts


@pytest.fixture
def places(spark):
    return spark.createDataFrame([(1, "a.example", "https://a.example/"), (2, "b.example", "https://b.example/")], "encyclopedia_id int, host string, url_base string")


def article(i, body="<p>En by ved havet med en gammel kirke og en havn.</p>", host="a.example", changed="2024-01-01T00:00:00Z", **more):
    return json.dumps({"id": i, "title": f"Artikel {i}", "xhtml_body": body, "url": f"https://{host}/art_{i}", "changed_at": changed, **more})


def loaded(spark, store, places, *docs):
    return store.upsert_articles(article_markdown(spark.createDataFrame([(d,) for d in docs], "j string"), "j"), places)


def test_upsert_delete_and_indexes(spark, tmp_path, places):
    store = Store(spark, str(tmp_path / "s"))
    assert loaded(spark, store, places, article(1), article(2), "{broken", article(3, host="unknown.example"), '{"id": 9}') == (2, 3)
    assert loaded(spark, store, places, article(2, "<p>Ny tekst om en mølle ved en bæk i skoven.</p>"), article(4)) == (2, 0)
    rows = {r["id"]: r for r in store.articles().collect()}
    assert set(rows) == {1, 2, 4} and "mølle" in rows[2]["xhtml_md"] and rows[1]["permalink"] == "art_1" and rows[1]["created_at"] == datetime(1970, 1, 1)
    store.create_index("idx", strategy="characters", size=60, overlap=10)
    with pytest.raises(ValueError):
        store.create_index("idx")
    store.create_index("idx", strategy="characters", size=60, overlap=10, force=True)
    first = store.refresh_index("idx")
    assert first["created"] == store.index("idx").count() > 3 and first["deleted"] == 0 and first["errors"] == 0
    assert store.refresh_index("idx") == {"created": 0, "deleted": 0, "errors": 0}
    ids = [r[0] for r in store.index("idx").select("id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    own = store.index("idx").where("source_article_id = 4").count()
    assert store.delete_articles(spark.createDataFrame([(4,), (77,)], "i long")) == 1
    assert store.index("idx").where("source_article_id = 4").count() == 0 and own > 0
    assert store.delete_articles(spark.createDataFrame([], "i long")) == 0
    store.update_index_row("idx", chunk_size=80)
    assert store.index_row("idx")["chunk_size"] == 80 and store.index_row("none") is None
    with pytest.raises(ValueError):
        store.update_index_row("idx", no_such=1)
    held = store.index("idx").where("source_article_id = 1").count()
    assert store.remove_article("idx", 1) == held and store.remove_article("idx", 1) == 0


def test_added_chunks(spark, tmp_path, places):
    store = Store(spark, str(tmp_path / "s"))
    store.create_index("idx")
    v = [0.5] * 4
    rows = [(1, 0, "a", v), (1, 1, " ", v), (1, 2, "c", [1.0]), (1, 3, None, v), (None, 0, "x", v), (2, 0, "b", v), (2, 0, "b", v)]
    df = spark.createDataFrame(rows, "source_article_id long, chunk_sequence_id int, chunk_text string, embedding array<float>")
    assert store.add_chunks("idx", df) == {"created": 3, "errors": 4}
    before = {(r["source_article_id"], r["chunk_sequence_id"]): r["id"] for r in store.index("idx").collect()}
    store.add_chunks("idx", spark.createDataFrame([(2, 0, "new", v), (3, 0, "z", v)], df.schema))
    after = {(r["source_article_id"], r["chunk_sequence_id"]): (r["id"], r["chunk_text"]) for r in store.index("idx").collect()}
    assert after[2, 0] == (before[2, 0], "new") and after[3, 0][0] == 3 and len(after) == 3


def test_engine_searches(spark, tmp_path, places):
    store = Store(spark, str(tmp_path / "s"))
    loaded(spark, store, places, article(1), article(2, "<p>Skoven har en mølle og en bæk.</p>"), article(3, "<p>Kirken ved havet.</p>"))
    store.create_index("idx", strategy="characters", size=400, overlap=10)
    store.refresh_index("idx")
    engine = Engine(spark, store, places)
    assert engine.info()["tables"] == ["articles", "idx"] and engine.index("idx")["embedding_model"] == "mock_model"
    hits = engine.articles("havet kirke").collect()
    assert {r["id"] for r in hits} == {1, 3} and hits[0]["total"] == 2 and hits[0]["url"].startswith("https://a.example/art_")
    assert [r["id"] for r in engine.articles(ids=[3, 1, 1]).collect()] == [1, 3]
    assert engine.articles("og").count() == 0
    with pytest.raises(ValueError):
        engine.articles()
    with pytest.raises(ValueError):
        engine.articles("x", limit=101)
    with pytest.raises(NotFound):
        engine.vector_search("none", "x")
    with pytest.raises(ValueError):
        engine.vector_search("idx", " ")
    near = engine.vector_search_batch("idx", [("Kirken ved havet", "query"), ("mølle", "query")], 2).collect()
    assert [(r["query"], r["rank"]) for r in near] == [(1, 1), (1, 2), (2, 1), (2, 2)] and near[0]["title"].startswith("Artikel")
    assert {r["query"] for r in engine.text_search_batch("idx", ["mølle", " ", "findes ikke"]).collect()} == {1}
    fused = engine.hybrid_search("idx", ["mølle ved bæk"], ["mølle"], "entity", 2).collect()
    assert fused[0]["score_kind"] == "fused" and len(fused) == 2
    assert engine.hybrid_search("idx", [], ["mølle"]).first()["score_kind"] == "text"
    assert engine.hyde_search("idx", "mølle", lambda q: f"QUERYTYPE: ENTITY\nPASSAGE: {q} i skoven").count() > 0


def test_request_parsing():
    assert parse_ids(["1,2", "[3, 4]"]) == [1, 2, 3, 4] and parse_ids("[]") is None and parse_ids(None) is None
    assert parse_encyclopedia_ids("14, 15") == [14, 15] and parse_encyclopedia_ids("") is None
    for bad in ("x", "1,99"):
        with pytest.raises(ValueError):
            parse_encyclopedia_ids(bad, {1, 2})


def test_sync(spark, tmp_path, places):
    store = Store(spark, str(tmp_path / "s"))
    loaded(spark, store, places, article(1), article(2), article(3))
    urls = lambda *items: "".join(f"<url><loc>https://a.example/art_{i}</loc><lastmod>{t}</lastmod></url>" for i, t in items)
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + urls((1, "2024-01-01T01:00:00+01:00"), (2, "2024-02-01T00:00:00Z"), (2, "2023-01-01T00:00:00Z"), (5, "2024-01-01")) + "<url><loc>https://a.example/.temaside/x</loc><lastmod>2024-01-01</lastmod></url></urlset>"
    pages = {"https://a.example/sitemap.xml": xml, "https://a.example/art_2.json": article(2, changed="2024-02-01T00:00:00Z"), "https://a.example/art_5.json": article(5)}

    def fetch(url):
        if url not in pages:
            raise ValueError(url)
        return pages[url]

    engine = Engine(spark, store, places)
    plan = {r["permalink"]: r["status"] for r in engine.plan_sync({1: "https://a.example/sitemap.xml"}, fetch).collect()}
    assert plan == {"art_1": "unchanged", "art_2": "modified", "art_3": "deleted", "art_5": "new"}
    guarded = engine.plan_sync({1: "https://a.example/sitemap.xml", 2: "https://b.example/missing.xml"}, fetch)
    assert guarded.where("status = 'deleted'").count() == 0
    dry = engine.sync({1: "https://a.example/sitemap.xml"}, fetch, dry_run=True)
    assert dry["removed"] == 1 and {r[0] for r in store.articles().select("id").collect()} == {1, 2, 3}
    done = engine.sync({1: "https://a.example/sitemap.xml"}, fetch)
    assert (done["written"], done["failed"], done["removed"]) == (2, 0, 1)
    assert {r[0] for r in store.articles().select("id").collect()} == {1, 2, 5}


def test_malformed_sitemap(spark):
    df = spark.createDataFrame([("<urlset><url>",)], "x string")
    with pytest.raises(Exception, match="malformed"):
        sitemap.parse_sitemaps(df, "x").collect()
    empty = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"></urlset>'
    assert sitemap.parse_sitemaps(spark.createDataFrame([(empty,)], "x string"), "x").count() == 0


def test_retries():
    calls, pauses = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise sitemap.TooManyRequests
        return "ok"

    assert sitemap.with_retries(flaky, 7, 5, sitemap.TooManyRequests, pauses.append)("u") == "ok" and pauses == [5, 10]
    assert sitemap.with_retries(lambda u: 1 / 0, 3, 1, OSError, pauses.append)("u") is None


def test_index_plan(spark):
    t = datetime(2024, 1, 1)
    source = spark.createDataFrame([(1, t), (2, datetime(2025, 1, 1)), (3, None), (4, t)], "id long, changed_at timestamp")
    index = spark.createDataFrame([(1, t), (2, t), (2, datetime(2026, 1, 1)), (3, t), (9, t)], "source_article_id long, last_updated timestamp")
    assert {r["id"]: r["action"] for r in sync.index_plan(source, index).collect()} == {1: "skip", 2: "update", 3: "skip", 4: "create", 9: "delete"}
    assert {r["id"] for r in sync.due_for_dump(source, index).collect()} == {2, 4}
    observed, seen = sync.observed_counts(source, missing=source["changed_at"].isNull())
    assert observed.count() == 4 and seen.get == {"missing": 1}


def test_interchange(spark, tmp_path, places):
    store = Store(spark, str(tmp_path / "s"))
    loaded(spark, store, places, article(2), article(1))
    store.create_index("idx", strategy="characters", size=400, overlap=10)
    full = str(tmp_path / "full")
    assert cli.dump_articles(store, full) == {"total_articles": 2, "dumped": 2}
    assert jsonl.header(spark, full)["mode"] == "full"
    lines = [line for part in sorted(Path(full).glob("part-*")) for line in part.read_text().splitlines()]
    assert [json.loads(line).get("id") for line in lines] == [None, 1, 2]
    back = jsonl.read_articles(spark, full)
    assert {r["id"] for r in back.where("valid").collect()} == {1, 2}
    vectors = str(tmp_path / "vectors")
    cli.generate_embeddings(spark, full, vectors, "mock_model", "characters", 400, 10)
    assert cli.import_embeddings(store, vectors, "idx") == {"created": 2, "errors": 0}
    assert cli.dump_articles(store, str(tmp_path / "inc"), "incremental", "idx")["dumped"] == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"_metadata": {"dimensions": 4}}\n{"article_id": "1", "chunk_idx": 0, "chunk_text": "x", "embedding": [1, 2]}\n{broken\n\n')
    assert cli.import_embeddings(store, str(bad), "idx") == {"created": 0, "errors": 2}
    bare = tmp_path / "bare.jsonl"
    bare.write_text('{"article_id": "1"}\n')
    with pytest.raises(ValueError):
        jsonl.read_embeddings(spark, str(bare), 4)


def test_sqlite(spark, tmp_path):
    path = tmp_path / "v.db"
    with sqlite3.connect(path) as db:
        db.execute("create table v (article_id integer, chunk_id integer, text text, embedding blob)")
        db.executemany("insert into v values (?, ?, ?, ?)", [(i, 0, f"t{i}", np.array([i, 1], "<f4").tobytes()) for i in range(25)])
        db.execute("create table articles (id integer, headword text, xhtml_md text, permalink text, encyclopedia_id integer, changed_at text, created_at text)")
        db.execute("insert into articles values (1, 'h', 'x', 'p', 2, '0000-00-00 00:00:00', '2024-01-01 10:00:00')")
        db.execute("create table leer (id integer)")
    rows = sqlite.read_vectors(spark, str(path), "v").orderBy("source_article_id").collect()
    assert [r["embedding"] for r in rows] == [[float(i), 1.0] for i in range(25)]
    loaded_rows = sqlite.read_articles(spark, str(path))
    assert loaded_rows.first()["changed_at"] is None and loaded_rows.first()["created_at"] == datetime(2024, 1, 1, 10)
    sqlite.check_load(1, loaded_rows)
    sqlite.check_search(loaded_rows)
    sqlite.check_search(loaded_rows.where("false"))
    with pytest.raises(ValueError):
        sqlite.check_search(loaded_rows.withColumn("xhtml_md", F.lit("og ... !")))
    with pytest.raises(ValueError):
        sqlite.check_load(2, loaded_rows)
    assert sqlite.read_table(spark, str(path), "leer", "id bigint").count() == 0
    out = str(tmp_path / "out")
    cli.export_sqlite(spark, str(path), "v", out)
    assert jsonl.read_embeddings(spark, out, 2).where("valid").count() == 25


def test_providers(spark):
    class Flaky:
        calls = 0

        def embed(self, texts):
            Flaky.calls += 1
            if Flaky.calls == 1:
                raise TimeoutError
            return HashProvider(4).embed(texts)

    texts = [f"ord {i}" for i in range(10)]
    assert RetryingProvider(Flaky(), batch=3, sleep=lambda s: None).embed(texts) == HashProvider(4).embed(texts)
    now, slept = [0.0], []
    limiter = WindowLimiter(2, 100, 60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for tokens in (50, 50, 10):
        limiter.wait(tokens)
    assert slept == [60.0]
    with pytest.raises(ValueError):
        dimensions("none")
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5000, 2000, 2000, 9000, None, 1])], "i long, n long").coalesce(1)
    got = request_batches(df, "i", "n", 8000).orderBy("i").collect()
    assert [r["batch"] for r in got] == [0, 0, 1, 2, 2, 3] and got[3]["tokens"] == 8000


def test_streams(spark, tmp_path, places):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(article(1) + "\n" + article(2) + "\n")
    store = Store(spark, str(tmp_path / "s"))
    lines = spark.readStream.text(str(folder))
    for _ in range(2):
        upsert_stream(lines, store, places, str(tmp_path / "cp")).awaitTermination()
    assert store.articles().count() == 2 and store.version("articles") == 1
    events = spark.createDataFrame([(datetime(2024, 1, 1, 1, 5), "a"), (datetime(2024, 1, 1, 1, 50), "a")], "ts timestamp_ntz, kind string")
    assert windowed_counts(events, "ts", ["kind"]).first()["n"] == 2


def test_a_change_leaves_untouched_buckets_alone(spark, tmp_path, places):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    loaded(spark, store, places, *[article(i) for i in range(1, 41)])
    store.create_index("idx", strategy="characters", size=60, overlap=10)
    store.refresh_index("idx")
    before = store._log("articles").payload(1)["files"]
    assert len(before) > 4
    loaded(spark, store, places, article(3, "<p>Ny tekst.</p>"))
    after = store._log("articles").payload(2)["files"]
    assert sum(before[k] != after[k] for k in before) == 1 and store.articles().count() == 40
    chunks = store._log("idx").last()[1]["files"]
    assert store.refresh_index("idx")["deleted"] == 0 and store._log("idx").last()[1]["files"] == chunks
    assert store.remove_article("idx", 7) > 0
    now = store._log("idx").last()[1]["files"]
    assert sum(chunks[k] != now.get(k) for k in chunks) == 1
    with pytest.raises(RuntimeError):
        store.write("articles", ARTICLES, change=lambda old: (loaded(spark, store, places, article(3)), old)[1], touched=spark.createDataFrame([(3,)], "id long"))


def test_vacuum(spark, tmp_path, places):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    for n in range(4):
        loaded(spark, store, places, article(n), article(7, f"<p>Tekst {n}.</p>"))
    before = sorted(r["id"] for r in store.articles().collect())
    (tmp_path / "s" / "articles" / "v000005_other").mkdir()
    assert store.vacuum("articles", keep=1) > 0 and store.vacuum("articles", keep=1) == 0
    assert sorted(r["id"] for r in store.articles().collect()) == before and (tmp_path / "s" / "articles" / "v000005_other").exists()


def test_deleting_survives_a_crash_between_the_tables(spark, tmp_path, places, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    loaded(spark, store, places, article(1), article(2))
    store.create_index("idx", strategy="characters", size=60, overlap=10)
    store.refresh_index("idx")
    ids = spark.createDataFrame([(1,)], "i long")
    write = Store.write

    def dying(self, name, *a, **k):
        if name == "articles":
            raise OSError("lost")
        return write(self, name, *a, **k)

    monkeypatch.setattr(Store, "write", dying)
    with pytest.raises(OSError):
        store.delete_articles(ids)
    assert store.index("idx").where("source_article_id = 1").count() == 0
    monkeypatch.undo()
    assert store.delete_articles(ids) == 1 and store.articles().count() == 1
    # chunks whose article is gone already go as well
    v = spark.createDataFrame([(1, 0, "a", [0.5] * 4)], "source_article_id long, chunk_sequence_id int, chunk_text string, embedding array<float>")
    store.add_chunks("idx", v)
    assert store.delete_articles(ids) == 0 and store.index("idx").where("source_article_id = 1").count() == 0


def test_sync_command_fetches_each_page_once(spark, tmp_path, places):
    sites = str(tmp_path / "sites")
    places.where("encyclopedia_id = 1").write.parquet(sites)
    log = tmp_path / "log"
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/art_1</loc><lastmod>2024-01-01</lastmod></url></urlset>'
    page = article(1)

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        return xml if url.endswith(".xml") else page

    root = ["--root", str(tmp_path / "s"), "--encyclopedias", sites]
    cli.main(["create-index", *root, "--index", "idx", "--strategy", "characters"])
    dry = cli.main(["sync", *root, "--dry-run"], fetch)
    assert (dry["new"], dry["fetched"], dry["written"], dry["indexes"]) == (1, 1, 1, {})
    log.unlink()
    done = cli.main(["sync", *root, "--encyclopedia-ids", "1"], fetch)
    assert done["written"] == 1 and done["indexes"]["idx"]["created"] == 1
    assert sorted(log.read_text().split()) == ["https://a.example/art_1.json", "https://a.example/sitemap.xml"]
    assert cli.main(["sync", *root, "--skip-scraping", "--index", "other"], fetch) == {"indexes": {}}
    with pytest.raises(ValueError):
        cli.main(["sync", *root, "--encyclopedia-ids", "9"], fetch)
    assert "index idx: 1 created" in sync_summary(done) and "deletions skipped: 1 of 2" in sync_summary({"sitemaps": 1, "sitemaps_wanted": 2, "deletions_skipped": True, "indexes": {"x": {"error": "no"}}}, True)
