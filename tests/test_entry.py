import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from sparkcorpus.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the data are not here")
#: A part of the queries on the smallest data; every one runs against its SQL in the round's check.
CHECKED = ["url_parts", "article_urls", "fts_batch", "fts_lists", "vector_topk", "rrf_reference", "chunk_chars", "chunk_words", "chunk_sections", "sync_categorize", "index_diff", "incremental_dump", "sitemap_parse", "upsert_articles", "precomputed_stats", "cleaned_markdown", "reconstructed", "full_dump", "embedding_lines", "hyde_parse", "index_refresh", "engine_text_search", "engine_articles", "vector_topk_cells", "embed_counts", "request_totals", "p2_ledger"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {Path(f).stem} as select * from read_parquet('{f}')")
    got = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(plain, r))
    columns = sorted(got.columns)
    assert sorted(map(repr, map(key, got.select(*columns).collect()))) == sorted(map(repr, map(key, want.select(*[f'"{c}"' for c in columns]).fetchall())))


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_names_need_no_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=Path(entry_point.__file__).parent, capture_output=True, text=True, timeout=120)
    assert int(done.stdout) > 50


def test_plans(spark):
    plan = registry.queries()["vector_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "ReadSchema: struct<vec_id" in plan
    plan = registry.queries()["article_metadata_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "xhtml" not in plan
