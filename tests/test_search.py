import random

import numpy as np
import pytest

from sparkcorpus.engine import Engine
from sparkcorpus.operators import cells, fulltext, fusion, nearest
from sparkcorpus.operators.store import CHUNKS, Store


def test_fulltext_against_brute_force(spark):
    rng = random.Random(1)
    words = ["hav", "by", "kirke", "og", "Ø"]
    docs = [(i, None if i % 11 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(8)))) for i in range(60)]
    asked = [(1, "og"), (2, "hav by"), (3, "ø KIRKE og"), (4, ""), (5, "findes ikke"), (6, None), (7, "hav hav")]
    found = fulltext.matches(spark.createDataFrame(docs, "id long, text string"), "id", "text", spark.createDataFrame(asked, "q long, t string"), "q", "t")
    want = set()
    for q, t in asked:
        lex = set((t or "").lower().split())
        for i, text in docs:
            own = (text or "").lower().split()
            if lex and lex <= set(own):
                want.add((q, i, round(sum(own.count(x) / (own.count(x) + 1) for x in lex) / len(lex), 6)))
    assert {(r["query"], r["id"], r["score"]) for r in found.collect()} == want
    top = fulltext.best(found, 3).collect()
    assert all(r["rank"] <= 3 for r in top) and {r["query"]: r["total"] for r in top}[1] == sum(q == 1 for q, _, _ in want)
    ids = spark.createDataFrame([(2,), (2,)], "i long")
    assert fulltext.search(spark.createDataFrame(docs, "id long, text string"), "id", "text", spark.createDataFrame(asked, "q long, t string"), "q", "t", ids=ids).where("id <> 2").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 8), (92, [1.0] * 7), (93, [1.0, None] * 4)]
    index = spark.createDataFrame(rows, "id long, v array<double>")
    got = nearest.nearest(index, "id", "v", index.where("id in (3, 90, 91, 92)"), "id", "v", 8, 5).orderBy("rank").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [r["id"] for r in got] == np.argsort(np.round(1 - unit @ unit[3], 6), kind="stable")[:5].tolist()
    assert nearest.nearest(index, "id", "v", index.where("id > 100"), "id", "v", 8, 5).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(60, 8))
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(nearest.nearest(index, "id", "v", index, "id", "v", 8, 3))
    monkeypatch.setattr(nearest, "QUERY_BYTES", 8 * 8 * 20)
    assert key(nearest.nearest(index, "id", "v", index, "id", "v", 8, 3)) == whole and len(whole) == 180


def test_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 8))
    x = centres[rng.integers(0, 10, 600)] + rng.normal(size=(600, 8)) * 0.3
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(900, None, ""), (901, [0.0] * 8, ""), (902, [1.0] * 7, ""), (903, [1.0, None] * 4, "")]
    df = spark.createDataFrame(rows, "id long, v array<float>, cell string")
    path = str(tmp_path / "cells")
    made = cells.build(df, "id", "v", 8, path)
    asked = df.where("id % 100 = 0 or id > 899")
    exact = {(r["query"], r["id"], r["distance"], r["rank"]) for r in nearest.nearest(df, "id", "v", asked, "id", "v", 8, 5).collect()}
    get = lambda n: {(r["query"], r["id"], r["distance"], r["rank"]) for r in cells.search(spark, path, asked, "id", "v", 8, 5, n).collect()}
    assert made == 12 and get(made) == exact and len(get(4) & exact) > 0.9 * len(exact)
    empty = str(tmp_path / "empty")
    assert cells.build(df.where("false"), "id", "v", 8, empty) == 1 and cells.search(spark, empty, asked, "id", "v", 8).count() == 0


def test_an_index_searches_its_cells_until_it_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create_index("idx")
    v = [[1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    chunk = lambda rows: spark.createDataFrame(rows, "source_article_id long, chunk_sequence_id int, chunk_text string, embedding array<float>")
    store.add_chunks("idx", chunk([(i, 0, f"t{i}", x) for i, x in enumerate(v)]))
    engine = Engine(spark, store, spark.createDataFrame([], "encyclopedia_id int, host string, url_base string"), make_provider=_Fixed)
    hits = lambda **k: [(r["source_article_id"], r["distance"]) for r in engine.vector_search_batch("idx", [("q", "query")], 2, **k).collect()]
    exact = hits()
    assert store.cells("idx") is None and store.build_cells("idx") == 1 and store.cells("idx")
    assert hits() == exact == hits(probes=None) and exact[0] == (0, 0.0) and engine.tables() == ["idx"]
    store.add_chunks("idx", chunk([(7, 0, "new", [1.0, 0.0, 0.0, 0.0])]))
    assert store.cells("idx") is None and {h[0] for h in hits()} == {0, 7}
    assert store.index("idx").columns == [c.split(" ")[0] for c in CHUNKS.split(", ")]


class _Fixed:
    def __init__(self, model):
        pass

    def embed(self, texts):
        return [[1.0, 0.0, 0.0, 0.0] for _ in texts]


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query long, id long, rank int") for ids in ([5, 6, 7], [7, 5])]
    got = [(r["id"], r["score"]) for r in fusion.fuse(lists, 10).orderBy("rank").collect()]
    assert got == [(5, round(1 / 61 + 1 / 62, 9)), (7, round(1 / 63 + 1 / 61, 9)), (6, round(1 / 62, 9))]
    reference = {r["id"]: r["score"] for r in fusion.fuse(lists, 10, mode="reference").collect()}
    assert reference == {5: round(1 / 61 + 1 / 62, 9), 7: round(1 / 61 + 1 / 62, 9), 6: round(1 / 61, 9)}
    assert fusion.rrf_score([1, 2], 60, [1.0, 3.0], True) == pytest.approx((1 / 61 + 3 / 62) / 4)
    with pytest.raises(ValueError):
        fusion.rrf_score([1], weights=[1.0, 2.0])
    with pytest.raises(ValueError):
        fusion.fuse(lists, 10, weights=[1.0])
