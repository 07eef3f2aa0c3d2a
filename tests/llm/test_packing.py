import random

from sparkcorpus.llm import packing

SCHEMA = "doc long, n long, container_id string"


def packed(spark, rows, capacity=100):
    return packing.pack(spark.createDataFrame(rows, SCHEMA), "doc", "n", capacity).collect()


def offline(rows, capacity):
    """Containers of first fit by decreasing size, over the parts that must be placed."""
    parts = sorted((p for _, n, _ in rows for p in [capacity] * (n // capacity) + [n % capacity] if p), reverse=True)
    room = []
    for p in parts:
        for k, r in enumerate(room):
            if r >= p:
                room[k] -= p
                break
        else:
            room.append(capacity - p)
    return len(room)


def test_whole_and_tight(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([3, 17, 40, 55, 80, 100, 230, rng.randrange(1, 130)]), "") for i in range(3000)]
    got = packed(spark, rows)
    total, size = {}, {}
    for r in got:
        total[r["doc"]] = total.get(r["doc"], 0) + r["piece_size"]
        size[r["container_id"]] = size.get(r["container_id"], 0) + r["piece_size"]
    assert total == {d: n for d, n, _ in rows}
    assert max(size.values()) <= 100
    assert {r["doc"] for r in got if r["piece_no"] > 0} == {d for d, n, _ in rows if n > 100}
    assert len(size) <= 1.06 * offline(rows, 100)
    assert sorted(map(tuple, got)) == sorted(map(tuple, packed(spark, rows[::-1])))


def test_edges(spark):
    got = packed(spark, [(1, None, None), (2, 0, None), (3, 100, None), (4, 201, None), (5, 7, None), (5, 7, None)])
    by = {}
    for r in got:
        by.setdefault(r["doc"], []).append(r)
    assert [r["container_id"] for r in by[1] + by[2]] == [None, None]
    assert [r["piece_size"] for r in sorted(by[4], key=lambda r: r["piece_no"])] == [100, 100, 1] and len(by[5]) == 2
    assert packed(spark, []) == []


def test_shares_split_many_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 5)
    got = packed(spark, [(i, 10, "") for i in range(400)])
    assert len({r["container_id"] >> 40 for r in got}) > 3 and len({r["container_id"] for r in got}) <= 48


def test_rule():
    packer = packing.SumOfSquares(10)
    assert [packer.place(n) for n in (6, 4, 6, 3, 1)] == [0, 0, 1, 1, 1]
