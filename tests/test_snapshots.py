import random

from sparkcorpus.operators.snapshots import changes_between, latest_version

SCHEMA = "enc int, link string, snap int, t long, snapshot_no string"


def expected(rows):
    snaps = {}
    for enc, link, snap, t, _ in rows:
        held = snaps.setdefault(snap, {})
        key = (enc, link)
        if key not in held or (t is not None and (held[key] is None or t > held[key])):
            held[key] = t
    out, numbers = set(), sorted(snaps)
    for a, b in zip(numbers, numbers[1:]):
        for k in snaps[a].keys() | snaps[b].keys():
            if k not in snaps[a]:
                out.add((*k, b, "added"))
            elif k not in snaps[b]:
                out.add((*k, b, "removed"))
            elif snaps[a][k] != snaps[b][k]:
                out.add((*k, b, "changed"))
    return out


def found(spark, rows):
    df = latest_version(spark.createDataFrame(rows, SCHEMA), ["enc", "link", "snap"], "t", [])
    got = [tuple(r) for r in changes_between(df, ["enc", "link"], "snap", ["t"]).select("enc", "link", "snap", "change_type").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", "", None, "å"]), rng.choice([3, 4, 7, 11]), rng.choice([None, 1, 2]), "clash") for _ in range(150)]
    assert found(spark, rows) == expected(rows)


def test_many_deliveries_in_any_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), s, rng.choice([None, 1, 2]), "clash") for s in range(40, 0, -1) for _ in range(3)]
    assert found(spark, rows) == expected(rows)
    df = latest_version(spark.createDataFrame(rows, SCHEMA), ["enc", "link", "snap"], "t", [])
    numbers = spark.createDataFrame([(n, "clash") for n in [*range(1, 41), None, 7]], "snap int, enc string")
    got = changes_between(df, ["enc", "link"], "snap", ["t"], numbers).select("enc", "link", "snap", "change_type").collect()
    assert {tuple(r) for r in got} == expected(rows)


def test_hot_record_and_small_tables(spark):
    hot = [(1, "a", s, t, "") for s in (1, 2) for t in [None, 5] * 200] + [(1, "b", 2, None, "")]
    assert found(spark, hot) == {(1, "b", 2, "added")}
    assert found(spark, []) == set()
    assert found(spark, [(1, "a", 9, 1, "")]) == set()
    assert found(spark, [(1, "a", 1, None, ""), (1, "a", 2, None, ""), (1, "a", 3, 0, "")]) == {(1, "a", 3, "changed")}
