import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkcorpus.operators import commits
from sparkcorpus.operators.commits import CommitLog
from sparkcorpus.operators.intervals import IntervalLedger, merge_intervals, ranges_of, ranges_of_files, subtract_intervals

SCHEMA = "k int, lo long, hi long"


def numbers(rows):
    out = {}
    for k, lo, hi in rows:
        if lo is not None and hi is not None:
            out.setdefault(k, set()).update(range(lo, hi + 1))
    return out


def as_ranges(values):
    out = []
    for k, own in values.items():
        for n in sorted(own):
            if out and out[-1][0] == k and out[-1][2] == n - 1:
                out[-1][2] = n
            else:
                out.append([k, n, n])
    return {tuple(r) for r in out}


interval = st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(-30, 30)), st.one_of(st.none(), st.integers(-30, 30)))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(interval, max_size=12), st.lists(interval, max_size=12), st.sampled_from([None, 7]))
def test_subtract_and_merge(spark, available, processed, width):
    a, p = spark.createDataFrame(available, SCHEMA), spark.createDataFrame(processed, SCHEMA)
    have, done = numbers(available), numbers(processed)
    want = as_ranges({k: v - done.get(k, set()) for k, v in have.items()})
    got = [tuple(r) for r in subtract_intervals(a, p, ["k"], width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in merge_intervals(a, ["k"], width=width).collect()} == as_ranges(have)


def test_hot_key_in_buckets(spark):
    rows = [(1, n, n) for n in range(0, 3000, 2)] + [(1, 5000, 9000)]
    got = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, SCHEMA), ["k"], width=100).collect()}
    assert got == {tuple(r) for r in rows}
    df = spark.range(1, 2001).selectExpr("cast(id as long) as n")
    assert [tuple(r) for r in ranges_of(df, "n", width=64).collect()] == [(1, 2000)]


def test_ledger_survives_failures_and_late_rows(spark, tmp_path):
    ledger = IntervalLedger(spark, str(tmp_path / "ledger"), width=16)
    rows = lambda *n: spark.createDataFrame([(i, f"v{i}") for i in n], "seq long, v string")
    assert ledger.run(rows(1, 2, 3, 7), "seq", lambda d: d) == 1

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(rows(1, 2, 3, 7, 8), "seq", broken)
    assert ledger.version() == 1
    # 4 was committed late, between numbers that are done
    assert ledger.run(rows(1, 2, 3, 4, 7, 8, 40), "seq", lambda d: d) == 2
    assert sorted(r[0] for r in ledger.outputs().select("seq").collect()) == [1, 2, 3, 4, 7, 8, 40]
    assert {tuple(r) for r in ledger.processed().collect()} == {(1, 4), (7, 8), (40, 40)}
    assert ledger.pending(rows(*range(1, 9)), "seq").count() == 2
    assert ledger.run(spark.createDataFrame([], "seq long, v string"), "seq", lambda d: d) == 3


def test_a_second_writer_cannot_publish_the_same_version(spark, tmp_path):
    ledger = IntervalLedger(spark, str(tmp_path / "ledger"), width=16)
    source = spark.createDataFrame([(random.randrange(100), "x") for _ in range(20)], "seq long, v string")

    def slow(df):
        IntervalLedger(spark, str(tmp_path / "ledger"), width=16).run(source, "seq", lambda d: d)
        return df

    assert ledger.run(source, "seq", slow) is None
    assert ledger.version() == 1


def test_ranges_come_from_footers_where_files_are_dense(spark, tmp_path):
    path = str(tmp_path / "t")
    for numbers in (range(0, 100), range(100, 150), [*range(150, 160), 170, 171], [None, 200], [300]):
        spark.createDataFrame([(n, "x") for n in numbers], "seq long, v string").coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    assert sorted(tuple(r) for r in ranges_of_files(df, "seq").collect()) == [(0, 159), (170, 171), (200, 200), (300, 300)]
    ledger = IntervalLedger(spark, str(tmp_path / "ledger"), width=16)
    assert ledger.run(df.where("seq < 120"), "seq", lambda d: d, available=spark.createDataFrame([(0, 119)], "lo long, hi long")) == 1
    assert sorted(r[0] for r in ledger.pending(df, "seq", available=ranges_of_files(df, "seq")).select("seq").collect()) == [*range(120, 160), 170, 171, 200, 300]
    assert ranges_of_files(spark.createDataFrame([(1,), (2,)], "seq long"), "seq").collect()[0][:] == (1, 2)


def test_the_lock_of_a_dead_writer_is_taken_over(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.last() == (0, None) and log.publish(0, {"a": 1}) == 1
    log.fs.createNewFile(log.path("commits/2.lock"))
    assert log.publish(1, {"a": 2}) is None and log.version() == 1
    monkeypatch.setattr(commits, "STALE", -1)
    assert log.publish(1, {"a": 2}) == 2 and log.last() == (2, {"a": 2})
    assert log.publish(1, {"a": 3}) is None and log.last() == (2, {"a": 2})
