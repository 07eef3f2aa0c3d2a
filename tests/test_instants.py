import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from sparkcorpus.operators.instants import CANDIDATES, estimate_zone, normalise_instants
from sparkcorpus.functions.timestamps import parse_instants

UTC = timezone.utc


def us(*a, tz=UTC):
    return int(datetime(*a, tzinfo=tz).timestamp()) * 1_000_000


CASES = {
    "2020-10-22T11:30:49.579Z": us(2020, 10, 22, 11, 30, 49) + 579_000,
    "2020-10-22T11:30:49.579": us(2020, 10, 22, 9, 30, 49) + 579_000,
    " 2013-03-19T05:02:00+01:00  ": us(2013, 3, 19, 4, 2),
    "2013-03-19t05:02:00z": us(2013, 3, 19, 5, 2),
    "2012-03-24T02:42:00+0100": us(2012, 3, 24, 1, 42),
    "2012-06-05T20:16:12+02": us(2012, 6, 5, 18, 16, 12),
    "2012-06-08T19:19:23+02:00[Europe/Copenhagen]": us(2012, 6, 8, 17, 19, 23),
    "2012-01-23T03:09:33.216528872+01:00": us(2012, 1, 23, 2, 9, 33) + 216_528,
    "2012-07-05T15:20:11,5Z": us(2012, 7, 5, 15, 20, 11) + 500_000,
    "20120507T093100Z": us(2012, 5, 7, 9, 31),
    "07-04-2012 21:15:00": us(2012, 4, 7, 19, 15),
    "03.07.2012 11.41.24": us(2012, 7, 3, 9, 41, 24),
    "23.03.2026": us(2026, 3, 22, 23),
    "2020-05-04": us(2020, 5, 3, 22),
    "2012-05-15 03:54": us(2012, 5, 15, 1, 54),
    "2013-07-23 20:29:51 CEST": us(2013, 7, 23, 18, 29, 51),
    "2012-01-11 11:28:15 CET": us(2012, 1, 11, 10, 28, 15),
    "2012-06-24 22:00:00 GMT": us(2012, 6, 24, 22),
    "Wed, 04 Jan 2017 05:06:00 +0100": us(2017, 1, 4, 4, 6),
    "4. september 2012 kl. 13.42": us(2012, 9, 4, 11, 42),
    "25. maj 2015 kl. 21.06": us(2015, 5, 25, 19, 6),
    "1353096638": 1353096638_000_000,
    "1333026001000": 1333026001_000_000,
    "2023-10-18T09:50:33+05:45": us(2023, 10, 18, 4, 5, 33),
    # a repeated hour means its first pass, a skipped hour the offset before the change
    "2022-10-30T02:30:00": us(2022, 10, 30, 0, 30),
    "2022-03-27T02:30:00": us(2022, 3, 27, 1, 30),
    "2024-02-29T10:00:00Z": us(2024, 2, 29, 10),
}
NONE = ["", " ", None, "ukendt", "n/a", "i går", "0000-00-00T00:00:00", "2021-02-30T10:00:00Z", "2019-13-01T08:00:00+01:00", "2023-02-29", "2020-01-01T25:00:00", "x" * 100_000, "31-04-2020 10:00:00"]


def test_notations(spark):
    rows = [(k, k) for k in CASES] + [(f"none{i}", v) for i, v in enumerate(NONE)]
    df = spark.createDataFrame(rows, "name string, v string").withColumn("w", F.lit("clash"))
    got = {r["name"]: r["out"] for r in normalise_instants(df, "v", "out", ["name"], "w", "Europe/Copenhagen").collect()}
    assert {k: got[k] for k in CASES} == CASES
    assert all(got[f"none{i}"] is None for i in range(len(NONE)))


def _parsed(spark, rows):
    df = spark.createDataFrame(rows, "rec string, v string, at timestamp")
    return parse_instants(df, "v", "wall", "off")


def test_zone_is_estimated_from_deliveries(spark):
    rng, zone, rows = random.Random(3), ZoneInfo("America/New_York"), []
    for i in range(60):
        t = datetime.fromtimestamp(1_500_000_000 + rng.randrange(10**8), UTC)
        rows.append((f"r{i}", t.strftime("%Y-%m-%dT%H:%M:%SZ"), datetime(2026, 1, 1)))
        rows.append((f"r{i}", t.astimezone(zone).strftime("%Y-%m-%dT%H:%M:%S"), datetime(2026, 2, 1)))
    found, counts = estimate_zone(_parsed(spark, rows), "wall", "off", ["rec"], "at")
    assert found == "America/New_York" and counts[found] == 0 and counts["UTC"] >= 60


def test_values_later_than_their_arrival_are_violations(spark):
    rows = [(f"q{i}", "2020-06-01T12:00:00", datetime(2020, 6, 1, 11)) for i in range(10)]
    found, counts = estimate_zone(_parsed(spark, rows), "wall", "off", ["rec"], "at")
    assert counts["UTC"] == 10 and counts["Europe/Copenhagen"] == 0 and found == "Europe/Copenhagen"


def test_declared_zone_stays_without_evidence(spark):
    assert estimate_zone(_parsed(spark, []), "wall", "off", ["rec"], "at") == (CANDIDATES[0], dict.fromkeys(CANDIDATES, 0))
    assert estimate_zone(_parsed(spark, [(None, None, None), (None, "2020-01-01T00:00:00", None)]), "wall", "off", ["rec"], "at")[0] == CANDIDATES[0]


def test_a_few_strays_do_not_change_the_zone(spark):
    """Values dated half an hour after their receipt are noise beside thousands that fit."""
    rows = [(f"g{i}", f"2020-06-01T{10 + i % 10:02d}:{i % 60:02d}:00", datetime(2020, 6, 1, 10 + i % 10, i % 60)) for i in range(5_000)]
    rows += [(f"s{i}", "2020-06-01T12:30:00", datetime(2020, 6, 1, 10)) for i in range(6)]
    found, counts = estimate_zone(_parsed(spark, rows), "wall", "off", ["rec"], "at")
    assert found == "Europe/Copenhagen" and counts[found] == 6 and counts["Europe/Helsinki"] == 0


def test_values_before_the_delivery_before_them_are_violations(spark):
    """Both sides count: an eastern zone puts values before what was delivered earlier."""
    rows = []
    for i in range(20):
        rows += [(f"r{i}", "2020-06-01T10:00:00Z", datetime(2020, 6, 2)), (f"r{i}", "2020-06-01T12:20:30", datetime(2020, 6, 3))]
    _, counts = estimate_zone(_parsed(spark, rows), "wall", "off", ["rec"], "at")
    assert counts["Europe/Helsinki"] == counts["Europe/Moscow"] == 20 and counts["Europe/Copenhagen"] == counts["UTC"] == 0


def test_each_source_has_its_own_zone(spark):
    rng, rows = random.Random(8), []
    for source, zone in (("a", "America/New_York"), ("b", "Europe/Copenhagen"), (None, "Europe/Moscow")):
        for i in range(40):
            t = datetime.fromtimestamp(1_500_000_000 + rng.randrange(10**8), UTC)
            local = t.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%dT%H:%M:%S")
            rows += [(source, f"{source}{i}", t.strftime("%Y-%m-%dT%H:%M:%SZ"), datetime(2026, 1, 1), t.timestamp()), (source, f"{source}{i}", local, datetime(2026, 2, 1), t.timestamp())]
    rows.append(("c", "c1", "2020-06-01T12:00:00Z", datetime(2026, 1, 1), 1591012800.0))
    rows.append(("d", None, None, None, None))
    df = spark.createDataFrame(rows, "wall string, rec string, v string, at timestamp, want double")
    got = normalise_instants(df, "v", "us", ["rec"], "at", by=["wall"]).collect()
    assert len(got) == len(rows) and all(r["us"] == (None if r["want"] is None else int(r["want"]) * 1_000_000) for r in got)
