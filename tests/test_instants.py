import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from fixloom.functions.instants import utc_micros
from fixloom.operators.instants import estimate_zones, normalise_instants, zone_report

CASES = {  # text, in a source whose clock is in New York -> instant in UTC
    "2020-01-02 03:04:05": "2020-01-02 08:04:05", "2020-07-02T03:04:05.1234567": "2020-07-02 07:04:05.123456", "2020-01-02T03:04:05Z": "2020-01-02 03:04:05", "2020-01-02t03:04:05z": "2020-01-02 03:04:05",
    "2020-01-02T03:04:05+05:30": "2020-01-01 21:34:05", "20200102T030405-0800": "2020-01-02 11:04:05", "02.01.2020 03:04": "2020-01-02 08:04:00", "26-Nov-2014 03:57:54": "2014-11-26 08:57:54",
    "Nov 28, 2013 12:41:01 AM": "2013-11-28 05:41:01", "Nov 28, 2013 12:41:01 PM": "2013-11-28 17:41:01", "Mon Sep 5 01:09:34 2016 +0930": "2016-09-04 15:39:34", "Mon, 5 Sep 2016 01:09:34 +0930 (local)": "2016-09-04 15:39:34",
    "Sat, 20 Apr 2024 02:43:49 GMT": "2024-04-20 02:43:49", "2020-01-02 03:04:05 CET": "2020-01-02 02:04:05", "2020-07-02 03:04:05 Europe/Berlin": "2020-07-02 01:04:05", "2020-07-02T03:04:05[Asia/Tokyo]": "2020-07-01 18:04:05",
    "1577934245": "2020-01-02 03:04:05", "1577934245.83": "2020-01-02 03:04:05.83", "1577934245123": "2020-01-02 03:04:05.123", "1577934245123456": "2020-01-02 03:04:05.123456", "1577934245123456789": "2020-01-02 03:04:05.123456",
    "1577934245 +0900": "2020-01-02 03:04:05", "2020/01/02 03:04:05": "2020-01-02 08:04:05", "2020-01-02 03:04:05,467": "2020-01-02 08:04:05.467", "\t2020-01-02 03:04:05 \n": "2020-01-02 08:04:05",
    "2020-11-01 01:30:00": "2020-11-01 05:30:00", "2020-03-08 02:30:00": "2020-03-08 07:30:00", "2020-11-01 01:30:00 EST": "2020-11-01 06:30:00",
    "2019-02-30 10:00:00": None, "2018-13-05T08:00:00Z": None, "2020-06-11T25:10:00Z": None, "0000-00-00 00:00:00": None, "31.04.2021 08:15": None, "yesterday": None, "": None, " ": None, "-": None, "Thu Jan": None,
    "2020-01-02 03:04:60": None, "Nov 28, 2013 13:41:01 AM": None, "2020-01-02 03:04:05 Mars/Base": None, "9" * 100_000: None, None: None,
}


def micros(text):
    at = datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    return int(at.timestamp()) * 1_000_000 + at.microsecond


def test_forms(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string").select("i", utc_micros(F.col("t"), F.lit("America/New_York")).alias("u")).orderBy("i").collect()
    assert {t: r.u for t, r in zip(CASES, rows)} == {t: w and micros(w) for t, w in CASES.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, src string, a string, b string, ingested_at timestamp, epoch_us string, _v string")


def test_operator_edges(spark):
    catalogue = spark.createDataFrame([("x", "Asia/Tokyo"), ("y", None), (None, "Asia/Tokyo")], "src string, local_tz string")
    at = datetime(2021, 1, 1)
    rows = [(1, "x", "2020-01-02 09:00:00", None, at, "", ""), (1, "x", "2020-01-02 09:00:00", None, at, "", ""), (2, "y", "2020-01-02 09:00:00", "n/a", None, "", ""), (None, None, "2020-01-02 09:00:00", "", at, None, None), (5, "new", "2020-01-02 09:00:00", "x" * 100_000, None, "", "")]
    got = sorted(((r[0] or 0), r[1], r[2]) for r in normalise_instants(table(spark, rows), "row_id", "src", ["a", "b"], "ingested_at", catalogue).collect())
    assert got == [(0, "a", micros("2020-01-02 09:00:00")), (1, "a", micros("2020-01-02")), (1, "a", micros("2020-01-02")), (2, "a", micros("2020-01-02 09:00:00")), (5, "a", micros("2020-01-02 09:00:00"))]
    assert normalise_instants(table(spark, []), "row_id", "src", ["a", "b"], "ingested_at", catalogue).count() == 0
    assert normalise_instants(table(spark, rows), "row_id", "src", ["a", "b"], "ingested_at", catalogue.limit(0)).count() == 5


def test_estimated_zone(spark):
    rows = [(i, "s", f"2020-{1 + i % 12:02d}-10 12:00:00", None, datetime(2021, 3, 1 + i % 9, 16 if 1 + i % 12 in range(3, 11) else 17), "", "") for i in range(60)]
    rows += [(i, "u", "2020-01-10T12:00:00Z", None, datetime(2021, 3, 1, 12), "", "") for i in range(5)]
    got = estimate_zones(table(spark, rows), "src", ["a", "b"], "ingested_at").collect()
    assert [(r.src, r.zone, r.n_local, r.n_violations) for r in got] == [("s", "America/New_York", 60, 0)]


ZONES = {"ny": "America/New_York", "to": "Asia/Tokyo", "be": "Europe/Berlin", "ko": "Asia/Kolkata"}


def local_rows(zones, n, least_s, most_s, zoned=0, step_s=1, seed=3):
    """Local times of sources over two years, each taken in a random lag later; ``zoned`` of them name UTC."""
    r, rows = random.Random(seed), []
    for src, zone in zones.items():
        for i in range(n + zoned):
            at = datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=r.randrange(2 * 365 * 86_400))
            text = at.strftime("%Y-%m-%dT%H:%M:%SZ") if i >= n else at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S")
            lag = r.randrange(least_s // step_s, most_s // step_s + 1) * step_s
            rows.append((len(rows), src, text, None, (at + timedelta(seconds=lag)).replace(tzinfo=None), "", ""))
    return rows


@pytest.mark.parametrize("zoned", [0, 100])
def test_zones_of_random_lags(spark, zoned):
    """Lags of two minutes to a day, at no pace: order and tightness alone tell the zone."""
    got = {x.src: x for x in estimate_zones(table(spark, local_rows(ZONES, 400, 120, 86_400, zoned)), "src", ["a", "b"], "ingested_at").collect()}
    assert {s: x.zone for s, x in got.items()} == ZONES and all(x.n_local == 400 and x.n_violations == 0 for x in got.values())


def test_zones_of_a_steady_pace(spark):
    """Lags of whole weeks: no order is broken by any zone, but the times that name theirs show the pace."""
    got = {x.src: x.zone for x in estimate_zones(table(spark, local_rows(ZONES, 200, 7 * 86_400, 70 * 86_400, 60, 86_400)), "src", ["a", "b"], "ingested_at").collect()}
    assert got == ZONES


def test_a_zone_that_fits_nothing_is_none(spark):
    early = local_rows({"x": "UTC"}, 100, -40 * 86_400, -20 * 86_400)
    assert [(r.zone, r.n_violations) for r in estimate_zones(table(spark, early), "src", ["a", "b"], "ingested_at").collect()] == [(None, 100)]
    catalogue = spark.createDataFrame([("y", "Asia/Tokyo")], "src string, local_tz string")
    report = zone_report(table(spark, local_rows({"x": "UTC", "y": "Europe/Berlin"}, 300, 120, 86_400)), "src", ["a", "b"], "ingested_at", catalogue)
    assert sorted(map(tuple, report.collect())) == [("x", "UTC", None, True), ("y", "Europe/Berlin", "Asia/Tokyo", True)]


def test_more_sources_than_a_map_takes(spark):
    rows = local_rows({f"s{i}": "Asia/Tokyo" for i in range(7)}, 40, 120, 86_400)
    catalogue = spark.createDataFrame([("s0", "Asia/Kolkata"), ("s1", None), ("s1", None)], "src string, local_tz string")
    joined, mapped = (sorted(map(tuple, normalise_instants(table(spark, rows), "row_id", "src", ["a", "b"], "ingested_at", catalogue, most=m).collect())) for m in (3, 10))
    assert joined == mapped and len(mapped) == len(rows)
