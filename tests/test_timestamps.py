import pytest

from paperloom.operators.timestamps import normalize_timestamps

PROFILES = [("cia", "America/New_York", "mdy"), ("noaa", "UTC", "dmy"), ("osd", "Asia/Tokyo", "mdy"), ("cia", "America/New_York", "mdy")]

CASES = [
    ("1949", "cia", "1949"), (" [1968] ", "cia", "1968"), ("1951-07", "cia", "1951-07"), ("1951-13", "cia", None),
    ("19790315", "cia", "1979-03-15"), ("1985-13-45", "cia", None), ("2011/3/7", "cia", "2011-03-07"), ("February 30, 2000", "cia", None),
    ("3/9/1950", "cia", "1950-03-09"), ("3/9/1950", "noaa", "1950-09-03"), ("25/12/49", "noaa", "1949-12-25"), ("25/12/49", "cia", None),
    ("12.02.2001", "cia", "2001-02-12"), ("04/1978", "cia", "1978-04"), ("JULY, 1962", "cia", "1962-07"), ("Sept. 4, 1957", "cia", "1957-09-04"),
    ("Sunday, March 11, 2007", "cia", "2007-03-11"), ("3rd May 1961", "cia", "1961-05-03"), ("06-FEB-1965", "cia", "1965-02-06"),
    ("1236496680", "cia", "2009-03-08T07:18:00.000Z"), ("790315979819", "cia", "1995-01-17T04:12:59.819Z"),
    ("1974-04-17T17:11:40-03:30", "cia", "1974-04-17T20:41:40.000Z"), ("1962-02-01 21:09:30.626934+00:00", "cia", "1962-02-01T21:09:30.626Z"),
    ("1960-01-19T17:38:50+05", "cia", "1960-01-19T12:38:50.000Z"), ("1995-08-30T15:23", "cia", "1995-08-30T19:23:00.000Z"),
    ("12/05/1987 23:03", "noaa", "1987-05-12T23:03:00.000Z"), ("071710Z JAN 47", "cia", "1947-01-07T17:10:00.000Z"),
    ("020657Q MAR 1946", "cia", "1946-03-02T10:57:00.000Z"), ("020657J MAR 1946", "cia", "1946-03-02T11:57:00.000Z"),
    ("Fri, 04 Nov 1955 14:09:47 GMT", "cia", "1955-11-04T14:09:47.000Z"), ("March 8, 2009 at 12:20 AM", "cia", "2009-03-08T05:20:00.000Z"),
    ("March 8, 2009 2:41 AM", "cia", None), ("10/25/1998 01:17", "cia", None), ("10/25/1998 01:17", "osd", "1998-10-24T16:17:00.000Z"),
    ("Oct 25, 2014 2020 EDT", "cia", "2014-10-26T00:20:00.000Z"), ("1949-01-01T24:00:00Z", "cia", None), ("1949-01-01T10:00:60Z", "cia", None),
    ("13:00 PM", "cia", None), ("1966-1969", "cia", None), ("ca. 1990", "cia", None), ("FY 1992", "cia", None), ("2007s", "cia", None), ("March 1980 or later", "cia", None),
    ("", "cia", None), (None, "cia", None), ("3/9/1950", "unknown", None), ("1950-03-09", None, "1950-03-09"), ("1950-03-09T10:00", None, None), ("x" * 100_000, "cia", None),
]


def test_each_form(spark):
    rows = [(i, s, d, "noise", "noise") for i, (d, s, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, source string, date string, status string, row_id string")
    out = normalize_timestamps(df, "id", "date", spark.createDataFrame(PROFILES, "source string, zone string, slash_order string"))
    got = {r["row_id"]: r["normal_form"] for r in out.collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, _, want) in enumerate(CASES)}


@pytest.mark.parametrize("date,status", [("2009-03-08T02:41", "skipped"), ("1998-10-25T01:17", "repeated"), ("1998-10-25T02:17", "ok"), ("nil", "unread"), ("31.02.1999", "impossible"), (" ", "empty")])
def test_status(spark, date, status):
    df = spark.createDataFrame([(1, "cia", date)], "id int, source string, date string")
    out = normalize_timestamps(df, "id", "date", spark.createDataFrame(PROFILES, "source string, zone string, slash_order string")).first()
    assert out["status"] == status and (out["normal_form"] is None) == (status != "ok")


def test_zone_of_the_session_does_not_matter(spark):
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    zone, day = ZoneInfo("America/New_York"), datetime(1975, 2, 20)
    times = [day + timedelta(hours=7 * k, minutes=11) for k in range(300)]
    df = spark.createDataFrame([(i, "cia", t.strftime("%Y-%m-%d %H:%M:%S")) for i, t in enumerate(times)], "id int, source string, date string")
    want = {}
    for i, t in enumerate(times):
        a, b = (t.replace(tzinfo=zone, fold=f).astimezone(ZoneInfo("UTC")) for f in (0, 1))
        back = a.astimezone(zone).replace(tzinfo=None) == t
        want[i] = a.strftime("%Y-%m-%dT%H:%M:%S.000Z") if a == b and back else None
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        out = normalize_timestamps(df, "id", "date", spark.createDataFrame(PROFILES, "source string, zone string, slash_order string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert {r["row_id"]: r["normal_form"] for r in out} == want


def test_empty_and_repeated(spark):
    profiles = spark.createDataFrame(PROFILES, "source string, zone string, slash_order string")
    df = spark.createDataFrame([(1, "cia", "1950"), (1, "cia", "1950")], "id int, source string, date string")
    assert normalize_timestamps(df.limit(0), "id", "date", profiles).count() == 0
    assert normalize_timestamps(df, "id", "date", profiles).count() == 2
    assert normalize_timestamps(df, "id", "date", profiles.limit(0), source="cia").filter("normal_form = '1950'").count() == 2
