import datetime as dt
import zoneinfo

from vinculum.operators.instants import normalise_instants, same_instant_pairs, zone_intervals

FEEDS = {"in": ("Asia/Kolkata", "DMY"), "us": ("America/New_York", "MDY"), "utc": ("UTC", "YMD"), "de": ("Europe/Berlin", "DMY")}
U = "2024-03-01T18:30:00Z"
CASES = [
    ("in", "2024-03-02T00:00:00", U), ("in", "2/3/24 00:00", U), ("us", "03/01/2024 13:30:00", U), ("us", "01-Mar-2024 01:30:00 pm", U),
    ("utc", "20240301T183000Z", U), ("utc", "20240301 1830", U), ("de", "2024-03-01 19:30:00 CET", U), ("in", "Sat, 02 Mar 2024 00:00:00 +0530", U),
    ("utc", "1709317800", U), ("utc", "1709317800000", U), ("utc", "1709317800000000", U), ("de", "2024-03-02T00:00:00[Asia/Kolkata]", U),
    ("de", "2024-03-01 13:30:00 America/New_York", U), ("utc", "2024/03/01 18:30", U), ("utc", "24/3/1 18:30", U), ("in", "02.03.2024 00:00:00.000", U),
    ("in", "2024-03-02T00:00:00.123456+05:30", "2024-03-01T18:30:00.123456Z"), ("in", "2024-03-02", U.replace("-01T", "-01T")),
    ("de", "2024-10-27 02:30:00", "2024-10-27T00:30:00Z"), ("de", "2024-03-31 02:30:00", None), ("us", "31/02/2025 10:00", None), ("in", "31/02/2025 10:00", None),
    ("in", "", None), ("in", None, None), ("in", "unknown", None), ("in", "0000-00-00 00:00:00", None), ("in", "2024-03-02 24:01:00", None), ("in", "13-Mar-2024 13:00 PM", None),
    ("in", "12-Mar-2024 12:05:00 AM", "2024-03-11T18:35:00Z"), ("in", "2024-03-02 00:00:00 Mars/Base", None), (None, "2024-03-01 18:30:00", U),
    ("in", "02/03/2024 12:00 AM", U), ("utc", "2024-03-01 6:30 PM", U), ("utc", "Mar 1, 2024 18:30", U), ("utc", "Fri, March 1, 2024, 6:30 p.m.", U), ("utc", "2024-03-02T00:00:00+5:30", U),
    ("utc", "-1709317800", "1915-11-02T05:30:00Z"), ("de", "1965-06-01 12:00:00", "1965-06-01T11:00:00Z"), ("in", "1850-01-01 05:53:28", "1850-01-01T00:00:00Z"), ("us", "07/01/2050 12:00:00", "2050-07-01T16:00:00Z"),
    ("de", "2050-01-05 15:15", "2050-01-05T14:15:00Z"), ("de", "9999-07-01 12:00", "9999-07-01T10:00:00Z"), ("de", "2500-01-01 00:00", "2499-12-31T23:00:00Z"), ("utc", "Foo 1, 2024", None), ("in", "2024-13-02", None), ("utc", "2024-03-01 18:30 PM", None),
]


def table(spark, cases):
    rows = [(k, t, *FEEDS.get(f, (None, None)), "clash") for k, (f, t, _) in enumerate(cases)]
    return spark.createDataFrame(rows, "k int, t string, zone string, ord string, instant string")


def test_every_form_gives_the_instant(spark):
    got = {r.k: r for r in normalise_instants(table(spark, CASES), "t", "zone", "ord").collect()}
    for k, (_, text, want) in enumerate(CASES):
        us = None if want is None else (dt.datetime.fromisoformat(want) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
        assert got[k].instant_us == us, text
    status = {CASES[k][1]: r.instant_status for k, r in got.items()}
    assert status["2024-10-27 02:30:00"] == "ambiguous" and status["2024-03-31 02:30:00"] == "nonexistent" and status["unknown"] == "unreadable"


def test_empty_table_and_defaults(spark):
    assert normalise_instants(table(spark, CASES).limit(0), "t", "zone", "ord").count() == 0
    one = normalise_instants(spark.createDataFrame([("1/2/2024",)], "t string"), "t").first()
    assert one.instant_us == 1_706_745_600_000_000


def test_intervals_equal_the_zone_database():
    zone = zoneinfo.ZoneInfo("Europe/Berlin")
    rows = zone_intervals(["Europe/Berlin", "No/Where"], 2023, 2025)
    for hour in range(0, 24 * 400, 5):
        local = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=30)
        us = (local - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        offsets = {r[4] for r in rows if r[1] == local.year and r[2] <= us < r[3]}
        folds = {local.replace(tzinfo=zone, fold=f) for f in (0, 1)}
        want = {int(x.utcoffset().total_seconds()) for x in folds if x.astimezone(dt.UTC).astimezone(zone).replace(tzinfo=None) == local}
        assert offsets == want


def test_pairs_of_one_record(spark):
    rows = [(1, "r", "a", 5), (2, "r", "b", 5), (3, "r", "a", 5), (4, "r", "c", 6), (5, None, "a", 5), (6, None, "b", 5), (7, "q", "x", 5), (8, "q", "x", 5), (9, "r", "z", None)]
    df = spark.createDataFrame(rows, "k int, rec string, t string, instant_us long")
    assert {tuple(r) for r in same_instant_pairs(df, "rec", "t", "k").collect()} == {(1, 2), (2, 3)}
