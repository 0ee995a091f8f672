"""Days and instants in many forms; the dictionary; rows joined back."""

from datetime import datetime, timezone

import pytest

from fernmill.operators import instants
from fernmill.operators.instants import parse_deadline, parse_instant

SEOUL, NEW_YORK, BERLIN, HANOI = "Asia/Seoul", "America/New_York", "Europe/Berlin", "Asia/Ho_Chi_Minh"


def at(*a):
    return "instant", int(datetime(*a, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    ("raw", "zone", "want"),
    [
        ("2026-03-08T04:49:38.474805Z", SEOUL, at(2026, 3, 8, 4, 49, 38)),
        ("2026-03-09 09:55:56 KST 등록", SEOUL, at(2026, 3, 9, 0, 55, 56)),
        ("(26/02/25 19:41) 수정", SEOUL, at(2026, 2, 25, 10, 41)),
        ("등록일 2026.03.08", SEOUL, at(2026, 3, 7, 15)),
        ("2026년 3월 10일 오전 12시 3분", SEOUL, at(2026, 3, 9, 15, 3)),
        ("2026.3.10 오후 2:17", SEOUL, at(2026, 3, 10, 5, 17)),
        ("20260302023333", SEOUL, at(2026, 3, 1, 17, 33, 33)),
        ("20260719T045111+0900", SEOUL, at(2026, 7, 18, 19, 51, 11)),
        ("1772961115", SEOUL, ("instant", 1772961115)),
        ("1773014764515", SEOUL, ("instant", 1773014764)),
        ("1761437277307830", SEOUL, ("instant", 1761437277)),
        ("03/08/2026 5:09 AM", NEW_YORK, at(2026, 3, 8, 9, 9)),
        ("03/08/2026 2:30 AM", NEW_YORK, at(2026, 3, 8, 7, 30)),  # skipped by daylight saving
        ("11/01/2026 1:30 AM", NEW_YORK, at(2026, 11, 1, 5, 30)),  # stands twice, the earlier
        ("2025-11-02 01:30:00.123 America/New_York", SEOUL, at(2025, 11, 2, 5, 30)),
        ("updated: 03/08/2026 3:22 AM", NEW_YORK, at(2026, 3, 8, 7, 22)),
        ("Oct 10, 2026, 12:28", NEW_YORK, at(2026, 10, 10, 16, 28)),
        ("Jul 28, 2026 7:02 PM EDT", SEOUL, at(2026, 7, 28, 23, 2)),
        ("Thu, 09 Jul 2026 12:44:55 -0400", SEOUL, at(2026, 7, 9, 16, 44, 55)),
        ("Stand: 28.2.2026, 21:44 Uhr", BERLIN, at(2026, 2, 28, 20, 44)),
        ("10. März 2026 03:32", BERLIN, at(2026, 3, 10, 2, 32)),
        ("26.10.2025 02:30 MEZ", SEOUL, at(2025, 10, 26, 1, 30)),
        ("05.05.2026 02:29 MESZ", BERLIN, at(2026, 5, 5, 0, 29)),
        ("Posted 09/03/2026 10:11:54", HANOI, at(2026, 3, 9, 3, 11, 54)),
        ("09-03-2026 21:17", HANOI, at(2026, 3, 9, 14, 17)),
        ("방금 전 수정", SEOUL, ("ago", 0)),
        ("어제 등록", SEOUL, ("ago", 86400)),
        ("38 분 전 등록", SEOUL, ("ago", 2280)),
        ("1 days ago", NEW_YORK, ("ago", 86400)),
        ("vor 21 Minuten", BERLIN, ("ago", 1260)),
        ("２０２６-03-08T04:49:38Z", SEOUL, at(2026, 3, 8, 4, 49, 38)),
        ("2026-03-08 04:4​9:38Z", SEOUL, at(2026, 3, 8, 4, 49, 38)),
        *[(x, SEOUL, None) for x in ("", "-", "등록", "unknown", "입사지원", "N/A", "99999일 전 등록", "2026-13-45 10:00 등록", "0000-00-00 00:00:00", "2026-13-01 25:00")],
        ("2026-03-08 04:49", "No/Zone", None),
    ],
)
def test_instants(raw, zone, want):
    assert parse_instant(raw, zone) == want


def day(y, m, d):
    return "day", (datetime(y, m, d) - datetime(1970, 1, 1)).days


@pytest.mark.parametrize(
    ("raw", "zone", "want"),
    [
        ("~2026-04-05", SEOUL, day(2026, 4, 5)),
        ("2026년 4월 20일까지", SEOUL, day(2026, 4, 20)),
        ("bis 02.05.2026", BERLIN, day(2026, 5, 2)),
        ("bis 23. Oktober 2026", BERLIN, day(2026, 10, 23)),
        ("Closes 04/03/2026", NEW_YORK, day(2026, 4, 3)),
        ("04/09/2026 11:59 PM", NEW_YORK, day(2026, 4, 9)),
        ("until Oct 26, 2026", NEW_YORK, day(2026, 10, 26)),
        ("12/06/2026", HANOI, day(2026, 6, 12)),
        ("2026-04-01T23:59:59+09:00", HANOI, day(2026, 4, 1)),
        ("2026-04-02T00:30:00+09:00", HANOI, day(2026, 4, 1)),
        ("1776762000", SEOUL, day(2026, 4, 21)),
        ("~ 04 . 02", SEOUL, ("month_day", 402)),
        ("~04.11 18:00", SEOUL, ("month_day", 411)),
        ("~05/10", NEW_YORK, ("month_day", 510)),
        ("04.03(금) 18시 마감", SEOUL, ("month_day", 403)),
        ("4월 16일 마감", SEOUL, ("month_day", 416)),
        ("～０４．１９（일）", SEOUL, ("month_day", 419)),
        ("~02.29", SEOUL, ("month_day", 229)),
        ("D - 83", SEOUL, ("ahead", 83)),
        ("D-56 18:00", SEOUL, ("ahead", 56)),
        ("D-DAY", SEOUL, ("ahead", 0)),
        ("D-8­2", BERLIN, ("ahead", 82)),
        ("15시 마감", SEOUL, ("ahead", 0)),
        ("내일 18시 마감", SEOUL, ("ahead", 1)),
        ("closes tomorrow", NEW_YORK, ("ahead", 1)),
        ("endet heute", BERLIN, ("ahead", 0)),
        *[(x, SEOUL, None) for x in ("", "-", "10.05", "~13.40", "~2026.02.30", "D-366", "D-9999", "채용시 마감", "상시채용", "수시채용", "rolling", "마감일 미정")],
    ],
)
def test_deadlines(raw, zone, want):
    assert parse_deadline(raw, zone) == want


ITEM = "item_id bigint, deadline_text string, posted_text string, seen_at timestamp, site_tz string, kind string, raw string"
POSTING = "row_id bigint, list_modified_at string, snap_on date, means string"


def test_rows(spark):
    seen = datetime(2026, 3, 9, 20, 0, 0, 700000)
    items = [
        (1, "~04.02", "어제 등록", seen, None, "x", "y"),  # no zone: Seoul, there already the 10th
        (2, "~02.01", "방금 전 수정", seen, "America/New_York", "x", "y"),
        (3, "D-1", "2 days ago", seen, "No/Zone", "x", "y"),
        (4, None, "", None, "Asia/Seoul", None, None),
        (5, "오늘마감", "3시간 전 등록", None, "Asia/Seoul", None, None),
        (5, "오늘마감", "3시간 전 등록", seen, "Asia/Seoul", None, None),
        (None, "D-1", "어제 등록", seen, None, None, None),
    ]
    posts = [(1, "2026.06.28", None, "m"), (2, None, None, "m"), (3, "1990-01-01 00:00:00", datetime(2026, 3, 1), "m")]
    got = {tuple(r) for r in instants.normalised(spark.createDataFrame(items, ITEM), spark.createDataFrame(posts, POSTING)).collect()}
    assert got == {
        ("deadline", 1, "2026-04-02"), ("posted", 1, "2026-03-08T20:00:00Z"), ("deadline", 2, "2027-02-01"), ("posted", 2, "2026-03-09T20:00:00Z"), ("posted", 3, "2026-03-07T20:00:00Z"),
        ("deadline", 5, "2026-03-10"), ("posted", 5, "2026-03-09T17:00:00Z"), ("modified", 1, "2026-06-27T15:00:00Z"),
    }


def test_empty_tables(spark):
    assert instants.normalised(spark.createDataFrame([], ITEM), spark.createDataFrame([], POSTING)).count() == 0


def test_dictionary_grows(spark):
    d = instants.ValueDictionary(spark)
    values = lambda *raw: spark.createDataFrame([("posted", r, SEOUL) for r in raw], "kind string, raw string, zone string")
    first = d.extend(values("어제 등록", "어제 등록", "2026.03.08", None))
    assert {(r.raw, r.rows) for r in first.collect()} == {("어제 등록", 2), ("2026.03.08", 1)}
    d.extend(values("2026.03.08", "2026.03.09"))
    d.extend(values("2026.03.09"))
    want = {("어제 등록", 0), ("2026.03.08", 0), ("2026.03.09", 1)}
    assert {(r.raw, r.batch) for r in d.table().collect()} == want and d.pointer.read()[0] == 2
    # a folder that someone removed is made again
    import shutil

    shutil.rmtree(f"{d.path.removeprefix('file:')}/{d.pointer.read()[1]['folders'][0]}")
    d.extend(values("어제 등록", "2026.03.08", "2026.03.09"))
    want = {(raw, 0) for raw, _ in want}
    # another session finds it again
    assert {(r.raw, r.batch) for r in instants.ValueDictionary(spark, d.path).table().collect()} == want


def test_later_rows_of_known_values(spark):
    d = instants.ValueDictionary(spark)
    seen = datetime(2026, 3, 9, 20)
    item = lambda *texts: spark.createDataFrame([(i, t, None, seen, None, "x", "y") for i, t in enumerate(texts)], ITEM)
    none = spark.createDataFrame([], POSTING)
    assert {r.norm for r in instants.normalised(item("D-1", "~04.02"), none, d).collect()} == {"2026-03-11", "2026-04-02"}
    assert {r.norm for r in instants.normalised(item("D-1", "D-2"), none, d).collect()} == {"2026-03-11", "2026-03-12"}
    assert d.table().count() == 3


def test_next_month_day(spark):
    cases = [(229, datetime(2026, 3, 9), "2028-02-29"), (229, datetime(2024, 3, 30), "2024-02-29"), (229, datetime(2024, 3, 31), "2028-02-29"), (229, datetime(2096, 12, 1), "2104-02-29"), (1231, datetime(2026, 1, 30), "2025-12-31"), (1231, datetime(2026, 1, 31), "2026-12-31"), (430, datetime(2026, 5, 31), "2027-04-30"), (430, datetime(2026, 5, 30), "2026-04-30")]
    df = spark.createDataFrame([(m, d.date(), w) for m, d, w in cases], "m bigint, d date, want string")
    got = df.select(instants.next_month_day(instants.F.col("m"), instants.F.col("d")).cast("string").alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_whatever_the_zone_of_the_session(spark):
    seen = spark.sql("SELECT timestamp_seconds(1773085200) AS t")  # the 9th in UTC, the 10th in Seoul
    items = seen.selectExpr("1L AS item_id", "'D-1' AS deadline_text", "'어제 등록' AS posted_text", "t AS seen_at", "'Asia/Seoul' AS site_tz")
    posts = spark.sql("SELECT 1L AS row_id, '2026.06.28' AS list_modified_at, DATE '2026-06-29' AS snap_on")
    found = []
    for zone in ("UTC", "Asia/Seoul", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found.append(sorted(tuple(r) for r in instants.normalised(items, posts).collect()))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == [("deadline", 1, "2026-03-11"), ("modified", 1, "2026-06-27T15:00:00Z"), ("posted", 1, "2026-03-08T19:40:00Z")]
    assert found[1] == found[0] == found[2]
