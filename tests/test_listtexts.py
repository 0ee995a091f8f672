"""Golden values of the short list texts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from fernmill.functions import columns, listtexts

TODAY = date(2026, 9, 29)
DEADLINES = [
    ("~10.18(일)", TODAY, "DATE", date(2026, 10, 18), False),
    ("~01.05(화)", date(2026, 12, 20), "DATE", date(2027, 1, 5), False),
    ("~12.31(목)", date(2027, 1, 1), "DATE", date(2026, 12, 31), False),
    ("~09.30(수)", date(2027, 2, 10), "DATE", date(2027, 9, 30), False),
    ("~02.29", date(2027, 11, 20), "DATE", date(2028, 2, 29), False),
    ("~13.40", TODAY, "DATE", None, True),
    ("~2026.10.05", TODAY, "DATE", date(2026, 10, 5), False),
    ("~2026.13.05", TODAY, "DATE", None, True),
    ("~10.05(일) 18시 마감", TODAY, "DATE", date(2026, 10, 5), False),
    ("~10.05 18:00", TODAY, "DATE", date(2026, 10, 5), False),
    ("~ 10 . 05", TODAY, "DATE", date(2026, 10, 5), False),
    ("10.05 마감", TODAY, "DATE", date(2026, 10, 5), False),
    ("10.05", TODAY, "DATE", None, True),
    ("2026.10.05 마감", TODAY, "DATE", None, True),
    ("D-5", TODAY, "DATE", date(2026, 10, 4), False),
    ("D-7 18:00", TODAY, "DATE", date(2026, 10, 6), False),
    ("D-0", TODAY, "DATE", TODAY, False),
    ("D-DAY", TODAY, "DATE", TODAY, False),
    ("d-3", TODAY, "DATE", date(2026, 10, 2), False),
    ("D-365", TODAY, "DATE", date(2027, 9, 29), False),
    ("D-366", TODAY, "DATE", None, True),
    ("D-99999999999", TODAY, "DATE", None, True),
    ("~100.05", TODAY, "DATE", None, True),
    ("오늘마감", TODAY, "DATE", TODAY, False),
    ("15시 마감", TODAY, "DATE", TODAY, False),
    ("내일 18시 마감", TODAY, "DATE", date(2026, 9, 30), False),
    ("채용시 마감", TODAY, "UNTIL_FILLED", None, False),
    ("상시채용", TODAY, "ALWAYS", None, False),
    ("수시채용", TODAY, "ROLLING", None, False),
    (None, TODAY, "DATE", None, True),
    ("처음 보는 표기", TODAY, "DATE", None, True),
    ("", TODAY, "DATE", None, True),
]
NOW = 1790654400
POSTED = [
    ("13일 전 등록", (False, NOW - 13 * 86400, 86400)),
    ("3시간 전 수정", (True, NOW - 3 * 3600, 3600)),
    ("45분 전 수정", (True, NOW - 45 * 60, 60)),
    ("방금 전 수정", (True, NOW, 60)),
    ("어제 등록", (False, NOW - 86400, 86400)),
    ("9999일 전 등록", (False, NOW - 9999 * 86400, 86400)),
    ("입사지원", None),
    ("99999일 전 등록", None),
    ("999999999분 전 수정", None),
    (None, None),
]
CAREERS = [
    ("신입·경력 3년 ↓", ("NEW_OR_EXP", None, 3)),
    ("경력 3~5년", ("EXPERIENCED", 3, 5)),
    ("경력 3-5년", ("EXPERIENCED", 3, 5)),
    ("경력 3년~5년", ("EXPERIENCED", 3, 5)),
    ("경력 5년↑", ("EXPERIENCED", 5, None)),
    ("경력 1년~", ("EXPERIENCED", 1, None)),
    ("경력 1~100년", ("EXPERIENCED", 1, None)),
    ("경력 3~99999999999년", ("EXPERIENCED", 3, None)),
    ("경력 99999999999년↑", ("EXPERIENCED", None, None)),
    ("경력 100년", ("EXPERIENCED", None, None)),
    ("신입·경력 99999999999년 ↓", ("NEW_OR_EXP", None, None)),
    ("3 ~ 5년 · 정규직", ("EXPERIENCED", 3, 5)),
    ("경력(년수무관) · 정규직", ("EXPERIENCED", None, None)),
    ("경력무관(신입포함)", ("ANY", None, None)),
    ("신입", ("NEW", None, None)),
    ("신입 · 경력 · 정규직 외", ("NEW_OR_EXP", None, None)),
    (None, (None, None, None)),
]


def test_deadlines(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(DEADLINES)], "i int, t string, d date")
    rows = df.select("i", listtexts.deadline(F.col("t"), F.col("d")).alias("x")).orderBy("i").collect()
    for r, case in zip(rows, DEADLINES):
        assert (r.x.type, r.x.date, r.x.unknown) == case[2:], case


def test_posted(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(POSTED)], "i int, t string")
    rows = df.select("i", listtexts.posted(F.col("t"), F.lit(NOW).cast("bigint")).alias("x")).orderBy("i").collect()
    assert [r.x and tuple(r.x) for r in rows] == [c[1] for c in POSTED]


@pytest.mark.parametrize(("precision", "minutes"), [(60, 60), (3600, 60), (86400, 1440), (None, 60)])
def test_tolerance(spark, precision, minutes):
    assert spark.range(1).select(listtexts.tolerance_minutes(F.lit(precision).cast("bigint"))).first()[0] == minutes


def test_careers(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CAREERS)], "i int, t string")
    rows = df.select("i", listtexts.career(F.col("t")).alias("x")).orderBy("i").collect()
    assert [tuple(r.x) for r in rows] == [c[1] for c in CAREERS]


def test_small_columns(spark):
    df = spark.createDataFrame([("\x01 a+b%2B \t", "x%zz"), (None, None)], "a string, b string")
    got = df.select(columns.cut(F.col("a"), 3), columns.url_decoded(F.col("a")), columns.url_decoded(F.col("b")), columns.is_blank(F.col("a")), columns.joined(" · ", F.lit("x"), F.lit(None), F.lit("y"))).collect()
    assert tuple(got[0]) == ("a+b", "\x01 a+b+ \t", "x%zz", False, "x · y")
    assert tuple(got[1])[:4] == (None, None, None, True)
