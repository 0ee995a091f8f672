"""Short texts of list pages as typed values: deadlines, posting times, careers.

Each function is a ladder of conditions on columns, the first that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fernmill.functions.columns import day, found, is_blank, let, number

#: How list pages write deadlines, times and years of experience.
TILDE_FULL_DATE = r"~\s*(\d{4})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})(?!\d)"
TILDE_MONTH_DAY = r"~\s*(\d{1,2})\s*[./]\s*(\d{1,2})(?!\d)"
MONTH_DAY_THEN_CLOSE = r"(?<![\d.~/])(\d{1,2})\s*[./]\s*(\d{1,2})(?!\d)\s*(\([^)]*\))?\s*(\d{1,2}\s*(시|:\s*\d{2}))?\s*마감"
D_DAY = r"(?i)(?<![a-z])D\s*-\s*day"
D_MINUS = r"(?i)(?<![a-z])D\s*-\s*(\d{1,4})(?!\d)"
HOUR_CLOSE = r"\d+시마감"
MOST_DAYS_AHEAD, DAYS_BACK = 365, 30
COUNTED_AGO = r"(?<!\d)(\d{1,4})\s*(분|시간|일)\s*전\s*(등록|수정)"
WORDED_AGO = r"(방금\s*전|어제)\s*(등록|수정)"
UNIT_SECONDS = {"분": 60, "시간": 3600, "일": 86400}
YEARS_BETWEEN = r"(?<!\d)(\d{1,2})\s*년?\s*[~\-]\s*(\d{1,2})(?!\d)\s*년"
YEARS_OPEN = r"(?<!\d)(\d{1,2})(?:\s*년\s*[~\-]|\s*년?\s*[~\-]\s*\d{3,})"
YEARS_AT_LEAST = r"(?<!\d)(\d{1,2})\s*년\s*(↑|이상)"
YEARS_AT_MOST = r"(?<!\d)(\d{1,2})\s*년\s*(↓|이하)"
LEAST_TOLERANCE_MINUTES = 60


def nearest_year(month: Column, dom: Column, today: Column) -> Column:
    """The first such day of last, this and next year that is at most 30 days past; else null."""
    least = F.date_sub(today, DAYS_BACK)
    tries = [day(F.year(today) + F.lit(k), month, dom) for k in (-1, 0, 1)]
    return F.coalesce(*[F.when(t >= least, t) for t in tries])


def deadline(text: Column, today: Column) -> Column:
    """struct(type, date, unknown); null and blank texts are unknown dates."""
    first = {
        "text": text, "today": today, "tight": F.regexp_replace(text, " ", ""), "blank": is_blank(text), "ahead": number(text, D_MINUS, 1),
        "y": number(text, TILDE_FULL_DATE, 1), "m": number(text, TILDE_FULL_DATE, 2), "d": number(text, TILDE_FULL_DATE, 3),
        "m1": number(text, TILDE_MONTH_DAY, 1), "d1": number(text, TILDE_MONTH_DAY, 2),
        "m2": number(text, MONTH_DAY_THEN_CLOSE, 1), "d2": number(text, MONTH_DAY_THEN_CLOSE, 2),
    }
    on = lambda d: F.struct(F.lit("DATE").alias("type"), d.cast("date").alias("date"), F.lit(False).alias("unknown"))
    open_end = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("date").alias("date"), F.lit(False).alias("unknown"))
    unknown = F.struct(F.lit("DATE").alias("type"), F.lit(None).cast("date").alias("date"), F.lit(True).alias("unknown"))

    def dated(p: dict[str, Column]) -> Column:
        dates = {"full": day(p["y"], p["m"], p["d"]), "tilde": nearest_year(p["m1"], p["d1"], p["today"]), "close": nearest_year(p["m2"], p["d2"], p["today"])}
        return let(p | dates, ladder)

    def ladder(p: dict[str, Column]) -> Column:
        return (
            F.when(p["blank"], unknown)
            .when(p["tight"].contains("채용시"), open_end("UNTIL_FILLED"))
            .when(p["tight"].contains("상시"), open_end("ALWAYS"))
            .when(p["tight"].contains("수시"), open_end("ROLLING"))
            .when(p["full"].isNotNull(), on(p["full"]))
            .when(p["tilde"].isNotNull(), on(p["tilde"]))
            .when(p["close"].isNotNull(), on(p["close"]))
            .when(found(p["text"], D_DAY), on(p["today"]))
            .when(p["ahead"] > MOST_DAYS_AHEAD, unknown)
            .when(p["ahead"].isNotNull(), on(F.date_add(p["today"], p["ahead"])))
            .when(p["tight"].contains("내일"), on(F.date_add(p["today"], 1)))
            .when(p["tight"].contains("오늘마감") | found(p["tight"], HOUR_CLOSE), on(p["today"]))
            .otherwise(unknown)
        )

    return let(first, dated)


def posted(text: Column, now_second: Column) -> Column:
    """struct(modified, at_second, precision_second), or null for a text that tells no time.

    ``now_second`` is the epoch second at which the page was seen.
    """
    word, word_verb = F.regexp_extract(text, WORDED_AGO, 1), F.regexp_extract(text, WORDED_AGO, 2)
    count, unit, verb = number(text, COUNTED_AGO, 1), F.regexp_extract(text, COUNTED_AGO, 2), F.regexp_extract(text, COUNTED_AGO, 3)
    seconds = F.when(unit == "분", UNIT_SECONDS["분"]).when(unit == "시간", UNIT_SECONDS["시간"]).otherwise(UNIT_SECONDS["일"]).cast("bigint")
    when = lambda v, at, p: F.struct((v == "수정").alias("modified"), at.cast("bigint").alias("at_second"), p.cast("bigint").alias("precision_second"))
    day_s = F.lit(UNIT_SECONDS["일"])
    return (
        F.when(word == "어제", when(word_verb, now_second - day_s, day_s))
        .when(word != "", when(word_verb, now_second, F.lit(60)))
        .when(count.isNotNull(), when(verb, now_second - count * seconds, seconds))
    )


def tolerance_minutes(precision_second: Column) -> Column:
    """How far two readings of one modification may lie apart: the precision, an hour at least."""
    return F.greatest(F.coalesce(precision_second, F.lit(0)) / 60, F.lit(LEAST_TOLERANCE_MINUTES)).cast("bigint")


def career(text: Column) -> Column:
    """struct(type, exp_min, exp_max) of a career text; all null for null and blank."""
    return let({"t": F.regexp_replace(text, " ", ""), "blank": is_blank(text)}, _career_parts)


def _career_parts(p: dict[str, Column]) -> Column:
    t = p["t"]
    numbers = {
        "from": number(t, YEARS_BETWEEN, 1), "to": number(t, YEARS_BETWEEN, 2), "least": F.coalesce(number(t, YEARS_AT_LEAST, 1), number(t, YEARS_OPEN, 1)), "most": number(t, YEARS_AT_MOST, 1),
    }
    return let(p | numbers, _career)


def _career(p: dict[str, Column]) -> Column:
    t, both = p["t"], p["from"].isNotNull()
    low, high = F.when(both, p["from"]).otherwise(p["least"]), F.when(both, p["to"]).otherwise(p["most"])
    new, old = t.contains("신입"), t.contains("경력")
    kind = (
        F.when(t.contains("경력무관"), "ANY").when(new & old, "NEW_OR_EXP").when(new, "NEW").when(old, "EXPERIENCED")
        .when(low.isNotNull() | high.isNotNull(), "EXPERIENCED")
    )
    blank = p["blank"]
    return F.struct(F.when(~blank, kind).alias("type"), F.when(~blank, low).alias("exp_min"), F.when(~blank, high).alias("exp_max"))
