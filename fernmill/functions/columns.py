"""Small column functions shared by the operators; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(text: Column, pattern: str, group: int) -> Column:
    """An integer group of the first match; null if there is none or it is too large."""
    return F.regexp_extract(text, pattern, group).try_cast("int")


def found(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def day(year: Column, month: Column, dom: Column) -> Column:
    """A date, or null where the three make none."""
    # a failed to_date costs an exception a row, a failed try_cast does not
    return F.when(year.isNotNull() & month.isNotNull() & dom.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, dom).try_cast("date"))


def let(parts: dict[str, Column], body) -> Column:  # type: ignore[no-untyped-def]
    """``body`` of named parts that are computed once a row, however often it uses them."""
    bound = F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))
    return F.transform(bound, lambda x: body({n: x[n] for n in parts}))[0]


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | text.rlike(r"^\p{javaWhitespace}*$")


def cut(text: Column, most: int) -> Column:
    """The text without control characters and spaces at its ends, at most so many characters."""
    return F.substring(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), 1, most)


def retry_after_ms(text: Column) -> Column:
    """How long to wait for a header of seconds, at most ten minutes; 0 for a date, another text or none."""
    t = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.coalesce(F.when(t.rlike(r"^[0-9]{1,6}$"), F.least(t.try_cast("bigint") * 1000, F.lit(600_000))), F.lit(0)).cast("bigint")


def url_decoded(text: Column) -> Column:
    """Percent escapes resolved, plus signs kept; a malformed value stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def joined(separator: str, *parts: Column) -> Column:
    """The parts that are there, with a separator between them."""
    return F.concat_ws(separator, *parts)


def utc_day(seconds: Column) -> Column:
    """The UTC calendar day of an epoch second, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
