"""Days and instants written in many forms and zones, brought to one form.

Raw strings are deduplicated with their source and zone into a dictionary of distinct values.
Each value is parsed once, by trying every form; the dictionary is kept as a table and only
values that it does not hold yet are parsed when it is extended. What a value means is stored
without its context (an instant, a day, a distance, a month and day), so that the dictionary
serves every row; joined back, the row's own seen-at instant completes it.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernmill.functions.lookalikes import LOOKALIKES
from fernmill.session import delete_path, materialise, path_exists, scratch, spread
from fernmill.sources.store import Conflict, Pointer

DEFAULT_ZONE = "Asia/Seoul"
#: Values older than this many days before they were seen, and deadlines further ahead, mean nothing.
MOST_DAYS_AGO, MOST_DAYS_AHEAD = 9999, 365
#: A value that holds at least one in so many rows is joined by broadcast; there are at most so many.
HOT_SHARE = 1000

MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jän": 1, "jänner": 1, "feb": 2, "february": 2, "februar": 2, "mar": 3, "march": 3, "mär": 3, "märz": 3, "mrz": 3, "maerz": 3,
    "apr": 4, "april": 4, "may": 5, "mai": 5, "jun": 6, "june": 6, "juni": 6, "jul": 7, "july": 7, "juli": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "okt": 10, "oktober": 10, "nov": 11, "november": 11, "dec": 12, "december": 12, "dez": 12, "dezember": 12,
}
#: Zone abbreviations in minutes from UTC; fixed values.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "kst": 540, "jst": 540, "ict": 420, "edt": -240, "est": -300, "cdt": -300, "cst": -360, "mdt": -360, "mst": -420, "pdt": -420, "pst": -480,
    "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "bst": 60, "wet": 0, "west": 60, "eet": 120, "eest": 180,
}
_MONTH = r"(?P<mon>" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?"
_TIME = r"(?P<h>\d{1,2})\s*:\s*(?P<mi>\d{2})(?:\s*:\s*(?P<s>\d{2})(?:[.,]\d+)?)?(?:\s*(?P<ap>am|pm|a\.m\.|p\.m\.)(?![a-z]))?"
_KTIME = r"(?:(?P<kap>오전|오후)\s*)?(?P<h>\d{1,2})\s*(?:시\s*(?:(?P<mi>\d{1,2})\s*분)?(?:\s*(?P<s>\d{1,2})\s*초)?|:\s*(?P<mi2>\d{2})(?:\s*:\s*(?P<s2>\d{2})(?:[.,]\d+)?)?)"
_AT = rf"(?:\s*(?:t|,|um|at|\s)\s*(?:{_TIME}|{_KTIME.replace('?P<h>', '?P<kh>').replace('?P<mi>', '?P<kmi>').replace('?P<s>', '?P<ks>')}))?"
_ZONE = r"(?:\s*\(?(?P<zone>z|utc|gmt|[a-z]{2,4}t|mez|mesz|[a-z]+(?:/[a-z_+\-0-9]+)+|(?:utc|gmt)?\s*[+-]\d{2}:?\d{2})\)?)?"
_END = rf"{_AT}(?:\s*uhr)?{_ZONE}$"
_WEEKDAY = r"(?:\s*\(?[월화수목금토일](?:요일)?\)?)?"

#: Forms of a day with a year, each with an optional time and zone.
FORMS = [
    re.compile(rf"^(?P<y>\d{{4}})\s*[-./]\s*(?P<m>\d{{1,2}})\s*[-./]\s*(?P<d>\d{{1,2}})\.?{_WEEKDAY}{_END}"),
    re.compile(rf"^(?P<y>\d{{4}}|\d{{2}})\s*년\s*(?P<m>\d{{1,2}})\s*월\s*(?P<d>\d{{1,2}})\s*일{_WEEKDAY}{_END}"),
    re.compile(rf"^(?P<a>\d{{1,2}})\s*(?P<sep>[-./])\s*(?P<b>\d{{1,2}})\s*[-./]\s*(?P<y>\d{{4}}){_END}"),
    re.compile(rf"^(?P<p>\d{{2}})\s*(?P<sep>[-./])\s*(?P<q>\d{{1,2}})\s*[-./]\s*(?P<r>\d{{2}}){_WEEKDAY}{_END}"),
    re.compile(rf"^{_MONTH}\s*(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s*(?P<y>\d{{4}}){_END}"),
    re.compile(rf"^(?:[a-zä]{{2,9}}\.?,?\s+)?(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th)?\s*{_MONTH},?\s*(?P<y>\d{{4}}){_END}"),
    re.compile(rf"^(?:[a-z]{{2,9}},?\s+){_MONTH}\s*(?P<d>\d{{1,2}}),?\s*(?P<y>\d{{4}}){_END}"),
    re.compile(rf"^(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:\s*t?\s*(?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,]\d+)?)?)?{_ZONE}$"),
]
NOISE = re.compile(r"등록일|수정일|게시일|작성일|등록|수정|게시|작성|posted(?:\s+on)?|updated(?:\s+on)?|created|modified|stand|aktualisiert|veröffentlicht|đăng|cập nhật", re.I)
JUST_NOW = re.compile(r"^(?:방금(?:\s*전)?|지금|just now|now|gerade eben|soeben|eben|vừa xong)$")
YESTERDAY = re.compile(r"^(?:어제|yesterday|gestern|hôm qua)$")
AGO = [
    re.compile(r"^(?P<n>\d+)\s*(?P<u>초|분|시간|일|주)\s*전$"),
    re.compile(r"^(?P<n>\d+|an?|one)\s*(?P<u>sec|second|min|minute|hour|hr|day|week)s?\s+ago$"),
    re.compile(r"^vor\s+(?P<n>\d+|einer|einem)\s*(?P<u>sekunde|minute|stunde|tag|woche)(?:n|en|e)?$"),
    re.compile(r"^(?P<n>\d+)\s*(?P<u>giây|phút|giờ|ngày|tuần)\s+trước$"),
]
UNIT_SECONDS = {
    "초": 1, "분": 60, "시간": 3600, "일": 86400, "주": 604800, "sec": 1, "second": 1, "min": 60, "minute": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800,
    "sekunde": 1, "stunde": 3600, "tag": 86400, "woche": 604800, "giây": 1, "phút": 60, "giờ": 3600, "ngày": 86400, "tuần": 604800,
}
OPEN_ENDED = re.compile(r"상시|수시|채용\s*시|미정|rolling|until filled|open until|laufend|ongoing|없음")
MARK_BEFORE = re.compile(r"^(?:~|closes|closing|until|bis|by|ends|endet|deadline|hạn|마감일?)\s*:?\s*(?:am|on|zum)?\s*(?=[\da-zä])")
MARK_AFTER = re.compile(r"\s*(?:\d{1,2}\s*시\s*)?(?:마감|까지|접수\s*마감)$")
D_DAY = re.compile(r"^d\s*-\s*(?:(?P<n>\d+)|day)(?:\s+\d{1,2}:\d{2})?$")
AHEAD = [
    (re.compile(r"^(?:모레)\s*(?:\d{1,2}시)?\s*(?:마감|까지)?$"), 2),
    (re.compile(r"^(?:내일)\s*(?:\d{1,2}시)?\s*(?:마감|까지)?$|^(?:closes|ends|until|due)?\s*tomorrow$|^(?:endet|bis)?\s*morgen$"), 1),
    (re.compile(r"^(?:오늘)\s*(?:\d{1,2}시)?\s*(?:마감|까지)?$|^(?:closes|ends|until|due)?\s*today$|^(?:endet|bis)?\s*heute$|^\d{1,2}시\s*마감$|^당일\s*마감$"), 0),
]
MONTH_DAY = re.compile(r"^(?P<a>\d{1,2})\s*(?:[./-]|월)\s*(?P<b>\d{1,2})\s*일?\.?" + _WEEKDAY + r"(?:\s*\d{1,2}\s*(?::\s*\d{2}|시(?:\s*\d{1,2}분)?))?$")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_FOREIGN = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")
_LATIN = str.maketrans({k: v for k, v in LOOKALIKES.items()})


def clean(raw: str) -> str:
    """Lower case, ordinary widths, spaces and letters, no invisible characters."""
    if not raw.isascii():
        raw = unicodedata.normalize("NFKC", _HIDDEN.sub("", raw))
        if _FOREIGN.search(raw):
            raw = raw.translate(_LATIN)
        raw = raw.replace("–", "-").replace("—", "-").replace("−", "-").replace("‐", "-").replace("‑", "-").replace("〜", "~").replace("∼", "~")
    return " ".join(raw.lower().split())


@lru_cache(maxsize=1024)
def zone_of(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def named_zone(text: str) -> timezone | ZoneInfo | None:
    """A zone written in a text; None for one that means nothing."""
    if text in ABBREVIATIONS:
        return timezone(timedelta(minutes=ABBREVIATIONS[text]))
    if m := re.fullmatch(r"(?:utc|gmt)?\s*([+-])(\d{2}):?(\d{2})", text):
        minutes = int(m[2]) * 60 + int(m[3])
        return timezone(timedelta(minutes=-minutes if m[1] == "-" else minutes)) if minutes < 1440 else None
    if "/" in text:
        return zone_of("/".join("_".join(p.capitalize() for p in part.split("_")) for part in text.split("/")))
    return None


def day_first(zone: str | None) -> bool:
    return not (zone or "").startswith("America/")


def _fields(text: str, zone: str | None):
    """(year, month, day, has time, hour, minute, second, zone or None) or None, for a text that is a day with a year."""
    for form in FORMS:
        m = form.match(text)
        if not m:
            continue
        g = m.groupdict()
        if g.get("p"):  # two-digit year: at the end where the country writes it there
            p, q, r = int(g["p"]), int(g["q"]), int(g["r"])
            first = (zone or DEFAULT_ZONE) in ("Asia/Seoul", "Asia/Tokyo", "Asia/Shanghai", "Asia/Taipei")
            y, mo, d = (2000 + p, q, r) if first else (2000 + r, q, p) if day_first(zone) else (2000 + r, p, q)
        elif g.get("a"):
            a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
            mo, d = (b, a) if g["sep"] == "." or day_first(zone) and zone != DEFAULT_ZONE else (a, b)
        else:
            y, d = int(g["y"]), int(g["d"])
            mo = MONTHS[g["mon"]] if g.get("mon") else int(g["m"])
            if y < 100:
                y += 2000
        h = g.get("h") or g.get("kh")
        mi, s = g.get("mi") or g.get("kmi") or g.get("mi2"), g.get("s") or g.get("ks") or g.get("s2")
        hour = int(h) if h else 0
        half = g.get("ap") or g.get("kap")
        if half:
            if not 0 <= hour <= 12 and g.get("ap"):
                return None
            late = half in ("오후", "pm", "p.m.")
            hour = hour % 12 + 12 * late if hour <= 12 else hour
        z = None
        if g.get("zone"):
            z = named_zone(g["zone"])
            if z is None:
                return None
        return y, mo, d, bool(h), hour, int(mi or 0), int(s or 0), z
    return None


def _instant(f, zone: str | None) -> datetime | None:
    y, mo, d, _, h, mi, s, z = f
    z = z or zone_of(zone)
    extra = timedelta(days=1) if (h, mi, s) == (24, 0, 0) else timedelta(0)
    try:
        # of a wall time that stands twice the earlier instant; one skipped moves on by the gap
        local = datetime(y, mo, d, 0 if extra else h, mi, s) + extra
        return local.replace(tzinfo=z).astimezone(timezone.utc) if z else None
    except (ValueError, OverflowError):
        return None


def _epoch(text: str) -> datetime | None:
    if not text.isdigit() or len(text) not in (10, 13, 16):
        return None
    return datetime.fromtimestamp(int(text) // 10 ** (len(text) - 10), timezone.utc)


def parse_instant(raw: str, zone: str | None) -> tuple[str, int] | None:
    """('instant', epoch second) or ('ago', seconds) of a text, None if it means neither."""
    text = clean(raw)
    if (at := _epoch(text)) is not None:
        return "instant", int(at.timestamp())
    text = NOISE.sub(" ", text)
    text = " ".join(text.replace("(", " ").replace(")", " ").split()).strip(" :")
    if not text:
        return None
    if JUST_NOW.match(text):
        return "ago", 0
    if YESTERDAY.match(text):
        return "ago", 86400
    for form in AGO:
        if m := form.match(text):
            n = int(m["n"]) if m["n"].isdigit() and len(m["n"]) < 12 else 1 if not m["n"].isdigit() else None
            if n is None or (seconds := n * UNIT_SECONDS[m["u"]]) > MOST_DAYS_AGO * 86400:
                return None
            return "ago", seconds
    f = _fields(text, zone)
    at = f and _instant(f, zone)
    return ("instant", int(at.timestamp())) if at else None


def parse_deadline(raw: str, zone: str | None) -> tuple[str, int] | None:
    """('day', days since 1970), ('ahead', days) or ('month_day', 100 month + day), or None."""
    text = clean(raw)
    epoch_day = lambda d: ("day", (d - date(1970, 1, 1)).days)
    if (at := _epoch(text)) is not None:
        return epoch_day(at.astimezone(z).date()) if (z := zone_of(zone)) else None
    if m := D_DAY.match(text):
        n = int(m["n"]) if m["n"] and len(m["n"]) < 6 else 0 if not m["n"] else MOST_DAYS_AHEAD + 1
        return ("ahead", n) if n <= MOST_DAYS_AHEAD else None
    for form, n in AHEAD:
        if form.match(text):
            return "ahead", n
    if not any(c.isdigit() for c in text):
        return None
    marked = bool(MARK_BEFORE.match(text) or MARK_AFTER.search(text))
    bare = MARK_AFTER.sub("", MARK_BEFORE.sub("", text)).strip()
    if (f := _fields(bare, zone)) is not None:
        if f[7] is not None:  # an instant: its day at the site
            at, z = _instant(f, zone), zone_of(zone)
            return epoch_day(at.astimezone(z).date()) if at and z else None
        try:
            datetime(f[0], f[1], f[2], 0 if f[4] == 24 else f[4], f[5], f[6])
            return epoch_day(date(f[0], f[1], f[2]))
        except ValueError:
            return None
    if marked and not OPEN_ENDED.search(text) and (m := MONTH_DAY.match(bare)):
        a, b = int(m["a"]), int(m["b"])
        korean = "월" in bare or zone in (None, DEFAULT_ZONE) or not day_first(zone)
        mo, d = (a, b) if korean else (b, a)
        try:
            date(2024, mo, d)  # a leap year: the 29th of February exists in some year
            return "month_day", mo * 100 + d
        except ValueError:
            return None
    return None


class ValueDictionary:
    """The distinct raw values and what they mean, kept as a table that only grows.

    Each delivery's new values are a folder of their own; which folders count is a version, moved
    once the folder is whole.
    """

    SCHEMA = "kind string, raw string, zone string, means string, value bigint, batch int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or scratch(spark, "instants")).rstrip("/")
        self.pointer = Pointer(spark, self.path)

    def table(self) -> DataFrame:
        _, of = self.pointer.read()
        if not of.get("folders"):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{f}" for f in of["folders"]])

    def extend(self, values: DataFrame) -> DataFrame:
        """Parse the values (kind, raw, zone) that are not in the table yet and add them.

        Returns the distinct values of this delivery with their number of ``rows``. If another
        run adds values meanwhile, what is missing still is added after it.
        """
        counted = materialise(values.where("raw is not null").groupBy("kind", "raw", "zone").agg(F.count("*").alias("rows")), "instant-values")
        while True:
            try:
                self._add(counted)
                return counted
            except Conflict:
                continue

    def _add(self, counted: DataFrame) -> None:
        v, of = self.pointer.read()
        if not all(path_exists(self.spark, f"{self.path}/{f}") for f in of.get("folders", ())):
            delete_path(self.spark, self.path)  # someone cleaned the folder in part: what is left is of no use
            v, of = 0, {}
        distinct = counted.select("kind", "raw", "zone")
        if v:
            known = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{f}" for f in of["folders"]])
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("kind", "raw", "zone")]
            distinct = distinct.alias("n").join(known.alias("k"), same, "left_anti")
            if distinct.isEmpty():
                return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds, raws, zones = (b.column(i).to_pylist() for i in range(3))
                found = [(parse_deadline if k == "deadline" else parse_instant)(r, z) or (None, None) for k, r, z in zip(kinds, raws, zones)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())],
                    names=[*b.schema.names, "means", "value"],
                )

        folder = f"values-{uuid.uuid4().hex[:12]}"
        parsed = (distinct if v else spread(distinct)).mapInArrow(run, "kind string, raw string, zone string, means string, value bigint")
        parsed.withColumn("batch", F.lit(v)).write.parquet(f"{self.path}/{folder}")
        self.pointer.move(v + 1, {"folders": [*of.get("folders", []), folder]})
        self.pointer.forget(2)

    def join(self, rows: DataFrame, counted: DataFrame, row_key: str) -> DataFrame:
        """The rows (with kind, raw, zone) with ``means`` and ``value``; rows that mean nothing drop out.

        A value that holds a thousandth of all rows or more is looked up by broadcast (there
        can be no more than a thousand of them); its rows take no part in the shuffle join's
        skew, as they go to it under keys of their own.
        """
        of = ["kind", "raw", "zone"]
        total = counted.agg(F.sum("rows")).first()[0] or 0
        held = counted.where(F.col("rows") * HOT_SHARE >= F.lit(max(total, HOT_SHARE))).select(*of)
        values = self.table()
        hot = values.join(F.broadcast(held), of, "left_semi").select(*of, F.struct("means", "value").alias("hot"))
        cold = values.join(F.broadcast(held), of, "left_anti").where("means is not null").select(F.concat_ws("\x01", "kind", "zone", "raw").alias("_key"), F.struct("means", "value").alias("cold"))
        near = rows.where("raw is not null").join(F.broadcast(hot), of, "left")
        own = F.when(F.col("hot").isNotNull(), F.concat(F.lit("\x02"), F.col(row_key).cast("string"))).otherwise(F.concat_ws("\x01", "kind", "zone", "raw"))
        both = near.withColumn("_key", own).join(cold, "_key", "left")
        meant = F.coalesce("hot", "cold")
        return both.select(*[c for c in rows.columns if c != "raw"], meant["means"].alias("means"), meant["value"].alias("value")).where("means is not null")


def known_zone(c: Column) -> Column:
    """The zone, Seoul for none; null for a name that is no zone."""
    return F.when(c.isNull(), DEFAULT_ZONE).when(c.isin(sorted(available_timezones())), c)


def utc(second: Column) -> Column:
    """The wall time in UTC of an epoch second, whatever the session's zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))


def next_month_day(month_day: Column, day: Column) -> Column:
    """The first such day not earlier than 30 days before ``day``; leap days wait for their year."""
    least = F.date_sub(day, 30)
    month, d = F.floor(month_day / 100).cast("int"), (month_day % 100).cast("int")
    year = F.year(least)
    # a leap year comes within eight years; one expression for all tries keeps the code small
    first = F.filter(
        F.transform(F.sequence(year, year + 8), lambda y: F.make_date(y, month, F.lit(1))), lambda m: (F.dayofmonth(F.last_day(m)) >= d) & (F.date_add(m, d - 1) >= least)
    )
    return F.date_add(F.get(first, F.lit(0)), d - 1)


def normalised(list_item: DataFrame, posting: DataFrame, dictionary: ValueDictionary | None = None) -> DataFrame:
    """(field, row_key, norm) of the deadline, posted and modified texts that mean something.

    Null, open-ended, impossible and meaningless texts give no row; a null or unknown seen-at
    instant leaves relative texts without one; an unknown zone leaves local texts without one.
    """
    spark = list_item.sparkSession
    dictionary = dictionary or ValueDictionary(spark)
    item = list_item.select("item_id", "deadline_text", "posted_text", "seen_at", known_zone(F.col("site_tz")).alias("zone"))
    texts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_text").alias("raw")) for k in ("deadline", "posted")]))
    items = item.select(F.col("item_id").alias("row_key"), texts.alias("t"), F.coalesce("zone", F.lit("?")).alias("zone"), "seen_at").select("row_key", "t.kind", "t.raw", "zone", "seen_at")
    posts = posting.select(
        F.col("row_id").alias("row_key"), F.lit("modified").alias("kind"), F.col("list_modified_at").alias("raw"), F.lit(DEFAULT_ZONE).alias("zone"), F.timestamp_seconds(F.datediff("snap_on", F.lit("1970-01-01").cast("date")) * 86400).alias("seen_at")
    )
    rows = items.unionByName(posts).where(F.col("raw").isNotNull() & F.col("row_key").isNotNull())
    counted = dictionary.extend(rows.select("kind", "raw", "zone"))
    # the day at the site is worked out once, before the forms of a meaning are told apart
    zone = F.when(F.col("zone") != "?", F.col("zone"))
    found = dictionary.join(rows, counted, "row_key").withColumn("seen_day", F.when(F.col("kind") == "deadline", F.to_date(F.convert_timezone(F.lit("UTC"), zone, utc(F.floor(F.unix_micros("seen_at") / 1_000_000))))))

    seen_s = F.floor(F.unix_micros("seen_at") / 1_000_000).cast("bigint")
    second = F.when(F.col("means") == "instant", F.col("value")).when((F.col("means") == "ago") & (F.col("kind") == "posted"), seen_s - F.col("value"))
    fresh = F.col("seen_at").isNull() | (seen_s - second <= MOST_DAYS_AGO * 86400)
    instant = F.when(fresh, F.date_format(utc(second), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    seen_day = F.col("seen_day")
    day = (
        F.when(F.col("means") == "day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("value").cast("int")))
        .when(F.col("means") == "ahead", F.date_add(seen_day, F.col("value").cast("int")))
        .when(F.col("means") == "month_day", next_month_day(F.col("value"), seen_day))
    )
    recent = seen_day.isNull() | (F.datediff(seen_day, day) <= MOST_DAYS_AGO)
    norm = F.when(F.col("kind") == "deadline", F.when(recent, F.date_format(day, "yyyy-MM-dd"))).otherwise(instant)
    return found.select(F.col("kind").alias("field"), "row_key", norm.alias("norm")).where("norm is not null")
