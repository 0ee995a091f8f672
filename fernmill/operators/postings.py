"""The state of postings: lists, details and failures merged into it, each as one outer join.

Every function takes the state and what was seen and returns the whole next state; times are
given, never read from a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fernmill.functions import listtexts
from fernmill.functions.columns import cut, is_blank
from fernmill.operators.merge import newest

#: Lengths of texts as stored.
TITLE, EDUCATION, EMPLOYMENT, REGION = 300, 30, 50, 100
STATE = ["posting_id", "title", "deadline_type", "deadline_on", "detail_fail_cnt", "list_modified_at", "first_seen_at", "last_seen_at"]
SEOUL = 9 * 3600


def wall_time(second: Column) -> Column:
    """The wall time in Seoul of an epoch second."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (second + SEOUL).cast("decimal(18,6)"))


def stored_time(text: Column) -> Column:
    """A wall time written to the second; null for any other writing."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), text.try_cast("timestamp_ntz"))


def seen_in_lists(items: DataFrame) -> DataFrame:
    """One row a posting of list items, the last seen, with its texts as values.

    Needs item_id, posting_id, title, company_name, deadline_text, posted_text and seen_at; items
    without a posting or an instant are left out.
    """
    cols = ["item_id", "posting_id", "title", "company_name", "deadline_text", "posted_text", "seen_at"]
    one = newest(items.select(*cols).where("posting_id is not null and seen_at is not null"), ["posting_id"], ["seen_at", "item_id"])
    second = F.floor(F.unix_micros("seen_at") / 1_000_000).cast("bigint")
    today = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((second + SEOUL) / 86400).cast("int"))
    read = one.select("posting_id", "title", "company_name", second.alias("now_s"), listtexts.deadline(F.col("deadline_text"), today).alias("d"), listtexts.posted(F.col("posted_text"), second).alias("p"))
    return read.select(
        "posting_id",
        "title",
        (is_blank(F.col("title")) | is_blank(F.col("company_name"))).alias("blank"),
        F.col("d.type").alias("type"),
        F.col("d.date").alias("date"),
        F.col("d.unknown").alias("unknown"),
        F.when(F.col("p.modified"), wall_time(F.col("p.at_second"))).alias("modified_at"),
        F.coalesce(listtexts.tolerance_minutes(F.col("p.precision_second")), F.lit(60)).cast("int").alias("tolerance"),
        wall_time(F.col("now_s")).alias("now"),
    )


def list_upsert(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The state (STATE) after postings were seen in lists, with ``change``: kept, updated or inserted.

    Of a known posting a text that is not understood changes no deadline; a day that becomes an
    open end is cleared, else a later day replaces an earlier or missing one; a modification later
    than the stored one by more than the tolerance counts, and clears the failures. New postings
    with a blank title or company are not inserted.
    """
    s = state.select(*STATE, F.lit(True).alias("_old"))
    n = seen.select("posting_id", F.col("title").alias("_title"), "blank", "type", "date", "unknown", "modified_at", "tolerance", "now")
    both = s.join(n, "posting_id", "full").where(F.col("_old") | ~F.col("blank"))
    old, new = F.col("_old").isNotNull(), F.col("now").isNotNull()
    opened = ~F.col("unknown") & (F.col("type") != "DATE") & (F.col("deadline_type") == "DATE")
    later = F.col("date").isNotNull() & (F.col("deadline_on").isNull() | (F.col("deadline_on") < F.col("date")))
    limit = F.col("list_modified_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("tolerance"))
    fresh = F.coalesce(F.col("modified_at").isNotNull() & (F.col("list_modified_at").isNull() | (F.col("modified_at") > limit)), F.lit(False))
    at = lambda kept, changed, inserted: F.when(old & ~new, kept).when(old, changed).otherwise(inserted)
    c = F.col
    return both.select(
        "posting_id",
        at(c("title"), c("title"), cut(c("_title"), TITLE)).alias("title"),
        at(c("deadline_type"), F.when(c("unknown"), c("deadline_type")).otherwise(c("type")), c("type")).alias("deadline_type"),
        at(c("deadline_on"), F.when(opened, F.lit(None).cast("date")).when(later, c("date")).otherwise(c("deadline_on")), c("date")).alias("deadline_on"),
        at(c("detail_fail_cnt"), F.when(fresh, 0).otherwise(c("detail_fail_cnt")), F.lit(0)).cast("int").alias("detail_fail_cnt"),
        at(c("list_modified_at"), F.when(fresh, c("modified_at")).otherwise(c("list_modified_at")), c("modified_at")).alias("list_modified_at"),
        at(c("first_seen_at"), c("first_seen_at"), c("now")).alias("first_seen_at"),
        at(c("last_seen_at"), c("now"), c("now")).alias("last_seen_at"),
        F.when(old & ~new, "kept").when(old, "updated").otherwise("inserted").alias("change"),
    )


def link_upsert(links: DataFrame, seen: DataFrame) -> DataFrame:
    """The links (posting_id, job, last_seen_at) after pairs (posting_id, job, now) were seen: each once, with the last time."""
    now = seen.where("posting_id is not null and job is not null").select("posting_id", "job", F.col("now").alias("last_seen_at"))
    return links.select("posting_id", "job", "last_seen_at").unionByName(now).groupBy("posting_id", "job").agg(F.max("last_seen_at").alias("last_seen_at"))


def save_details(state: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """The state after detail pages (posting_id, page; one row each) were read; pages with an error change nothing.

    A detail's fields replace the stored ones, but for a deadline that it doesn't give; the
    posting counts as read and its failures are cleared.
    """
    of = lambda k: F.col("page.summary")[k]
    career = listtexts.career(of("경력"))
    d = details.where("page.error is null").select(
        "posting_id", career.alias("career"), cut(of("학력"), EDUCATION).alias("n_education"), cut(of("근무형태"), EMPLOYMENT).alias("n_employment"), cut(of("근무지역"), REGION).alias("n_region"),
        F.to_date("page.start_at").alias("n_posted"), F.to_date("page.end_at").alias("n_deadline"), F.lit(True).alias("_new"),
    )
    both = state.join(d, "posting_id", "left")
    new = F.col("_new").isNotNull()
    put = {
        "career_type": F.col("career.type"), "exp_min": F.col("career.exp_min"), "exp_max": F.col("career.exp_max"), "education": F.col("n_education"), "employment_type": F.col("n_employment"),
        "region": F.col("n_region"), "posted_on": F.col("n_posted"), "deadline_on": F.coalesce("n_deadline", "deadline_on"), "detail_at": now, "detail_fail_cnt": F.lit(0),
    }
    return both.select(*[F.when(new, put[c]).otherwise(F.col(c)).cast(state.schema[c].dataType).alias(c) if c in put else F.col(c) for c in state.columns])


def add_failures(state: DataFrame, failed: DataFrame) -> DataFrame:
    """The state with one failure more for each row of ``failed`` (posting_id)."""
    n = failed.where("posting_id is not null").groupBy("posting_id").agg(F.count("*").cast("int").alias("_n"))
    return state.join(n, "posting_id", "left").withColumn("detail_fail_cnt", F.coalesce("detail_fail_cnt", F.lit(0)) + F.coalesce("_n", F.lit(0))).select(*state.columns)


def forget_details(state: DataFrame, missing: DataFrame) -> DataFrame:
    """The state in which postings whose documents are missing (posting_id) wait for their details again."""
    gone = missing.where("posting_id is not null").select("posting_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull()
    both = state.join(gone, "posting_id", "left")
    put = {"detail_at": F.lit(None), "detail_fail_cnt": F.lit(0)}
    return both.select(*[F.when(hit, put[c]).otherwise(F.col(c)).cast(state.schema[c].dataType).alias(c) if c in put else F.col(c) for c in state.columns])
