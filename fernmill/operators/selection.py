"""Selections and guards on the state of postings: semi and anti joins, conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Tolerance of a complete list, share of missing rows that stops a run, and least sizes for that.
LIST_TOLERANCE, MISSING_IN_TEN, LEAST_ROWS, HALF_DROP_ROWS = 2, 10, 20, 20
MOST_FAILURES = 3


def current(deliveries: DataFrame, *columns: str) -> DataFrame:
    """The postings of the last delivery, one row each: the latest seen, then the greatest row.

    Only ``columns`` are read (all for none): an aggregate of whole rows prunes nothing.
    """
    last = deliveries.agg(F.max("snap_no").alias("snap_no"))
    rows = deliveries.where("posting_id is not null").join(F.broadcast(last), "snap_no", "left_semi")  # one row
    rest = [c for c in columns or rows.columns if c != "posting_id"]
    return rows.groupBy("posting_id").agg(F.max(F.struct("last_seen_at", "row_id", F.struct(*rest).alias("all"))).alias("m")).select("posting_id", "m.all.*")


def area_links(deliveries: DataFrame) -> DataFrame:
    """(posting_id, job, last_snap): the areas a posting was listed under, the first word of its region."""
    job = F.regexp_extract("region", r"^\s*(\S+)", 1)
    return deliveries.where("posting_id is not null and region is not null").groupBy("posting_id", job.alias("job")).agg(F.max("snap_no").alias("last_snap")).where("job != ''")


def open_per_job(posting: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(posting.where("is_closed = 0").select("posting_id"), "posting_id").groupBy("job").agg(F.count("*").alias("open_postings"))


def detail_targets(posting: DataFrame, n: int | None = None) -> DataFrame:
    """Open postings whose details are missing, or older than the modification in the list, and did not fail too often.

    The newest come first; with ``n`` so many of them.
    """
    wanted = F.col("detail_at").isNull() | (F.col("list_modified_at") > F.col("detail_at"))
    out = posting.where((F.col("is_closed") == 0) & (F.coalesce("detail_fail_cnt", F.lit(0)) < MOST_FAILURES) & wanted).select("posting_id").orderBy(F.desc("posting_id"))
    return out.limit(n) if n else out


def skill_targets(posting: DataFrame) -> DataFrame:
    return posting.where("is_closed = 0 and detail_at is not null").select("posting_id")


def list_complete(total: Column, seen: Column) -> Column:
    """Whether a list was read whole: its total is known and at most two postings are missing."""
    return F.coalesce(total.isNotNull() & (seen >= total - LIST_TOLERANCE) & (total > 0), F.lit(False))


def half_dropped(before: Column, seen: Column) -> Column:
    return (before >= HALF_DROP_ROWS) & (seen * 2 < before)


def too_many_missing(missing: Column, before: Column, least: int = 1) -> Column:
    return (before >= least) & (missing * MISSING_IN_TEN > before)


def missing_by_job(before: DataFrame, seen: DataFrame, links: DataFrame) -> DataFrame:
    """(job, missing, open_before, blocked): open postings of each job that the next delivery lacks."""
    was_open = before.where("is_closed = 0").select("posting_id").join(links.select("posting_id", "job"), "posting_id")
    gone = was_open.join(seen.select("posting_id").distinct().withColumn("there", F.lit(1)), "posting_id", "left")
    out = gone.groupBy("job").agg(F.count(F.when(F.col("there").isNull(), 1)).alias("missing"), F.count("*").alias("open_before"))
    return out.withColumn("blocked", too_many_missing(F.col("missing"), F.col("open_before"), LEAST_ROWS))


def missing_overall(before: DataFrame, seen: DataFrame) -> DataFrame:
    """One row (missing, open_before, blocked) over all postings."""
    was_open = before.where("is_closed = 0").select("posting_id")
    gone = was_open.join(seen.select("posting_id").distinct().withColumn("there", F.lit(1)), "posting_id", "left")
    out = gone.agg(F.count(F.when(F.col("there").isNull(), 1)).alias("missing"), F.count("*").alias("open_before"))
    return out.withColumn("blocked", too_many_missing(F.col("missing"), F.col("open_before")))


def stale_links(posting: DataFrame, links: DataFrame, last_snap: int) -> DataFrame:
    """(job, stale, links, blocked): links of seen postings that the last delivery did not confirm."""
    seen = links.join(posting.select("posting_id"), "posting_id", "left_semi")
    out = seen.groupBy("job").agg(F.count(F.when(F.col("last_snap") < last_snap, 1)).alias("stale"), F.count("*").alias("links"))
    return out.withColumn("blocked", too_many_missing(F.col("stale"), F.col("links"), LEAST_ROWS))


def drop_unconfirmed(links: DataFrame, stale: DataFrame, last_snap: int) -> DataFrame:
    """The links without the unconfirmed ones of jobs that are not blocked."""
    safe = stale.where("not blocked").select("job")
    gone = links.where(F.col("last_snap") < last_snap).join(safe, "job", "left_semi").select("posting_id", "job")
    return links.join(gone, ["posting_id", "job"], "left_anti")


def retention(posting: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """(posting_id, long_gone): closed postings older than the time their documents are kept."""
    limit = lambda d: now - F.make_dt_interval(F.lit(d))
    return posting.where((F.col("is_closed") == 1) & (F.col("closed_at") < limit(keep_days))).select("posting_id", (F.col("closed_at") < limit(keep_days + 30)).alias("long_gone"))


def of_jobs(links: DataFrame, jobs: list[str]) -> DataFrame:
    """The links of the jobs that a run is set up for."""
    return links.where(F.col("job").isin(jobs))


def code_map(dimension: DataFrame, code: str, key: str) -> dict[int, int]:
    """code -> key of a dimension, smallest keys first; a table of some hundred rows."""
    rows = dimension.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(key).alias("k")).limit(CODE_ROWS + 1).collect()
    if len(rows) > CODE_ROWS:
        raise ValueError(f"more than {CODE_ROWS} codes: join the dimension instead")
    return {r[0]: r["k"] for r in rows}


CODE_ROWS = 100_000
