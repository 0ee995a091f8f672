"""Summary counts of postings, skills and runs; each a small table from one pass or a few."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

OPEN = "is_closed = 0"
#: Careers open to newcomers, and the label of a missing career.
NEWCOMER, NO_CAREER = ("NEW", "NEW_OR_EXP", "ANY"), "(없음)"


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("int")), F.lit(0)).cast("bigint")


def flagged(posting: DataFrame, posting_skill: DataFrame, skill: DataFrame) -> DataFrame:
    """The postings with ``has_skill``: whether one of their skills is active."""
    active = posting_skill.join(skill.where("is_active = 1").select("skill_id"), "skill_id", "left_semi").select("posting_id").distinct()
    return posting.join(active.withColumn("has_skill", F.lit(True)), "posting_id", "left").withColumn("has_skill", F.coalesce("has_skill", F.lit(False)))


def totals(posting: DataFrame, company: DataFrame, posting_job: DataFrame, posting_skill: DataFrame, skill: DataFrame) -> DataFrame:
    """One row of thirteen counters; each source is read once."""
    p = flagged(posting, posting_skill, skill)
    is_open, detail = F.col("is_closed") == 0, F.col("detail_at").isNotNull()
    of_posting = p.agg(
        F.count("*").alias("postings"),
        _count_if(is_open).alias("open_postings"),
        _count_if(is_open & detail).alias("with_detail"),
        _count_if(is_open & ~detail & (F.col("detail_fail_cnt") > 0)).alias("fail_now"),
        _count_if(is_open & (F.col("detail_fail_cnt") >= 3)).alias("fail_resting"),
        _count_if(is_open & detail & ~F.col("has_skill")).alias("no_skill"),
        _count_if(is_open & (F.col("is_excluded") == 1)).alias("excluded"),
        _count_if(is_open & detail & (F.col("is_excluded") == 0) & F.col("has_skill")).alias("stat_base"),
    )
    of_company = company.agg(F.count("*").alias("companies"))
    of_links = posting_job.join(posting.where(OPEN).select("posting_id"), "posting_id", "left_semi").agg(F.count("*").alias("posting_jobs"))
    of_skill = skill.agg(_count_if(F.col("is_active") == 1).alias("skills"))
    seen = posting_skill.join(skill.where("is_active = 1").select("skill_id"), "skill_id", "left_semi").agg(F.countDistinct("skill_id").alias("skills_seen"))
    all_links = posting_skill.agg(F.count("*").alias("posting_skills"))
    out = of_posting
    for one_row in (of_company, of_links, of_skill, seen, all_links):
        out = out.crossJoin(F.broadcast(one_row))  # each side is one row
    return out


def jobs(posting: DataFrame, posting_job: DataFrame, posting_skill: DataFrame, skill: DataFrame) -> DataFrame:
    """Counts of the open postings of each job; a job without open postings has zeros."""
    links = posting_job.select("posting_id", "job").where("job is not null").distinct()
    alone = links.groupBy("posting_id").agg(F.count("*").alias("k"))
    p = flagged(posting.where(OPEN), posting_skill, skill).join(alone, "posting_id", "left")
    cols = p.select("posting_id", "detail_at", "is_headhunting", "career_type", "is_excluded", "has_skill", "k", F.lit(True).alias("here"))
    j = links.join(cols, "posting_id", "left")
    detail, counted = F.col("detail_at").isNotNull(), F.col("detail_at").isNotNull() & (F.col("is_excluded") == 0) & F.col("has_skill")
    return j.groupBy("job").agg(
        _count_if(F.col("here")).alias("open_postings"),
        _count_if(detail).alias("with_detail"),
        _count_if(F.col("is_headhunting") == 1).alias("headhunting"),
        _count_if(F.col("career_type").isin(*NEWCOMER)).alias("newcomer_ok"),
        _count_if(detail & ~F.col("has_skill")).alias("no_skill"),
        _count_if(F.col("here") & (F.col("k") == 1)).alias("only_this_job"),
        _count_if(F.col("is_excluded") == 1).alias("excluded"),
        _count_if(counted).alias("stat_base"),
        _count_if(counted & (F.col("k") == 1)).alias("only_this_job_base"),
    )


def sources(posting_skill: DataFrame) -> DataFrame:
    return posting_skill.groupBy("source").agg(F.count("*").alias("cnt"), F.countDistinct("posting_id").alias("postings"))


def categories(posting_skill: DataFrame, skill: DataFrame) -> DataFrame:
    return posting_skill.join(skill, "skill_id").groupBy("category").agg(F.countDistinct("posting_id").alias("postings"), F.countDistinct("skill_id").alias("skills"))


def careers(posting: DataFrame) -> DataFrame:
    kind = F.coalesce("career_type", F.lit(NO_CAREER)).alias("career_type")
    return posting.where(f"{OPEN} and detail_at is not null").groupBy(kind).agg(F.count("*").alias("cnt"))


def deadlines(posting: DataFrame) -> DataFrame:
    return posting.where(OPEN).groupBy("deadline_type").agg(F.count("*").alias("cnt"))


def text_only(posting: DataFrame, posting_skill: DataFrame, skill: DataFrame, n: int = 20) -> DataFrame:
    """Skills without a code by the open postings whose text names them; ties go by name."""
    named = posting_skill.where(F.col("source").isin("REQUIRED", "PREFERRED")).join(posting.where(OPEN).select("posting_id"), "posting_id", "left_semi")
    by = named.join(skill.where("saramin_code is null"), "skill_id").groupBy(F.col("name").alias("skill")).agg(F.countDistinct("posting_id").alias("postings"))
    return by.orderBy(F.desc("postings"), "skill").limit(n)


def last_runs(deliveries: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` deliveries with their counts."""
    runs = deliveries.groupBy("snap_no").agg(
        F.max("snap_on").alias("snap_on"), F.count("*").alias("list_cnt"), F.countDistinct("posting_id").alias("postings"), _count_if(F.col("is_closed") == 1).alias("closed_cnt")
    )
    return runs.orderBy(F.desc("snap_no")).limit(n)


def _plain(v):  # type: ignore[no-untyped-def]
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    return float(v) if isinstance(v, Decimal) else v


def export(parts: dict[str, DataFrame], path: str) -> None:
    """Write tables as one JSON document with lower-case names; a part named totals is one object.

    All rows are written, one by one, whatever their number.
    """
    line = lambda r: {k.lower(): _plain(v) for k, v in r.asDict().items()}
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for n, (name, df) in enumerate(parts.items()):
            f.write(f"{',' if n else ''}\n  {json.dumps(name, ensure_ascii=False)}: ")
            if name == "totals":
                one = df.first()
                f.write(json.dumps(line(one) if one else None, ensure_ascii=False))
                continue
            f.write("[")
            for k, r in enumerate(df.toLocalIterator()):
                f.write(f"{',' if k else ''}\n    {json.dumps(line(r), ensure_ascii=False)}")
            f.write("]")
        f.write("\n}\n")
