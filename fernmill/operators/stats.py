"""Weighted shares and ranks of skills within jobs, in exact arithmetic.

A posting that hangs under k jobs counts 1/k in each. The weights are integers (a common
multiple of all k that occur, divided by k), so that equal sums are equal and every engine
ranks alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The unit of weight for up to 20 jobs a posting; where more occur, their common multiple is taken.
UNIT = math.lcm(*range(1, 21))
#: The greatest unit whose sums over 10^13 postings are exact in 38 digits.
MOST_UNIT = 10**25


def half_up_ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole rounded half up, as a decimal; both are exact integers."""
    wide = lambda c: c.cast("decimal(38,0)")
    tens = 10**places
    units = F.floor((wide(part) * (2 * tens) + wide(whole)) / (wide(whole) * 2))
    return (units.cast("decimal(20,0)") / F.lit(tens).cast("decimal(10,0)")).cast(f"decimal({places + 1},{places})")


def base_postings(posting: DataFrame, posting_skill: DataFrame, skill: DataFrame) -> DataFrame:
    """Open postings with details and at least one active skill."""
    active = posting_skill.join(skill.where("is_active = 1").select("skill_id"), "skill_id", "left_semi").select("posting_id")
    return posting.where("is_closed = 0 and detail_at is not null and is_excluded = 0").select("posting_id").join(active, "posting_id", "left_semi")


def job_skill_stat(posting: DataFrame, posting_job: DataFrame, posting_skill: DataFrame, skill: DataFrame) -> DataFrame:
    """(job, skill_id, posting_cnt, job_total, ratio, rank_no); ranks are unique in a job.

    Repeated links and null ids count once and never. A job without counting postings has no row.
    """
    base = base_postings(posting, posting_skill, skill)
    links = posting_job.where("posting_id is not null and job is not null").select("posting_id", "job").distinct().join(base, "posting_id", "left_semi")
    counted = links.withColumn("k", F.count("*").over(Window.partitionBy("posting_id")))
    # numbers of jobs that occur, few in all
    odd = [r[0] for r in posting_job.where("posting_id is not null and job is not null").groupBy("posting_id").agg(F.countDistinct("job").alias("k")).where("k > 20").select("k").distinct().collect()]
    unit = math.lcm(UNIT, *odd)
    if unit > MOST_UNIT:
        raise OverflowError(f"numbers of jobs of a posting up to {max(odd)} have no common unit of 25 digits")
    exact = F.lit(str(unit)).cast("decimal(26,0)")
    weight = (exact / F.col("k").cast("decimal(10,0)")).cast("decimal(26,0)") if odd else F.floor(F.lit(UNIT) / F.col("k")).cast("bigint")
    weighted = counted.select("posting_id", "job", weight.alias("w"))
    total = weighted.groupBy("job").agg(F.count("*").alias("job_total"), F.sum("w").alias("whole"))
    skills = (
        posting_skill.where("posting_id is not null").join(skill.where("is_active = 1").select("skill_id"), "skill_id", "left_semi")
        .select("posting_id", "skill_id").distinct()
    )
    each = weighted.join(skills, "posting_id").groupBy("job", "skill_id").agg(F.count("*").alias("posting_cnt"), F.sum("w").alias("part"))
    rank = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("part"), F.desc("posting_cnt"), "skill_id"))
    return each.join(total, "job").select("job", "skill_id", "posting_cnt", "job_total", half_up_ratio(F.col("part"), F.col("whole")).alias("ratio"), rank.cast("bigint").alias("rank_no"))


def top_of_latest(stat: DataFrame, skill: DataFrame, n: int = 20) -> DataFrame:
    """The stored statistic's rows of the latest day up to rank ``n``, with the skill's name."""
    last = stat.agg(F.max("calc_date").alias("calc_date"))
    return (
        stat.where((F.col("rank_no") <= n) & (F.col("rank_no") >= 1)).join(F.broadcast(last), "calc_date", "left_semi").join(skill, "skill_id")
        .select("calc_date", "job_id", "rank_no", F.col("name").alias("skill"), "category", "posting_cnt", "job_total", "ratio")
    )


def replace_day(old: DataFrame, new: DataFrame) -> DataFrame:
    """The stored statistic after one day's rows are replaced by new ones."""
    days = new.select("calc_date").distinct()
    return old.join(days, "calc_date", "left_anti").unionByName(new)
