"""The stored tables' columns by version, and rows of an older version brought to a newer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Columns of the state tables as first laid down, then those that later versions add with what old rows have in them.
FIRST = {
    "posting": "posting_id bigint, company_id bigint, title string, url string, career_type string, exp_min int, exp_max int, education string, employment_type string, region string, posted_on date, "
    "deadline_type string, deadline_on date, is_headhunting int, is_mass_hiring int, is_closed int, is_excluded int, closed_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
    "list_modified_at timestamp_ntz, detail_at timestamp_ntz, detail_fail_cnt int",
    "posting_job": "posting_id bigint, job_id bigint",
    "skill": "skill_id bigint, saramin_code int, name string, category string",
    "crawl_run": "run_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string, list_complete int, list_cnt bigint, new_cnt bigint, closed_cnt bigint, fail_cnt bigint, note string",
}
ADDED = [
    {"posting": {"raw_deleted_at": ("timestamp_ntz", None)}, "posting_job": {"last_seen_at": ("timestamp_ntz", None)}, "skill": {"is_active": ("int", 1)}, "crawl_run": {"heartbeat_at": ("timestamp_ntz", None)}},
]
LATEST = 1 + len(ADDED)


def columns(table: str, version: int = LATEST) -> dict[str, tuple[str, object]]:
    """name -> (type, value of rows written before the column was there) of a table at a version."""
    out: dict[str, tuple[str, object]] = {}
    for c in FIRST[table].split(","):
        name, kind = c.split()
        out[name] = (kind, None)
    for step in ADDED[: version - 1]:
        out |= step.get(table, {})
    return out


def migrated(df: DataFrame, table: str, version: int = LATEST) -> DataFrame:
    """Rows of any older version as those of ``version``: missing columns are added with their value, others kept.

    Doing it twice changes nothing; columns that the table doesn't know stay at the end.
    """
    known = columns(table, version)
    there = [F.col(c).cast(k).alias(c) if c in df.columns else F.lit(v).cast(k).alias(c) for c, (k, v) in known.items()]
    return df.select(*there, *[c for c in df.columns if c not in known])
