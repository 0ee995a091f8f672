"""Ways to run the engine: all stages over stored documents, or the report alone."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from fernmill import core_queries, session
from fernmill.operators import report
from fernmill.plans.run import Runner
from fernmill.sources.store import VersionedTable

#: The parts of the report by the query that makes each.
REPORT = {
    "totals": "report_totals", "jobs": "report_jobs", "top_skills": "stat_top20", "sources": "report_sources", "categories": "report_categories", "careers": "report_careers", "deadlines": "report_deadlines",
    "text_only": "report_text_only", "runs": "report_runs",
}


def wall_clock() -> datetime:
    """The wall time in Seoul, by which runs are dated."""
    return (datetime.now(timezone.utc) + timedelta(hours=9)).replace(tzinfo=None)


def report_parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    queries = core_queries.queries()
    return {part: queries[name](spark, d) for part, name in REPORT.items()}


def report_file(spark: SparkSession, d: str, path: str) -> None:
    """Write the report of a data directory as one JSON file; nothing else is changed."""
    try:
        report.export(report_parts(spark, d), path)
    finally:
        session.release(spark)


def local_run(spark: SparkSession, d: str, out: str, clock: Callable[[], datetime] = wall_clock) -> int:
    """Match skills in stored documents, make the statistic and the report, without fetching; returns the run's number.

    Results are table versions under ``out``; the run is entered in its ledger and holds the lease.
    """
    queries = core_queries.queries()

    def stored(name: str, query: str) -> Callable[[], None]:
        def stage() -> None:
            VersionedTable(spark, f"{out}/{name}").commit(queries[query](spark, d))
            session.release(spark)

        return stage

    stages = [
        ("match", stored("posting_skill", "match_raw_skills")),
        ("statistic", stored("job_skill_stat", "job_skill_stat")),
        ("report", lambda: report_file(spark, d, os.path.join(out.removeprefix("file://"), "report.json"))),
    ]
    return Runner(spark, out).run(stages, clock)
