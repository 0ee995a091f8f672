"""Runs: the ledger with its lease, and the order of the stages over versioned tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernmill.functions.columns import joined
from fernmill.sources.store import Conflict, VersionedTable

LEDGER = "run_id bigint, started_at timestamp_ntz, heartbeat_at timestamp_ntz, finished_at timestamp_ntz, status string, list_cnt bigint, new_cnt bigint, closed_cnt bigint, fail_cnt bigint, note string"
STALE_AFTER = timedelta(minutes=60)


class RunInProgress(RuntimeError):
    """Another run holds the lease."""


def reaped(ledger: DataFrame, now: Column) -> DataFrame:
    """The ledger with runs that gave no sign of life for an hour marked as failed."""
    stale = (F.col("status") == "RUNNING") & (F.coalesce("heartbeat_at", "started_at") < now - F.expr(f"INTERVAL {int(STALE_AFTER.total_seconds())} SECOND"))
    note = F.when(stale, joined(" · ", F.col("note"), F.lit("stale"))).otherwise(F.col("note"))
    return ledger.withColumn("note", note).withColumn("status", F.when(stale, "FAILED").otherwise(F.col("status")))


def run_note(*parts: str | None) -> str:
    return " · ".join(p for p in parts if p)


class Runner:
    """Runs named stages in order under a lease; every stage commits its own table version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.ledger = spark, VersionedTable(spark, f"{path}/ledger")

    def _rows(self) -> tuple[int, DataFrame]:
        """The ledger with the version that it is of."""
        v = self.ledger.version()
        df = self.ledger.read(version=v) if v else None
        return v, df if df is not None else self.spark.createDataFrame([], LEDGER)

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Write a change of the ledger; one that another driver's came before is made again on that."""
        while True:
            try:
                v, rows = self._rows()
                self.ledger.commit(change(rows), after=v)
                return
            except Conflict:
                continue

    def running(self) -> int:
        """How many runs the ledger has as running."""
        return self._rows()[1].where("status = 'RUNNING'").count()

    def start(self, now: datetime) -> int:
        """Take the lease. Of two drivers that start at once one commits; the other then sees its run."""
        while True:
            v, rows = self._rows()
            rows = reaped(rows, F.lit(now).cast("timestamp_ntz"))
            if rows.where("status = 'RUNNING'").limit(1).count():
                raise RunInProgress("a run is in progress")
            run_id = (rows.agg(F.max("run_id")).first()[0] or 0) + 1
            new = self.spark.createDataFrame([(run_id, now, now, None, "RUNNING", 0, 0, 0, 0, None)], LEDGER)
            try:
                self.ledger.commit(rows.unionByName(new), after=v)
                return run_id
            except Conflict:
                continue

    def beat(self, run_id: int, now: datetime) -> None:
        mine = (F.col("run_id") == run_id) & (F.col("status") == "RUNNING")
        self._change(lambda rows: rows.withColumn("heartbeat_at", F.when(mine, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("heartbeat_at"))))

    def finish(self, run_id: int, now: datetime, ok: bool, counts: dict[str, int] | None = None, note: str | None = None) -> None:
        """End the run if it still runs; a run that was reaped stays failed."""
        mine = (F.col("run_id") == run_id) & (F.col("status") == "RUNNING")

        def ended(rows: DataFrame) -> DataFrame:
            for c, v in (counts or {}).items():
                rows = rows.withColumn(c, F.when(mine, F.lit(v).cast("bigint")).otherwise(F.col(c)))
            rows = rows.withColumn("note", F.when(mine & F.lit(bool(note)), F.lit(note)).otherwise(F.col("note"))).withColumn("finished_at", F.when(mine, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("finished_at")))
            return rows.withColumn("status", F.when(mine, "DONE" if ok else "FAILED").otherwise(F.col("status")))

        self._change(ended)

    def run(self, stages: list[tuple[str, Callable[[], dict[str, int] | None]]], clock: Callable[[], datetime]) -> int:
        """Run all stages; whatever fails, the ledger row is finished."""
        run_id = self.start(clock())
        counts: dict[str, int] = {}
        at = "start"
        try:
            for at, stage in stages:
                counts |= stage() or {}
                self.beat(run_id, clock())
        except Exception as e:
            self.finish(run_id, clock(), False, counts, run_note(at, str(e)[:300]))
            raise
        self.finish(run_id, clock(), True, counts)
        return run_id
