"""Top N items within every group, by a global range-partitioned sort.

The rows are range-partitioned on group, score and identifier, so a group of any size is
spread over as many partitions as it needs. Each sorted partition yields, per group, the
number of its rows and its first N rows with their place in the partition; the counts of
the partitions before, summed up, turn places into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fernmill.session import materialise


def _starts(group: pa.Array) -> np.ndarray:
    """Indices where a new group begins in a sorted array; the first row always counts."""
    n = len(group)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    import pyarrow.compute as pc

    differs = pc.fill_null(pc.not_equal(group.slice(1), group.slice(0, n - 1)), True)
    return np.concatenate(([0], np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1)).astype(np.int64)


def top_n(df: DataFrame, *, group: str, order: Sequence[Column], n: int, partitions: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the given order, with their exact ``position``.

    ``order`` must be total within a group (end it with an identifier). Rows with a null
    group are left out; ties are broken by ``order`` alone; fewer than ``n`` rows all come
    out; an empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    clean = df.where(F.col(group).isNotNull())
    by = [F.col(group).asc(), *order]
    parts = [partitions] if partitions else []
    placed = clean.repartitionByRange(*parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    names = df.columns
    schema = T.StructType(
        [*[T.StructField(f.name, f.dataType, True) for f in df.schema], T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType()), T.StructField("_rows", T.LongType())]
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far, part = None, 0, 0
        types = None

        def summary(value, rows: int) -> pa.RecordBatch:
            cols = [pa.array([value] if c == group else [None], t) for c, t in zip(names, types)]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([rows], pa.int64())],
                names=[*names, "_part", "_place", "_rows"],
            )

        for b in batches:
            if b.num_rows == 0:
                continue
            types = [b.schema.field(c).type for c in names]
            g = b.column(names.index(group))
            starts = _starts(g)
            ends = np.append(starts[1:], b.num_rows)
            part = b.column(b.num_columns - 1)[0].as_py()
            carried = so_far if last is not None and g[0].equals(last) else 0
            if last is not None and not carried:
                yield summary(last.as_py(), so_far)
            offset = np.zeros(len(starts), dtype=np.int64)
            offset[0] = carried
            place = np.arange(b.num_rows, dtype=np.int64) - np.repeat(starts, ends - starts) + np.repeat(offset, ends - starts) + 1
            keep = place <= n
            if keep.any():
                rows = b.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(place[keep]), pa.array(np.zeros(int(keep.sum()), dtype=np.int64))],
                    names=[*rows.schema.names, "_place", "_rows"],
                )
            closed = ends - starts + offset
            for k in range(len(starts) - 1):
                if closed[k]:
                    yield_at = g[int(starts[k])]
                    pending.append((yield_at.as_py(), int(closed[k])))
            if pending:
                cols = [pa.array([v for v, _ in pending] if c == group else [None] * len(pending), t) for c, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([part] * len(pending), pa.int32()), pa.array([None] * len(pending), pa.int64()), pa.array([r for _, r in pending], pa.int64())],
                    names=[*names, "_part", "_place", "_rows"],
                )
                pending.clear()
            last, so_far = g[int(starts[-1])], int(closed[-1])
        if last is not None:
            yield summary(last.as_py(), so_far)

    pending: list[tuple] = []
    counted = placed.mapInArrow(local, schema)
    # per group at most (n + 1) rows a partition arrive here, whatever the size of the group
    before = Window.partitionBy(group).orderBy("_part", F.col("_place").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("position", F.col("_place") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .where(F.col("position") <= n)
        .drop("_part", "_place", "_rows")
    )


def latest_stats(stat: DataFrame) -> DataFrame:
    """Of each (calc_date, job_id, skill_id) the row loaded last, among rows with a ratio.

    Rows loaded at the same instant: the greater ratio, then the greater posting_cnt counts.
    Null keys group together as SQL has it; the maps combine before the shuffle.
    """
    newest = F.max(F.struct("loaded_at", "ratio", "posting_cnt")).alias("r")
    return (
        stat.where(F.col("ratio").isNotNull())
        .groupBy("calc_date", "job_id", "skill_id")
        .agg(newest)
        .select("job_id", "calc_date", "skill_id", F.col("r.ratio").alias("ratio"), F.col("r.posting_cnt").alias("posting_cnt"))
    )


def top_skills(stat: DataFrame, n: int = 10) -> DataFrame:
    """Per job the first ``n`` of its latest rows by ratio, posting count, date and skill.

    The latest rows are written once: the sort's ranges come from a sample of its input.
    """
    order = [
        F.col("ratio").desc(),
        F.col("posting_cnt").desc_nulls_last(),
        F.col("calc_date").desc_nulls_last(),
        F.col("skill_id").asc_nulls_last(),
    ]
    return top_n(materialise(latest_stats(stat), "latest-stats"), group="job_id", order=order, n=n)
