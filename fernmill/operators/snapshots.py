"""What changed between consecutive full snapshots of a table.

Every key is windowed by snapshot: the lag of a content hash shows changes, a gap between
the snapshot a key was last seen in and the one before the present shows a removal and a
later addition. All snapshots are handled in one pass, whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: More deliveries than this are joined by shuffle instead of broadcast.
BROADCAST_SNAPSHOTS = 100_000


def whole_second(c: Column) -> Column:
    return F.date_trunc("second", c)


def content_hash(columns: Sequence[Column]) -> Column:
    """Two independent 64-bit hashes; nulls are told apart from values by their flags."""
    flagged = [x for c in columns for x in (c, c.isNull())]
    return F.struct(F.xxhash64(*flagged).alias("h1"), F.xxhash64(F.lit(20177), *reversed(flagged)).alias("h2"))


def snapshot_neighbours(df: DataFrame, snap: str) -> DataFrame:
    """(snap, prev_snap, next_snap) of the snapshots present; broadcast while they are few."""
    spark = df.sparkSession
    distinct = df.select(snap).where(F.col(snap).isNotNull()).distinct()
    kind = df.schema[snap].dataType
    schema = T.StructType([T.StructField(n, kind) for n in (snap, "prev_snap", "next_snap")])
    found = sorted(r[0] for r in distinct.limit(BROADCAST_SNAPSHOTS + 1).collect())
    if len(found) <= BROADCAST_SNAPSHOTS:
        rows = list(zip(found, [None, *found[:-1]], [*found[1:], None]))
        return F.broadcast(spark.createDataFrame(rows, schema))
    w = Window.orderBy(snap)
    return distinct.select(snap, F.lag(snap).over(w).alias("prev_snap"), F.lead(snap).over(w).alias("next_snap"))


def snapshot_changes(
    df: DataFrame, *, key: str, snap: str, order: Sequence[str], compared: Sequence[Column]
) -> DataFrame:
    """Rows (snap, key, change) with change 'added', 'removed' or 'changed'.

    ``order``: the columns by which the counting row of a key within a snapshot is chosen,
    the greatest first. ``compared``: the expressions whose difference is a change.

    Defined cases: rows with a null key or snapshot belong to no record and are left out;
    an empty table and a table of one snapshot give no rows; equal rows count once; null
    equals null; nulls in ``order`` count as the smallest. Other columns are never read.
    """
    kept = df.where(F.col(key).isNotNull() & F.col(snap).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(snap).alias("_snap"),
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], content_hash(compared).alias("hash")).alias("_row"),
    )
    # partial aggregation before the shuffle: a key repeated without end costs one row a task
    one = kept.groupBy("_key", "_snap").agg(F.max("_row").getField("hash").alias("_hash"))
    near = snapshot_neighbours(df, snap).withColumnsRenamed({snap: "_snap"})
    w = Window.partitionBy("_key").orderBy("_snap")
    seen = one.join(near, "_snap").select(
        "_key",
        "_snap",
        "prev_snap",
        "next_snap",
        "_hash",
        F.lag("_snap").over(w).alias("before"),
        F.lag("_hash").over(w).alias("hash_before"),
        F.lead("_snap").over(w).alias("after"),
    )
    here = (
        F.when(F.col("prev_snap").isNull(), None)
        .when(F.col("before").isNull() | (F.col("before") < F.col("prev_snap")), "added")
        .when(F.col("hash_before") != F.col("_hash"), "changed")
    )
    gone = F.col("next_snap").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("next_snap")))
    event = lambda at, what: F.struct(at.alias("at"), what.alias("change"))
    return (
        seen.select(
            "_key",
            F.explode(
                F.filter(
                    F.array(
                        event(F.col("_snap"), here),
                        event(F.col("next_snap"), F.when(gone, "removed")),
                    ),
                    lambda e: e["change"].isNotNull(),
                )
            ).alias("e"),
        )
        .select(F.col("e.at").alias(snap), F.col("_key").alias(key), F.col("e.change").alias("change"))
    )


def posting_changes(posting: DataFrame) -> DataFrame:
    """The changes of the posting deliveries: see ``snapshot_changes``."""
    compared = [
        F.col("company_id"),
        F.col("title"),
        F.col("region"),
        F.col("deadline_on"),
        F.col("is_closed"),
        whole_second(F.col("closed_at")),
        whole_second(F.col("first_seen_at")),
    ]
    out = snapshot_changes(posting, key="posting_id", snap="snap_no", order=["last_seen_at", "row_id"], compared=compared)
    return out.select(F.col("snap_no").cast("bigint").alias("snap_no"), "posting_id", "change")
