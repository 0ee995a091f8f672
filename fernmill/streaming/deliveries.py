"""Deliveries that arrive as files, taken over by a stream that stops when all are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fernmill.operators.merge import newest
from fernmill.sources.store import VersionedTable


def latest_by_key(spark: SparkSession, source: str, schema: T.StructType, table: VersionedTable, checkpoint: str, *, key: str, order: list[str]) -> int:
    """Keep the latest row of each key from the Parquet files under ``source``; returns the version.

    Files already taken over are not read again; late and repeated rows lose against what the
    table has. A batch that is run again after a loss leads to the same table.
    """

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col(key).isNotNull())
        old = table.read(schema)
        table.commit(newest(rows if old is None else old.unionByName(rows), [key], order))

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.version()


def windowed_counts(spark: SparkSession, source: str, schema: T.StructType, *, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts a time window and kind as a stream; rows later than the watermark are left out."""
    stream = spark.readStream.schema(schema).parquet(source).withWatermark(at, late)
    return stream.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), kind, "cnt")
