"""Session helpers: table access, shared scratch space, small-side checks."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "company posting list_item raw_document posting_skill job_skill_stat skill skill_alias eval_item"
).split()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once an application.

    Workers import the package by name; where it isn't installed on the executors' machines
    they find it in the archive that the session hands out.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    archive = f"{shared_dir(spark)}/fernmill-{uuid.uuid4().hex[:8]}.zip"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archive)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(body.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, as a lazy parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views over the named tables, for operators that are plain SQL."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def query(spark: SparkSession, sf_dir: str, text: str, **args: object) -> DataFrame:
    """A SQL query over a data directory's tables, with named parameters (``:name``): values are bound, never pasted."""
    register(spark, sf_dir, *[t for t in TABLES if t in text])
    return spark.sql(text, args=args)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all executors
    are threads of this process (tests, local runs) a folder of this process is made and set as
    checkpoint folder; a cluster without the setting is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: the executors need a folder that they share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"fernmill-{os.getpid()}"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def state_dir(spark: SparkSession, label: str, source: str) -> str:
    """The folder of an operator's state over one source, found again by later calls and later runs."""
    return f"{shared_dir(spark)}/state/{label}-{hashlib.md5(source.encode()).hexdigest()[:16]}"


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for one run's intermediate table; ``release`` removes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables made so far, once their results are written; returns their number."""
    paths = list(_made)
    _made.clear()
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer partitions than there are (a small file is one).

    For operators that spend much time a row; a large scan has more partitions and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a few narrow columns that a side to be broadcast may have.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the bound, else as it is: then the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, executors may go."""
    path = scratch(df.sparkSession, label)
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
