"""Versioned snapshot tables and raw documents in a shared folder.

A table's next version is written whole into a folder of its own; then a pointer is moved. A
reader sees the old version or the new one, never a mixture, whenever a writer is lost.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fernmill.session import delete_path

RAW = T.StructType(
    [
        T.StructField("tags", T.ArrayType(T.StructType([T.StructField("code", T.IntegerType()), T.StructField("name", T.StringType())]))),
        T.StructField("required", T.ArrayType(T.StringType())),
        T.StructField("preferred", T.ArrayType(T.StringType())),
    ]
)


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Pointer:
    """The version that counts, as a row of small files that are made once and never changed.

    File ``VERSION-n`` holds what version n consists of; the greatest counts. It is written under
    another name and renamed once whole, so that a writer lost at any step leaves the version
    before; of two writers of one version the second is told.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted((int(n[8:]) for n in names if n.startswith("VERSION-") and n[8:].isdigit()), reverse=True)

    def read(self) -> tuple[int, dict]:
        """(version, what it consists of); version 0 for none."""
        for v in self.versions()[:1]:
            stream = self._fs.open(self._path(f"{self.path}/VERSION-{v}"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            return v, json.loads(text)
        return 0, {}

    def move(self, version: int, of: dict) -> None:
        """Make ``version`` the one that counts; ``Conflict`` if another writer did, or one later is there."""
        if version <= self.read()[0]:
            raise Conflict(f"version {version} of {self.path} is there already")
        at, draft = self._path(f"{self.path}/VERSION-{version}"), self._path(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(of).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} was made by another writer")

    def forget(self, keep: int) -> list[int]:
        """Take away the files of all but the last ``keep`` versions; returns those left."""
        left = []
        for k, v in enumerate(self.versions()):
            if k < keep:
                left.append(v)
            else:
                self._fs.delete(self._path(f"{self.path}/VERSION-{v}"), False)
        return left


class VersionedTable:
    """A table as a row of whole versions under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointer = Pointer(spark, self.path)

    def version(self) -> int:
        return self.pointer.read()[0]

    def read(self, schema: T.StructType | None = None, version: int | None = None) -> DataFrame | None:
        """The version that counts, or that of the number given if it counts still; None for none."""
        v, of = self.pointer.read()
        if not v:
            return None
        if version is not None and v != version:
            raise Conflict(f"version {version} of {self.path} doesn't count any more")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{of['folder']}")

    def commit(self, df: DataFrame, partition_by: str | None = None, keep: int = 2, after: int | None = None) -> int:
        """Write ``df`` as the next version and point to it; the last ``keep`` stay for those who read them.

        With ``after`` the version must follow that one, else ``Conflict``: a reader's change is
        never written over another's.
        """
        v = (self.version() if after is None else after) + 1
        folder = f"v{v}-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{folder}")
        try:
            self.pointer.move(v, {"folder": folder})
        except Conflict:
            delete_path(self.spark, f"{self.path}/{folder}")
            raise
        self._sweep(max(keep, 1))
        return v

    def _sweep(self, keep: int) -> None:
        """Folders of versions that went; those of writers at work have a number above the last."""
        left = self.pointer.forget(keep)
        for folder in folders(self.spark, self.path):
            if folder.startswith("v") and (n := folder[1:].split("-")[0]).isdigit() and int(n) < min(left):
                delete_path(self.spark, f"{self.path}/{folder}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders under a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether a store's folder is there and holds anything: an empty one is a mount that failed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def sweep_temporary(spark: SparkSession, path: str, older_than_s: float, now_s: float, suffix: str = ".tmp") -> int:
    """Delete the unfinished files (by ``suffix``) of a folder that are older; returns their number."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for f in fs.listStatus(p) if fs.exists(p) else []:
        if f.getPath().getName().endswith(suffix) and f.getModificationTime() < (now_s - older_than_s) * 1000:
            gone += bool(fs.delete(f.getPath(), True))
    return gone


def without_documents(documents: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The documents' next version without those of ``gone``: what retention deletes."""
    return documents.join(gone.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def to_json(documents: DataFrame, key: str) -> DataFrame:
    """(key, body): each raw document as JSON text."""
    return documents.select(key, F.to_json(F.struct("tags", "required", "preferred")).alias("body"))


def from_json(bodies: DataFrame, key: str) -> DataFrame:
    """(key, tags, required, preferred, readable) of JSON texts; a corrupt one is not readable and has nulls."""
    parsed = F.from_json("body", RAW, {"mode": "PERMISSIVE"})
    ok = F.get_json_object("body", "$").isNotNull()
    return bodies.select(key, F.when(ok, parsed).alias("d"), ok.alias("readable")).select(key, "d.tags", "d.required", "d.preferred", F.coalesce("readable", F.lit(False)).alias("readable"))


def missing_documents(targets: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The targets without a document."""
    return targets.join(documents.select(key).distinct(), key, "left_anti")


def too_many_missing(missing: int, targets: int, stored: int) -> bool:
    """Whether a run must stop before it writes: the store is empty, or a tenth of 20 and more is missing."""
    return targets > 0 and stored == 0 or missing >= 20 and 10 * missing > targets
