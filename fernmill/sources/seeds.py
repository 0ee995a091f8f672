"""Seed dimensions from small CSV files, with the checks that they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class SeedError(ValueError):
    """A seed file breaks a rule; the message has the offending rows."""


def read_seed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of a seed file as strings, empty fields as null.

    UTF-8 with or without a byte order mark; blank lines and lines that begin with # don't
    count, the first other line is the header; fields have no quotes and no commas. A row with
    another number of fields is an error.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line")).where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    header = ",".join(columns)
    body = lines.where(F.trim("line") != header).select("line", F.split("line", ",", -1).alias("f"))
    if lines.where(F.trim("line") == header).limit(1).count() == 0:
        raise SeedError(f"{path}: the header is not {header}")
    if bad := body.where(F.size("f") != len(columns)).limit(3).collect():
        raise SeedError(f"{path}: rows without {len(columns)} fields: {[r['line'] for r in bad]}")
    return body.select(*[F.nullif(F.trim(F.col("f")[i]), F.lit("")).alias(c) for i, c in enumerate(columns)])


def _none(df: DataFrame, message: str) -> None:
    if rows := df.limit(5).collect():
        raise SeedError(f"{message}: {[tuple(r) for r in rows]}")


def repeated(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def skills(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, category) with unique names and codes."""
    df = read_seed(spark, path, ["code", "name", "category"]).withColumn("code", F.col("code").try_cast("int"))
    _none(repeated(df, "name"), "names that stand twice")
    _none(repeated(df, "code"), "codes that stand twice")
    return df


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, skill, text_match) with text_match 0 or 1."""
    df = read_seed(spark, path, ["alias", "skill", "text_match"])
    _none(df.where(~F.coalesce(F.col("text_match").isin("0", "1"), F.lit(False))), "text_match is neither 0 nor 1")
    return df.withColumn("text_match", F.col("text_match").cast("int"))


def codes(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of the code table."""
    return read_seed(spark, path, ["code", "name"]).withColumn("code", F.col("code").try_cast("int"))
