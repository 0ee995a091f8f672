"""Queries of the llm operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernmill.llm import bpe, canon, leaks, names, pairs, stuffing, textform, topn
from fernmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.company_pairs(table(spark, d, "company"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each company row with its organisation's class."""
    return names.organisations(table(spark, d, "company"), row="company_id", key="saramin_csn", name="name", group="group_name").withColumnRenamed("row", "company_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_skills(table(spark, d, "job_skill_stat")).selectExpr("job_id", "date_format(calc_date, 'yyyy-MM-dd') AS calc_date", "skill_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.of_directory(spark, d).select("skill_id_a", "skill_id_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.meant_entries(table(spark, d, "skill"), table(spark, d, "skill_alias"), table(spark, d, "raw_document"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.inconsistent_texts(table(spark, d, "raw_document"), table(spark, d, "posting")).drop("norm")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of each text that is not in it."""
    return textform.inconsistent_texts(table(spark, d, "raw_document"), table(spark, d, "posting"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), key="doc_id", text="text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"), doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"), key="doc_id", text="text").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p6_forms": p6_forms, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH latest AS (
                SELECT * FROM job_skill_stat WHERE ratio IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY calc_date, job_id, skill_id
                                           ORDER BY loaded_at DESC NULLS LAST, ratio DESC, posting_cnt DESC NULLS LAST) = 1)
            SELECT job_id, strftime(calc_date, '%Y-%m-%d') AS calc_date, skill_id FROM latest WHERE job_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ratio DESC, posting_cnt DESC NULLS LAST, calc_date DESC, skill_id) <= 10""",
        "p3_found": """
            WITH d AS (SELECT DISTINCT posting_id, skill_id FROM posting_skill WHERE posting_id IS NOT NULL AND skill_id IS NOT NULL),
            n AS (SELECT count(DISTINCT posting_id) AS n FROM d),
            m AS (SELECT skill_id, count(*) AS c FROM d GROUP BY 1),
            k AS (SELECT a.skill_id AS sa, b.skill_id AS sb, count(*) AS k FROM d a JOIN d b ON a.posting_id = b.posting_id AND a.skill_id < b.skill_id GROUP BY 1, 2)
            SELECT sa AS skill_id_a, sb AS skill_id_b FROM k, n, m ma, m mb
            WHERE ma.skill_id = sa AND mb.skill_id = sb AND k >= 6 AND 1000 * k >= n AND k * n >= 4 * ma.c * mb.c""",
    }
