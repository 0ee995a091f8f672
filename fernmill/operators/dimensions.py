"""Keeping dimensions in step with their seeds: plans, alias resolution, company keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fernmill.operators.merge import newest
from fernmill.session import materialise

MOST_ALIAS = 60


def skill_plan(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """(action, skill_id, code, name, category): what brings the stored skills to the seed.

    A seed row updates the row of its name, else the row of its code whose own name the seed
    doesn't have, else it is inserted (skill_id null). Stored rows that nothing updates are
    deactivated, without the code if the seed uses it.
    """
    s = seed.select(F.col("code"), F.col("name"), F.col("category"))
    d = stored.select("skill_id", F.col("saramin_code").cast("int").alias("old_code"), F.col("name").alias("old_name"))
    by_name = s.join(d.select("skill_id", F.col("old_name").alias("name")), "name", "left")
    free = d.join(s.select(F.col("name").alias("old_name")), "old_name", "left_anti").where("old_code is not null")
    renamed = by_name.where("skill_id is null and code is not null").drop("skill_id").join(free.select(F.col("old_code").alias("code"), "skill_id"), "code")
    updates = by_name.where("skill_id is not null").select("skill_id", "code", "name", "category").unionByName(renamed.select("skill_id", "code", "name", "category"))
    inserts = s.join(updates.select("name"), "name", "left_anti")
    used = s.where("code is not null").select(F.col("code").alias("old_code")).distinct().withColumn("used", F.lit(True))
    gone = d.join(updates.select("skill_id"), "skill_id", "left_anti").join(used, "old_code", "left")
    return (
        updates.select(F.lit("update").alias("action"), "skill_id", "code", "name", "category")
        .unionByName(inserts.select(F.lit("insert").alias("action"), F.lit(None).cast("bigint").alias("skill_id"), "code", "name", "category"))
        .unionByName(gone.select(F.lit("deactivate").alias("action"), "skill_id", F.when(F.col("used").isNull(), F.col("old_code")).alias("code"), F.col("old_name").alias("name"), F.lit(None).cast("string").alias("category")))
    )


def apply_skill_plan(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """The next version of the skill table; new ids count on above the highest."""
    top = stored.agg(F.coalesce(F.max("skill_id"), F.lit(0)).alias("top"))
    w = Window.orderBy("name")  # a dimension of some hundred rows
    new = plan.where("action = 'insert'").crossJoin(F.broadcast(top)).withColumn("skill_id", (F.row_number().over(w) + F.col("top")).cast("bigint"))
    kept = stored.select("skill_id", F.col("category").alias("old_category"))
    old = plan.where("action != 'insert'").join(kept, "skill_id").withColumn("category", F.coalesce("category", "old_category"))
    cols = ["skill_id", F.col("code").alias("saramin_code"), "name", "category", (F.col("action") != "deactivate").cast("int").alias("is_active")]
    return old.select(*cols).unionByName(new.select(*cols))


def key_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\u00a0\u3000]+", " "))


def alias_conflicts(skills: DataFrame, listed: DataFrame) -> DataFrame:
    """(problem, alias): what forbids resolving the aliases."""
    names = skills.select(key_form(F.col("name")).alias("alias"), F.col("name").alias("owner"))
    rows = listed.select(key_form(F.col("alias")).alias("alias"), "skill", "text_match")
    twice = names.groupBy("alias").agg(F.count("*").alias("n")).where("n > 1")
    unknown = rows.join(skills.select(F.col("name").alias("skill")), "skill", "left_anti")
    length = rows.where((F.length("alias") == 0) | (F.length("alias") > MOST_ALIAS) | F.col("alias").isNull())
    differ = rows.distinct().groupBy("alias").agg(F.count("*").alias("n")).where("n > 1")
    foreign = rows.join(names, "alias").where("owner != skill")
    parts = [("name stands twice", twice), ("unknown skill", unknown), ("length of alias", length), ("listed differently", differ), ("name of another skill", foreign)]
    out = None
    for problem, df in parts:
        one = df.select(F.lit(problem).alias("problem"), "alias")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def resolved_aliases(skills: DataFrame, listed: DataFrame) -> DataFrame:
    """(alias, skill, text_match): skill names as aliases, overridden by the listed rows."""
    own = skills.select(key_form(F.col("name")).alias("alias"), F.col("name").alias("skill"), F.lit(1).alias("text_match"), F.lit(0).alias("p"))
    rows = listed.select(key_form(F.col("alias")).alias("alias"), "skill", "text_match", F.lit(1).alias("p"))
    return newest(own.unionByName(rows), ["alias"], ["p"]).drop("p")


def company_keys(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, csn, company_id): the stored company of each seen (name, csn), null for a new one.

    With a key the row of that key; without one the lowest id among rows of that name that have
    no key either.
    """
    s = seen.select("name", "csn").distinct()
    by_key = stored.where("saramin_csn is not null").groupBy(F.col("saramin_csn").alias("csn")).agg(F.min("company_id").alias("by_key"))
    by_name = stored.where("saramin_csn is null").groupBy("name").agg(F.min("company_id").alias("by_name"))
    return s.join(by_key, "csn", "left").join(by_name, "name", "left").select("name", "csn", F.when(F.col("csn").isNotNull(), F.col("by_key")).otherwise(F.col("by_name")).alias("company_id"))


def job_merge(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """The jobs (job_id, code, name, sort_order) after those of a list (code, name, position) are merged in.

    A stored code takes the list's name and place; others stay; new ones get ids above the highest.
    """
    s, n = stored.select("job_id", "code", "name", "sort_order"), newest(listed.where("code is not null").select("code", "name", "position"), ["code"], ["position"])
    both = s.join(n.select("code", F.col("name").alias("_name"), "position"), "code", "full")
    top = stored.agg(F.coalesce(F.max("job_id"), F.lit(0)).cast("bigint").alias("top"))
    w = Window.partitionBy(F.col("job_id").isNull()).orderBy("position", "code")  # a dimension of some dozen rows
    return both.withColumn("_n", F.row_number().over(w)).crossJoin(F.broadcast(top)).select(
        F.coalesce("job_id", F.col("top") + F.col("_n")).cast("bigint").alias("job_id"), "code", F.coalesce("_name", "name").alias("name"), F.coalesce("position", "sort_order").alias("sort_order")
    )


def alias_merge(resolved: DataFrame, skills: DataFrame) -> DataFrame:
    """The alias table (alias, skill_id, text_match) as it stands after resolved rows replace it; aliases that are gone go."""
    return resolved.join(skills.select(F.col("name").alias("skill"), "skill_id"), "skill").select("alias", "skill_id", "text_match")


def company_merge(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """The companies (company_id, saramin_csn, name, group_name, size_label) after seen ones (csn, name, group_name, size_label, at) are merged in.

    Of a key the last seen counts and overwrites; without one, the lowest company of the same name
    that has none either stands for it, unchanged; the rest are inserted above the highest id.
    """
    cols = ["company_id", "saramin_csn", "name", "group_name", "size_label"]
    keyed = newest(seen.where("csn is not null").select(F.col("csn").alias("saramin_csn"), "name", "group_name", "size_label", "at"), ["saramin_csn"], ["at", "name"]).drop("at")
    loose = newest(seen.where("csn is null and name is not null").select("name", "group_name", "size_label", "at"), ["name"], ["at"]).drop("at")
    own = newest(stored.where("saramin_csn is not null").select("saramin_csn", "company_id", (-F.col("company_id")).alias("_first")), ["saramin_csn"], ["_first"]).drop("_first")
    fresh = keyed.select(*[F.col(c).alias(f"_{c}") if c != "saramin_csn" else F.col(c) for c in keyed.columns]).join(own, "saramin_csn", "left")
    updated = stored.select(*cols).join(fresh.where("company_id is not null").drop("saramin_csn").withColumn("_hit", F.lit(True)), "company_id", "left")
    kept = updated.select("company_id", "saramin_csn", *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols[2:]])
    new = fresh.where("company_id is null").select("saramin_csn", *[F.col(f"_{c}").alias(c) for c in cols[2:]])
    unnamed = loose.join(stored.where("saramin_csn is null").select("name").distinct(), "name", "left_anti").select(F.lit(None).cast("string").alias("saramin_csn"), *cols[2:])
    return kept.unionByName(numbered(new.unionByName(unnamed), stored, "company_id", ["saramin_csn", "name"]).select(*cols))


def numbered(rows: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ids counted on above the highest stored one, in the given order, without one task for all.

    Sorted ranges are counted; each range's rows get the number of rows before the range added.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = materialise(placed, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    ranges = placed.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    top = stored.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("_top"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = placed.withColumn("_n", within).join(F.broadcast(ranges), "_part").crossJoin(F.broadcast(top))
    return out.withColumn(key, (F.col("_top") + F.col("_before") + F.col("_n")).cast("bigint")).drop("_part", "_before", "_n", "_top")
