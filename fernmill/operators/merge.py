"""Merging of observations into a state table, as one full outer join.

Each column has a rule that says what stands after the merge; rows that only one side has
are kept or inserted. The result is the whole next version of the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

Rule = Callable[[Column, Column], Column]

take: Rule = lambda old, new: new
keep: Rule = lambda old, new: old
take_if_known: Rule = lambda old, new: F.coalesce(new, old)
keep_if_known: Rule = lambda old, new: F.coalesce(old, new)
later: Rule = lambda old, new: F.greatest(old, new)
earlier: Rule = lambda old, new: F.least(old, new)
add: Rule = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the greatest by ``order``; the maps combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row"))).getField("_row").alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule], insert: bool = True) -> DataFrame:
    """The state after ``new`` (one row a key) is merged: rules for rows of both sides, inserts for new keys.

    Columns without a rule keep the old value and are null in inserted rows unless ``new`` has
    them. Null keys match nothing: such old rows stay, such new rows are inserted.
    """
    cols = old.columns
    right = new.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    left = old.withColumn("_old", F.lit(True))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    both = left.join(right, on, "full" if insert else "left")
    out = []
    for c in cols:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"_k{keys.index(c)}")).alias(c))
            continue
        there = c in new.columns
        n = F.col(f"_n_{c}") if there else F.lit(None).cast(old.schema[c].dataType)
        merged = rules[c](F.col(c), n) if c in rules and there else F.col(c)
        out.append(F.when(F.col("_old").isNull(), n).when(F.col("_new").isNull(), F.col(c)).otherwise(merged).cast(old.schema[c].dataType).alias(c))
    return both.select(*out)


def replace_keys(old: DataFrame, new: DataFrame, key: str, processed: DataFrame) -> DataFrame:
    """The rows of processed keys replaced by the new ones; other rows stay."""
    done = processed.select(key).distinct()
    return old.join(done, key, "left_anti").unionByName(new)
