"""Top N within groups against brute force, a hot group included."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fernmill.llm import topn

SCHEMA = "calc_date date, job_id bigint, skill_id bigint, posting_cnt int, job_total int, ratio decimal(5,4), rank_no int, loaded_at timestamp, position string, _part string"
T0 = datetime(2026, 1, 1)


def brute(rows, n=10):
    latest = {}
    for r in rows:
        if r[5] is None:
            continue
        k, rank = r[:3], (r[7] is not None, r[7] or T0, r[5], r[3] is not None, r[3] or 0)
        if k not in latest or rank > latest[k][0]:
            latest[k] = (rank, r)
    by = {}
    for _, r in latest.values():
        if r[1] is not None:
            by.setdefault(r[1], []).append(r)
    low = date(1, 1, 1)
    order = lambda r: (-r[5], -(r[3] if r[3] is not None else -1), -((r[0] or low).toordinal()), r[2] is None, r[2] or 0)
    return {(j, r[0], r[2]) for j, rs in by.items() for r in sorted(rs, key=order)[:n]}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        job = 7 if rnd.random() < 0.4 else rnd.choice([None, *range(40)])
        d = rnd.choice([None, date(2026, 1, 1), date(2026, 1, 2)])
        ratio = rnd.choice([None, Decimal("0.5000"), Decimal("0.2500"), Decimal("0.1000")])
        rows.append((d, job, rnd.choice([None, *range(60)]), rnd.choice([None, 1, 2]), 9, ratio, rnd.choice([None, 0, 1]), rnd.choice([None, T0, T0 + timedelta(seconds=1)]), "x", "y"))
    got = [tuple(r) for r in topn.top_skills(spark.createDataFrame(rows, SCHEMA)).select("job_id", "calc_date", "skill_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_positions_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = topn.top_n(df, group="g", order=[F.col("v").desc()], n=1500, partitions=9)
    rows = {(r.g, r.v): r.position for r in got.collect()}
    assert len(rows) == 3000 and all(p == (4998 + g - v) // 2 + 1 for (g, v), p in rows.items())


def test_empty(spark):
    assert topn.top_skills(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(spark.range(1), group="id", order=[F.col("id")], n=0)
