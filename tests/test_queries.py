"""Every core query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fernmill import core_queries
from fernmill.session import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def connect():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def same(spark, name, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    rel = connect().execute(sql)
    have = [c[0] for c in rel.description]
    assert sorted(have) == cols
    assert got == sorted(str(tuple(r[have.index(c)] for c in cols)) for r in rel.fetchall()), name


@pytest.mark.parametrize("name", sorted(core_queries.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, name, core_queries.queries()[name], core_queries.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_not_need_llm():
    root = os.path.dirname(core_queries.__file__)
    for folder, _, files in os.walk(root):
        if os.path.relpath(folder, root).split(os.sep)[0] == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "fernmill.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()


def test_run_modes(spark, tmp_path):
    import json
    from datetime import datetime

    from fernmill.plans import modes
    from fernmill.sources.store import VersionedTable

    out = str(tmp_path / "out")
    assert modes.local_run(spark, DATA, out, clock=lambda: datetime(2026, 1, 1)) == 1
    made = json.load(open(f"{out}/report.json", encoding="utf-8"))
    assert set(made) == set(modes.REPORT) and made["totals"]["postings"] > 0 and made["jobs"]
    assert VersionedTable(spark, f"{out}/posting_skill").read().count() == core_queries.queries()["match_raw_skills"](spark, DATA).count()
    assert [(r.run_id, r.status) for r in VersionedTable(spark, f"{out}/ledger").read().collect()] == [(1, "DONE")]
