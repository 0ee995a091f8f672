"""The llm queries with SQL against DuckDB, the others for their columns."""

import os

import duckdb
import pytest

from fernmill.llm import queries
from fernmill.session import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": [("company_id_a", "bigint"), ("company_id_b", "bigint")],
    "p2_found": [("job_id", "bigint"), ("calc_date", "string"), ("skill_id", "bigint")],
    "p3_found": [("skill_id_a", "bigint"), ("skill_id_b", "bigint")],
    "p4_found": [("field", "string"), ("row_key", "bigint"), ("skill_id", "bigint")],
    "p6_found": [("field", "string"), ("row_key", "bigint"), ("item_no", "bigint")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    rel = db.execute(queries.oracle_sql()[name])
    have = [c[0] for c in rel.description]
    cols = sorted(df.columns)
    assert sorted(have) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[have.index(c)] for c in cols)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.dtypes == COLUMNS[name]
    assert df.count() > 0 or name == "p3_found"
