"""Changes between full snapshots against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from fernmill.operators.snapshots import posting_changes

SCHEMA = (
    "row_id bigint, snap_no int, posting_id bigint, company_id bigint, title string, region string, deadline_on date, is_closed int, closed_at timestamp_ntz, "
    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, change string, at string"
)
T0 = datetime(2026, 1, 1, 4, 0, 0)


def brute(rows):
    best = {}
    for r in rows:
        if r[1] is None or r[2] is None:
            continue
        key = (r[1], r[2])
        rank = (r[10] is not None, r[10] or T0, r[0])
        if key not in best or rank > best[key][0]:
            cut = lambda t: t and t.replace(microsecond=0)
            best[key] = (rank, (r[3], r[4], r[5], r[6], r[7], cut(r[8]), cut(r[9])))
    snaps = sorted({s for s, _ in best})
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        old, new = ({p: v[1] for (s, p), v in best.items() if s == x} for x in (a, b))
        out |= {(b, p, "added") for p in new.keys() - old.keys()} | {(b, p, "removed") for p in old.keys() - new.keys()}
        out |= {(b, p, "changed") for p in new.keys() & old.keys() if old[p] != new[p]}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        snap, pid = rnd.choice([3, 5, 6, 9, None]), rnd.choice([None, *range(25), 1, 1, 1])
        seen = T0 + timedelta(seconds=rnd.randint(0, 3))
        first = T0 + timedelta(microseconds=rnd.randint(0, 999999))
        rows.append((i, snap, pid, rnd.choice([1, None]), rnd.choice(["a", "b", None, ""]), "r", None, rnd.randint(0, 1), None, first, rnd.choice([seen, None]), "x", "y"))
    got = [tuple(r) for r in posting_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_empty_and_single(spark):
    assert posting_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, 1, 1, 1, "a", "r", None, 0, None, T0, T0, None, None)]
    assert posting_changes(spark.createDataFrame(one, SCHEMA)).count() == 0
