"""The pair table against counting all over again."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from fernmill.llm import pairs
from fernmill.llm.pairs import PairTable, skill_pairs

SCHEMA = "posting_id bigint, skill_id bigint, source string, loaded_at timestamp, basket string, item string, items string"
T0 = datetime(2026, 1, 1)


def counts(rows):
    b = {}
    for p, s, *_ in rows:
        if p is not None and s is not None:
            b.setdefault(p, set()).add(s)
    one, two = Counter(), Counter()
    for items in b.values():
        one.update(items)
        two.update(itertools.combinations(sorted(items), 2))
    return len(b), one, two


def state(t):
    return (
        t.total(),
        Counter({r.item: r.n for r in t.items().collect()}),
        Counter({(r.item_a, r.item_b): r.k for r in t.pairs().collect()}),
    )


def rows(rnd, n, baskets=40):
    return [(rnd.choice([None, 0, 0, *range(baskets)]), rnd.choice([None, *range(12)]), "TAG", rnd.choice([None, T0 + timedelta(days=rnd.randint(0, 30))]), "x", "y", "z") for _ in range(n)]


def check(t, data):
    """The state, its scores included, is that of counting all over again."""
    n, one, two = counts(data)
    assert state(t) == (n, one, two)
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, round(r.lift, 9)) for r in t.scores().collect()}
    assert got == {p: (one[p[0]], one[p[1]], round(k * n / (one[p[0]] * one[p[1]]), 9)) for p, k in two.items()}


@pytest.mark.parametrize("bucket_rows", [10_000, 7])
def test_changes(spark, tmp_path, monkeypatch, bucket_rows):
    monkeypatch.setattr(pairs, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(1)
    t = PairTable(spark, str(tmp_path / "t"))
    a = rows(rnd, 300)
    t.apply(spark.createDataFrame(a, SCHEMA), "posting_id", "skill_id")
    check(t, a)
    late = rows(rnd, 60, 50)
    t.apply(spark.createDataFrame(late, SCHEMA), "posting_id", "skill_id", amend=True)
    check(t, a + late)
    # basket 3 gets other items, basket 5 goes, nothing else changes
    now = [r for r in a + late if r[0] not in (3, 5)] + [(3, 1, "TAG", T0, "", "", ""), (3, 2, "TAG", T0, "", "", "")]
    t.apply(spark.createDataFrame([r for r in now if r[0] == 3], SCHEMA), "posting_id", "skill_id", removed=spark.createDataFrame([(5,), (None,)], "posting_id bigint"))
    check(t, now)
    t.apply(spark.createDataFrame([], SCHEMA), "posting_id", "skill_id")
    check(t, now)
    v = t.version()
    t.sync(spark.createDataFrame(now, SCHEMA), "posting_id", "skill_id")
    assert t.version() == v
    other = [r for r in now if r[0] != 7] + [(8, 11, "TAG", T0, "", "", ""), (900, 11, "TAG", T0, "", "", "")]
    t.sync(spark.createDataFrame(other, SCHEMA), "posting_id", "skill_id")
    check(t, other)
    t.sync(spark.createDataFrame([], SCHEMA), "posting_id", "skill_id")
    check(t, [])


def test_writes_follow_the_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "BUCKET_ROWS", 40)
    data = [(b, 10 * b + i, "TAG", T0, "", "", "") for b in range(200) for i in range(4)]
    t = PairTable(spark, str(tmp_path / "t"))
    t.sync(spark.createDataFrame(data, SCHEMA), "posting_id", "skill_id")
    of = t.pointer.read()[1]["at"]
    data[5 * 4 + 3] = (5, 9999, "TAG", T0, "", "", "")
    t.sync(spark.createDataFrame(data, SCHEMA), "posting_id", "skill_id")
    check(t, data)
    now = t.pointer.read()[1]["at"]
    # one basket, two marginals that changed, the six pairs of them
    for what, most in (("baskets", 1), ("items", 2), ("pairs", 6)):
        assert len(of[what]) > 2 * most and len(now[what].items() - of[what].items()) <= most


def test_a_lost_run_loses_nothing(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    t = PairTable(spark, str(tmp_path / "t"))
    a = rows(rnd, 200)
    t.sync(spark.createDataFrame(a, SCHEMA), "posting_id", "skill_id")
    late = rows(rnd, 50, 50)

    def lost(*_):
        raise RuntimeError("lost")

    for step in ("_write", "_merge"):
        with monkeypatch.context() as m:
            m.setattr(PairTable, step, lost)
            with pytest.raises(RuntimeError, match="lost"):
                t.apply(spark.createDataFrame(late, SCHEMA), "posting_id", "skill_id", amend=True)
    with monkeypatch.context() as m:  # all is written, the pointer isn't
        m.setattr(type(t.pointer), "move", lost)
        with pytest.raises(RuntimeError, match="lost"):
            t.apply(spark.createDataFrame(late, SCHEMA), "posting_id", "skill_id", amend=True)
    check(PairTable(spark, t.path), a)
    t.apply(spark.createDataFrame(late, SCHEMA), "posting_id", "skill_id", amend=True)
    check(t, a + late)


def test_a_folder_cleaned_in_part(spark, tmp_path):
    import shutil

    t, a = PairTable(spark, str(tmp_path / "t")), rows(random.Random(6), 80)
    t.sync(spark.createDataFrame(a, SCHEMA), "posting_id", "skill_id")
    shutil.rmtree(next((tmp_path / "t").glob("pairs-*")))
    t.sync(spark.createDataFrame(a, SCHEMA), "posting_id", "skill_id")
    check(t, a)


def test_a_long_basket_is_spread(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 5)
    sets = spark.createDataFrame([(list(range(23)), 2), ([3, 9], 5), ([3], 1)], "items array<bigint>, weight bigint")
    want = Counter({p: 2 for p in itertools.combinations(range(23), 2)}) + Counter({(3, 9): 5})
    assert {(r.item_a, r.item_b): r.k for r in pairs.pair_deltas(sets).collect()} == want


def test_found(spark, tmp_path):
    rnd = random.Random(2)
    data = rows(rnd, 200) + [(1000 + i, s, "TAG", T0, "", "", "") for i in range(9) for s in (50, 51)]
    n, one, two = counts(data)
    want = {p for p, k in two.items() if k >= 6 and 1000 * k >= n and k * n >= 4 * one[p[0]] * one[p[1]]}
    got = {(r.skill_id_a, r.skill_id_b) for r in skill_pairs(spark.createDataFrame(data, SCHEMA), path=str(tmp_path / "t")).collect()}
    assert (50, 51) in want and got == want


def test_empty(spark, tmp_path):
    assert skill_pairs(spark.createDataFrame([], SCHEMA), path=str(tmp_path / "t")).count() == 0
