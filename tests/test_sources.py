"""Pages, stores, seeds, runs and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from fernmill import session
from fernmill.functions import columns
from fernmill.operators import dimensions, merge, postings, report, selection, stats
from fernmill.plans.run import RunInProgress, Runner
from fernmill.sources import html, schemas, seeds, store
from fernmill.streaming import deliveries


def lines(body):
    return html.text_lines(html.tree(f"<div id=x>{body}</div>").children[0])


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>Python</p><p>Django</p><div>Java 경험</div><div>Spring</div>", ["Python", "Django", "Java 경험", "Spring"]),
        ("앞 글<div>칸</div>뒤 글", ["앞 글", "칸", "뒤 글"]),
        ("<p>Java <b>Spring</b> 경험</p>", ["Java Spring 경험"]),
        ("<table><tr><td>Java</td><td>Kotlin</td></tr><tr><th>DB</th><td>MySQL</td></tr></table>", ["Java Kotlin", "DB MySQL"]),
        ("<li><span>전공</span>컴퓨터공학</li>", ["전공: 컴퓨터공학"]),
        ("a<br>b&nbsp;<br/><br>", ["a", "b"]),
        ("", []),
    ],
)
def test_lines(body, want):
    assert lines(body) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('서울 강남구<div style="DISPLAY: none">숨김</div>', "서울 강남구"),
        ('서울 <span class="player">마포구</span>', "서울 마포구"),
        ('서울 <span class="map_area"><strong>강남구</strong></span>', "강남구"),
        ('<span class="tooltip_txt">3,000만원</span>', "3,000만원"),
        ('서울 <a href="#">지도 보기</a><button>x</button>', "서울"),
    ],
)
def test_values(body, want):
    assert html.summary_value(html.tree(f"<dl><dd>{body}</dd></dl>").children[0].children[0]) == want


#: Pages in the layout that is read, and what is read from them.
ITEM = """<div class="list_item" id="{id}"><div class="company_nm">{name}<span class="main_corp">가상그룹</span> 헤드헌팅</div>
<div class="job_tit"><a title="R&amp;amp;D" href="#">{title}</a></div><div class="job_sector"><span>자바</span><span>웹</span></div>
<p class="work_place">서울</p><div class="support_detail"><span class="date">~10.18</span><span class="deadlines">어제 등록</span></div></div>"""


def page(*items, total="<div class='total_count'>총 <em>1,747</em>건</div>"):
    return f"<html>{total}<div class='list_body'>{''.join(items)}</div></html>"


def test_list_page(spark):
    keyed = ITEM.format(id="rec-12", name='<a class="str_tit" href="/c?pcsn=no&amp;csn=abc%2Bd%3D">새솔</a>', title="개발 &amp; 운영")
    button = ITEM.format(id="rec-13", name='<span class="str_tit">한빛</span><button csn="abc+d=">☆</button>', title="")
    advert = ITEM.format(id="rec-x1", name="", title="광고")
    rows = html.list_pages(spark.createDataFrame([(1, page(keyed, button, advert)), (2, "<html>점검 중</html>"), (3, None)], "p int, html string")).orderBy("p").collect()
    first = rows[0].page
    assert (first.total_count, first.raw_item_count, first.error) == (1747, 3, None)
    assert [(i.posting_id, i.title, i.company_name, i.company_csn, i.headhunting, i.sector_preview, i.region, i.career_text, i.posted_text) for i in first.items] == [
        (12, "개발 & 운영", "새솔", "abc+d=", True, ["자바", "웹"], "서울", None, "어제 등록"),
        (13, "R&amp;D", "한빛", "abc+d=", True, ["자바", "웹"], "서울", None, "어제 등록"),
    ]
    assert rows[1].page.error and rows[2].page.error
    assert html.parse_list(page(total="<div class='total_count'><em>99,999,999,999</em></div>"))["total_count"] is None


DETAIL = """<h1 class="tit_job">백엔드</h1><div class="jv_summary"><dl><dt>경력</dt><dd><strong>3년</strong></dd><dt>x</dt></dl>
<dl><dt>자격요건</dt><dd><button>보기</button><div id="details-required-1">{req}</div></dd></dl></div>
<div class="jv_howto"><dl class="info_period"><dt>시작일</dt><dd>2026.10.01 09:00</dd><dt>마감일</dt><dd>{end}</dd></dl></div>
<div class="jv_footer"><div class="tags"><a href="/x?cat_kewd=84">#백엔드</a><a href="/x?cat_kewd=12345678901">긴 것</a></div></div>"""


def test_detail_page(spark):
    bodies = [DETAIL.format(req="Java<br>Spring", end="채용시"), DETAIL.format(req="", end=""), DETAIL.format(req="a", end="2026-10-13"), "<div class='jv_summary'></div>", ""]
    rows = html.detail_pages(spark.createDataFrame(list(enumerate(bodies)), "p int, html string")).orderBy("p").collect()
    ok = rows[0].page
    assert (ok.title, ok.required, ok.preferred, [tuple(t) for t in ok.tags], ok.start_at, ok.end_at, ok.error) == ("백엔드", ["Java", "Spring"], [], [(84, "백엔드")], datetime(2026, 10, 1, 9), None, None)
    assert ok.summary["경력"] == "3년"
    assert all(r.page.error for r in rows[1:])


def test_store(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.commit(spark.range(3))
    t.commit(t.read().union(spark.range(10, 11)))
    assert t.version() == 2 and sorted(r.id for r in t.read().collect()) == [0, 1, 2, 10]


def test_a_lost_writer_leaves_the_version_before(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(3))
    spark.range(9).write.parquet(str(tmp_path / "t/v2-lost"))  # lost before the pointer
    (tmp_path / "t/draft-1").write_text("")  # lost within the pointer
    assert t.version() == 1 and t.read().count() == 3
    old = t.read()
    assert t.commit(spark.range(4)) == 2
    assert old.count() == 3 and t.read().count() == 4  # a reader keeps what it began with
    with pytest.raises(store.Conflict):
        t.commit(spark.range(5), after=1)
    for n in (5, 6):
        t.commit(spark.range(n))
    assert t.read().count() == 6 and len(store.folders(spark, t.path)) == 2


def test_store_upkeep(spark, tmp_path):
    import os
    import time

    assert not store.mounted(spark, str(tmp_path / "none")) and not store.mounted(spark, str(tmp_path))
    for name in ("a.tmp", "b.tmp", "c.json"):
        (tmp_path / name).write_text("x")
    os.utime(tmp_path / "a.tmp", (1, 1))
    os.utime(tmp_path / "c.json", (1, 1))
    assert store.mounted(spark, str(tmp_path))
    assert store.sweep_temporary(spark, str(tmp_path), 3600, time.time()) == 1
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["b.tmp", "c.json"]
    left = store.without_documents(spark.range(5).withColumnRenamed("id", "k"), spark.createDataFrame([(1,), (1,), (None,)], "k bigint"), "k")
    assert sorted(r.k for r in left.collect()) == [0, 2, 3, 4]


def test_documents(spark):
    df = spark.createDataFrame([(1, '{"tags":[{"code":1,"name":"a"}],"required":["x"],"other":2}'), (2, "{broken"), (3, None)], "id int, body string")
    rows = {r.id: r for r in store.from_json(df, "id").collect()}
    assert rows[1].readable and rows[1].required == ["x"] and rows[1].preferred is None
    assert not rows[2].readable and rows[2].tags is None and not rows[3].readable
    assert store.too_many_missing(20, 199, 5) and not store.too_many_missing(20, 200, 5) and store.too_many_missing(0, 5, 0)


def test_seeds(spark, tmp_path):
    p = tmp_path / "skill.csv"
    p.write_text("﻿# comment\n\ncode,name,category\n1,Alpha,ETC\n,Beta,ETC\n", encoding="utf-8")
    assert sorted((r.code or 0, r.name) for r in seeds.skills(spark, str(p)).collect()) == [(0, "Beta"), (1, "Alpha")]
    p.write_text("code,name,category\n1,Alpha,ETC\n1,Beta,ETC\n", encoding="utf-8")
    with pytest.raises(seeds.SeedError, match="codes"):
        seeds.skills(spark, str(p))
    p.write_text("code,name,category\n1,Alpha\n", encoding="utf-8")
    with pytest.raises(seeds.SeedError, match="3 fields"):
        seeds.skills(spark, str(p))
    p.write_text("alias,skill,text_match\na,Alpha,2\n", encoding="utf-8")
    with pytest.raises(seeds.SeedError, match="text_match"):
        seeds.aliases(spark, str(p))


def test_skill_plan(spark):
    stored = spark.createDataFrame([(1, 10, "A", "X"), (2, 20, "B", "X"), (3, 30, "C", "X"), (4, 40, "D", "X")], "skill_id bigint, saramin_code int, name string, category string")
    seed = spark.createDataFrame([(30, "A", "Y"), (20, "B2", "Y"), (None, "E", "Y"), (40, "F", "Y")], "code int, name string, category string")
    plan = dimensions.skill_plan(seed, stored)
    assert {(r.action, r.skill_id, r.code, r.name) for r in plan.collect()} == {("update", 1, 30, "A"), ("update", 2, 20, "B2"), ("update", 4, 40, "F"), ("insert", None, None, "E"), ("deactivate", 3, None, "C")}
    after = {r.skill_id: (r.saramin_code, r.name, r.is_active) for r in dimensions.apply_skill_plan(plan, stored).collect()}
    assert after == {1: (30, "A", 1), 2: (20, "B2", 1), 3: (None, "C", 0), 4: (40, "F", 1), 5: (None, "E", 1)}


def test_aliases(spark):
    skills = spark.createDataFrame([("Java",), ("Go",)], "name string")
    listed = spark.createDataFrame([("자바", "Java", 1), ("go", "Go", 0), ("x", "None", 1), ("java", "Go", 1)], "alias string, skill string, text_match int")
    assert {tuple(r) for r in dimensions.alias_conflicts(skills, listed).collect()} == {("unknown skill", "x"), ("name of another skill", "java")}
    good = listed.where("alias in ('자바', 'go')")
    assert {tuple(r) for r in dimensions.resolved_aliases(skills, good).collect()} == {("java", "Java", 1), ("go", "Go", 0), ("자바", "Java", 1)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, s string, n int")
    new = spark.createDataFrame([(1, None, 5), (3, "c", 7)], "k int, s string, n int")
    got = {tuple(r) for r in merge.upsert(old, new, ["k"], {"s": merge.take_if_known, "n": merge.add}).collect()}
    assert got == {(1, "a", 6), (2, "b", 2), (3, "c", 7), (None, "n", 0)}
    assert merge.upsert(old, new.limit(0), ["k"], {}).count() == 3


STATE = "posting_id bigint, title string, deadline_type string, deadline_on date, detail_fail_cnt int, list_modified_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
SEEN = "posting_id bigint, title string, blank boolean, type string, date date, unknown boolean, modified_at timestamp_ntz, tolerance int, now timestamp_ntz"


def test_list_upsert(spark):
    day, t0, now = datetime(2026, 3, 10).date(), datetime(2026, 3, 1), datetime(2026, 3, 9)
    later = datetime(2026, 3, 20).date()
    state = [(i, f"t{i}", "DATE", day, 2, t0, t0, t0) for i in range(1, 8)] + [(8, "t8", "ALWAYS", None, 2, None, t0, t0)]
    seen = [
        (1, "x", False, "ROLLING", None, False, None, 60, now), (2, "x", False, "DATE", later, False, None, 60, now), (3, "x", False, "DATE", t0.date(), False, None, 60, now), (4, "", True, "DATE", None, True, None, 60, now),
        (5, "x", False, "DATE", None, True, t0 + timedelta(minutes=60), 60, now), (6, "x", False, "DATE", None, True, t0 + timedelta(minutes=61), 60, now), (8, "x", False, "DATE", later, False, t0, 60, now),
        (9, " neu ", False, "DATE", later, False, now, 60, now), (10, " ", True, "DATE", None, True, None, 60, now),
    ]
    got = {r.posting_id: r for r in postings.list_upsert(spark.createDataFrame(state, STATE), spark.createDataFrame(seen, SEEN)).collect()}
    assert {i: (r.deadline_type, r.deadline_on, r.detail_fail_cnt) for i, r in got.items()} == {
        1: ("ROLLING", None, 2), 2: ("DATE", later, 2), 3: ("DATE", day, 2), 4: ("DATE", day, 2), 5: ("DATE", day, 2), 6: ("DATE", day, 0), 7: ("DATE", day, 2), 8: ("DATE", later, 0), 9: ("DATE", later, 0),
    }
    assert got[9].title == "neu" and got[9].change == "inserted" and got[7].change == "kept" and got[7].last_seen_at == t0 and got[4].last_seen_at == now
    assert postings.list_upsert(spark.createDataFrame([], STATE), spark.createDataFrame([], SEEN)).count() == 0


def test_details_saved(spark):
    schema = "posting_id bigint, career_type string, exp_min int, exp_max int, education string, employment_type string, region string, posted_on date, deadline_on date, detail_at timestamp_ntz, detail_fail_cnt int, other string"
    day = datetime(2026, 1, 2).date()
    state = spark.createDataFrame([(1, None, None, None, None, None, None, None, day, None, 2, "o"), (2, "NEW", 1, 2, "e", "m", "r", day, day, datetime(2026, 1, 1), 1, "o"), (3, "NEW", 1, 2, "e", "m", "r", day, day, None, 0, None)], schema)
    pages = html.detail_pages(spark.createDataFrame([(1, DETAIL.format(req="a", end="채용시")), (2, "no page")], "posting_id bigint, html string"))
    got = {r.posting_id: r for r in postings.save_details(state, pages, F.lit("2026-10-02 00:00:00").cast("timestamp_ntz")).collect()}
    assert (got[1].career_type, got[1].exp_min, got[1].posted_on, got[1].deadline_on, got[1].detail_fail_cnt, got[1].other) == (None, None, datetime(2026, 10, 1).date(), day, 0, "o")
    assert got[2].detail_fail_cnt == 1 and got[3].detail_at is None
    failed = {r.posting_id: r.detail_fail_cnt for r in postings.add_failures(state, spark.createDataFrame([(1,), (1,), (None,), (9,)], "posting_id bigint")).collect()}
    assert failed == {1: 4, 2: 1, 3: 0}
    again = {r.posting_id: (r.detail_at, r.detail_fail_cnt) for r in postings.forget_details(state, spark.createDataFrame([(2,), (2,), (None,)], "posting_id bigint")).collect()}
    assert again == {1: (None, 2), 2: (None, 0), 3: (None, 0)}


def test_dimension_merges(spark):
    jobs = dimensions.job_merge(spark.createDataFrame([(1, 84, "a", 1), (2, 99, "old", 2)], "job_id bigint, code int, name string, sort_order int"), spark.createDataFrame([(84, "b", 2), (85, "c", 1), (None, "x", 3)], "code int, name string, position int"))
    assert {tuple(r) for r in jobs.collect()} == {(1, 84, "b", 2), (2, 99, "old", 2), (3, 85, "c", 1)}
    stored = spark.createDataFrame([(1, "k1", "A", None, None), (2, None, "B", "g", None), (3, None, "B", None, None), (4, "k1", "A2", None, None)], "company_id bigint, saramin_csn string, name string, group_name string, size_label string")
    seen = spark.createDataFrame([("k1", "A new", "g", "s", 2), ("k1", "A older", None, None, 1), (None, "B", None, None, 1), (None, "C", None, None, 1), (None, "C", "g", None, 2), ("k2", None, None, None, 1), (None, None, None, None, 1)], "csn string, name string, group_name string, size_label string, at int")
    got = {tuple(r) for r in dimensions.company_merge(stored, seen).collect()}
    assert {r for r in got if r[0] <= 4} == {(1, "k1", "A new", "g", "s"), (2, None, "B", "g", None), (3, None, "B", None, None), (4, "k1", "A2", None, None)}
    assert {r[0] for r in got if r[0] > 4} == {5, 6} and {r[1:] for r in got if r[0] > 4} == {("k2", None, None, None), (None, "C", "g", None)}
    aliases = dimensions.alias_merge(spark.createDataFrame([("자바", "Java", 1)], "alias string, skill string, text_match int"), spark.createDataFrame([(7, "Java")], "skill_id bigint, name string"))
    assert [tuple(r) for r in aliases.collect()] == [("자바", 7, 1)]


def test_migration(spark):
    old = spark.createDataFrame([(1, 5, "Java", "LANGUAGE", "x")], "skill_id int, saramin_code int, name string, category string, extra string")
    new = schemas.migrated(old, "skill")
    assert new.columns == ["skill_id", "saramin_code", "name", "category", "is_active", "extra"] and tuple(new.first()) == (1, 5, "Java", "LANGUAGE", 1, "x")
    assert schemas.migrated(new, "skill").collect() == new.collect()
    assert "is_active" not in schemas.columns("skill", 1) and schemas.migrated(spark.createDataFrame([], "posting_id bigint"), "posting_job").columns == ["posting_id", "job_id", "last_seen_at"]


def test_report_file(spark, tmp_path):
    import json

    path = str(tmp_path / "r.json")
    report.export({"totals": spark.createDataFrame([(1, datetime(2026, 1, 2))], "Postings int, At timestamp_ntz"), "jobs": spark.range(3), "none": spark.range(0)}, path)
    assert json.load(open(path)) == {"totals": {"postings": 1, "at": "2026-01-02T00:00:00"}, "jobs": [{"id": 0}, {"id": 1}, {"id": 2}], "none": []}


def test_weights_of_many_jobs(spark):
    p = spark.createDataFrame([(i, 0, datetime(2026, 1, 1), 0) for i in range(1, 4)], "posting_id bigint, is_closed int, detail_at timestamp_ntz, is_excluded int")
    jobs = spark.createDataFrame([(1, f"j{k}") for k in range(23)] + [(2, "j0"), (3, "j0"), (3, "j1")], "posting_id bigint, job string")
    skills = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "posting_id bigint, skill_id bigint")
    got = {(r.job, r.skill_id): r.ratio for r in stats.job_skill_stat(p, jobs, skills, spark.createDataFrame([(1, 1), (2, 1)], "skill_id bigint, is_active int")).collect()}
    from fractions import Fraction

    share = (Fraction(1, 23) + Fraction(1, 2)) / (Fraction(1, 23) + 1 + Fraction(1, 2))
    assert float(got["j0", 1]) == round(float(share), 4) and float(got["j5", 1]) == 1.0


def test_query_with_parameters(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "skill.parquet"))
    rows = session.query(spark, str(tmp_path), "SELECT id FROM skill WHERE id > :least AND :name = 'x; DROP'", least=2, name="x; DROP").collect()
    assert sorted(r.id for r in rows) == [3, 4]
    waits = spark.createDataFrame([("5",), (" 9999 ",), ("Wed, 21 Oct",), (None,), ("1234567",)], "v string").select(columns.retry_after_ms(F.col("v"))).collect()
    assert [r[0] for r in waits] == [5000, 600_000, 0, 0, 0]
    assert selection.code_map(spark.createDataFrame([(7, 2), (7, 1), (None, 3)], "code int, id bigint"), "code", "id") == {7: 1}
    links = spark.createDataFrame([("a",), ("b",), (None,)], "job string")
    assert [r.job for r in selection.of_jobs(links, ["a", "c"]).collect()] == ["a"]


def test_a_cluster_needs_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())


def test_two_drivers(spark, tmp_path):
    a, b = Runner(spark, str(tmp_path)), Runner(spark, str(tmp_path))
    t0 = datetime(2026, 1, 1)
    version, rows = a._rows()
    run = b.start(t0)  # between the other's look at the ledger and its write
    with pytest.raises(store.Conflict):
        a.ledger.commit(rows, after=version)
    with pytest.raises(RunInProgress):
        a.start(t0)
    assert a.running() == 1
    b.finish(run, t0, True)
    assert a.running() == 0


def test_runner(spark, tmp_path):
    r = Runner(spark, str(tmp_path))
    t0 = datetime(2026, 1, 1)
    first = r.start(t0)
    with pytest.raises(RunInProgress):
        r.start(t0 + timedelta(minutes=30))
    second = r.start(t0 + timedelta(minutes=61))  # the first gave no sign of life
    r.finish(first, t0, True)
    r.finish(second, t0, True, {"new_cnt": 4})
    clock = lambda: t0 + timedelta(hours=2)
    with pytest.raises(ZeroDivisionError):
        r.run([("a", lambda: {"list_cnt": 1}), ("b", lambda: 1 // 0)], clock)
    rows = {x.run_id: (x.status, x.new_cnt, x.list_cnt) for x in r.ledger.read().collect()}
    assert rows == {1: ("FAILED", 0, 0), 2: ("DONE", 4, 0), 3: ("FAILED", 0, 1)}


def test_stream(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])
    src, table = str(tmp_path / "in"), store.VersionedTable(spark, str(tmp_path / "t"))
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    put([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (None, 1, "x")])
    deliveries.latest_by_key(spark, src, schema, table, str(tmp_path / "c"), key="k", order=["at"])
    put([(1, 6, "late"), (2, 3, "d")])
    deliveries.latest_by_key(spark, src, schema, table, str(tmp_path / "c"), key="k", order=["at"])
    assert {tuple(r) for r in table.read().collect()} == {(1, 7, "b"), (2, 3, "d")}
    assert table.read().where(F.col("k").isNull()).count() == 0
