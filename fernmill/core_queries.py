"""Queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fernmill.functions import columns, listtexts
from fernmill.operators import dimensions, instants, matcher, merge, postings, report, selection, snapshots, stats
from fernmill.session import state_dir, table
from fernmill.sources import html, store

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # the dictionary of a directory is found again by later calls: they parse only what is new
    return instants.normalised(table(spark, d, "list_item"), table(spark, d, "posting"), instants.ValueDictionary(spark, state_dir(spark, "instants2", d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.posting_changes(table(spark, d, "posting"))


# -- statistic and report -----------------------------------------------------------------
#: The columns of deliveries that the queries on current postings read.
CURRENT = (
    "company_id title region career_type deadline_type deadline_on is_headhunting is_closed is_excluded closed_at first_seen_at last_seen_at list_modified_at detail_at detail_fail_cnt"
).split()


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(current postings, area links, posting skills, skills)."""
    deliveries = table(spark, d, "posting")
    return selection.current(deliveries, *CURRENT), selection.area_links(deliveries), table(spark, d, "posting_skill"), table(spark, d, "skill")


def job_skill_stat(spark: SparkSession, d: str) -> DataFrame:
    return stats.job_skill_stat(*_state(spark, d))


def stat_top20(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_of_latest(table(spark, d, "job_skill_stat"), table(spark, d, "skill"))


def stat_replace_day(spark: SparkSession, d: str) -> DataFrame:
    """The stored statistic with its latest day replaced by that day's first twenty ranks."""
    old = table(spark, d, "job_skill_stat")
    new = stats.top_of_latest(old, table(spark, d, "skill")).select("calc_date", "job_id", "posting_cnt", "ratio")
    return stats.replace_day(old.select("calc_date", "job_id", "posting_cnt", "ratio"), new).groupBy("calc_date").agg(F.count("*").alias("cnt"), F.sum("posting_cnt").cast("bigint").alias("posting_cnt"))


def report_totals(spark: SparkSession, d: str) -> DataFrame:
    posting, links, posting_skill, skill = _state(spark, d)
    return report.totals(posting, table(spark, d, "company"), links, posting_skill, skill)


def report_jobs(spark: SparkSession, d: str) -> DataFrame:
    return report.jobs(*_state(spark, d))


def report_sources(spark: SparkSession, d: str) -> DataFrame:
    return report.sources(table(spark, d, "posting_skill"))


def report_categories(spark: SparkSession, d: str) -> DataFrame:
    return report.categories(table(spark, d, "posting_skill"), table(spark, d, "skill"))


def report_careers(spark: SparkSession, d: str) -> DataFrame:
    return report.careers(_state(spark, d)[0])


def report_deadlines(spark: SparkSession, d: str) -> DataFrame:
    return report.deadlines(_state(spark, d)[0])


def report_text_only(spark: SparkSession, d: str) -> DataFrame:
    posting, _, posting_skill, skill = _state(spark, d)
    return report.text_only(posting, posting_skill, skill)


def report_runs(spark: SparkSession, d: str) -> DataFrame:
    return report.last_runs(table(spark, d, "posting"))


# -- selections and guards ----------------------------------------------------------------
def open_per_job(spark: SparkSession, d: str) -> DataFrame:
    posting, links, _, _ = _state(spark, d)
    return selection.open_per_job(posting, links)


def _typed(posting: DataFrame) -> DataFrame:
    """The postings with the time of their modification, where it is written to the second."""
    return posting.withColumn("list_modified_at", postings.stored_time(F.col("list_modified_at")))


def detail_targets(spark: SparkSession, d: str) -> DataFrame:
    return selection.detail_targets(_typed(_state(spark, d)[0]))


def skill_targets(spark: SparkSession, d: str) -> DataFrame:
    return selection.skill_targets(_state(spark, d)[0])


def _before(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings of the delivery before the last, those of the last, area links)."""
    deliveries = table(spark, d, "posting")
    last = deliveries.agg(F.max("snap_no").alias("snap_no"))
    earlier = deliveries.join(F.broadcast(last), "snap_no", "left_anti")
    return selection.current(earlier, *CURRENT), selection.current(deliveries, *CURRENT), selection.area_links(deliveries)


def missing_guard_job(spark: SparkSession, d: str) -> DataFrame:
    return selection.missing_by_job(*_before(spark, d))


def missing_guard_overall(spark: SparkSession, d: str) -> DataFrame:
    before, now, _ = _before(spark, d)
    return selection.missing_overall(before, now)


def _last_snap(spark: SparkSession, d: str) -> int:
    return table(spark, d, "posting").agg(F.max("snap_no")).first()[0] or 0


def stale_link_guard(spark: SparkSession, d: str) -> DataFrame:
    posting, links, _, _ = _state(spark, d)
    return selection.stale_links(posting, links, _last_snap(spark, d))


def unlink_unconfirmed(spark: SparkSession, d: str) -> DataFrame:
    posting, links, _, _ = _state(spark, d)
    last = _last_snap(spark, d)
    return selection.drop_unconfirmed(links, selection.stale_links(posting, links, last), last).select("posting_id", "job")


def list_completeness(spark: SparkSession, d: str) -> DataFrame:
    """For each delivery whether it has all postings of the one before and whether it dropped by half."""
    sizes = table(spark, d, "posting").groupBy("snap_no").agg(F.countDistinct("posting_id").alias("seen"))
    before = sizes.withColumn("total", F.lag("seen").over(Window.orderBy("snap_no")))  # a row a delivery
    return before.select(
        "snap_no", "seen", "total", selection.list_complete(F.col("total"), F.col("seen")).alias("complete"), F.coalesce(selection.half_dropped(F.col("total"), F.col("seen")), F.lit(False)).alias("dropped")
    )


def raw_retention(spark: SparkSession, d: str) -> DataFrame:
    return selection.retention(_state(spark, d)[0], F.lit("2026-12-31 00:00:00").cast("timestamp_ntz"), 90)


def posting_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The state before the last delivery, after that delivery is merged into it by a rule a column."""
    before, now, _ = _before(spark, d)
    cols = ["posting_id", "title", "region", "deadline_on", "first_seen_at", "last_seen_at", "detail_fail_cnt"]
    rules = {
        "title": merge.take_if_known, "region": merge.take, "deadline_on": merge.later, "first_seen_at": merge.earlier, "last_seen_at": merge.later, "detail_fail_cnt": merge.take,
    }
    return merge.upsert(before.select(*cols), now.select(*cols), ["posting_id"], rules).select("posting_id", "title", "region", "deadline_on", F.col("detail_fail_cnt").cast("bigint").alias("detail_fail_cnt"))


def list_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The current postings after the items of list pages were seen."""
    state = _typed(_state(spark, d)[0]).select(*postings.STATE)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    out = postings.list_upsert(state, postings.seen_in_lists(table(spark, d, "list_item")))
    fails = F.coalesce("detail_fail_cnt", F.lit(-1)).cast("bigint").alias("detail_fail_cnt")
    return out.select("posting_id", "title", "deadline_type", F.date_format("deadline_on", "yyyy-MM-dd").alias("deadline_on"), fails, text("list_modified_at"), text("last_seen_at"), "change")


def link_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Postings with the sizes of company under which list items showed them, with the last time: earlier days merged with later ones."""
    item = table(spark, d, "list_item").where("seen_at is not null").select("posting_id", F.col("size_label").alias("job"), "seen_at")
    cut = item.agg(F.expr("percentile_approx(unix_seconds(seen_at), 0.5, 1000)")).first()[0]
    early, late = (item.where(f"unix_seconds(seen_at) {sign} {cut or 0}") for sign in ("<=", ">"))
    links = early.where("posting_id is not null and job is not null").groupBy("posting_id", "job").agg(F.max("seen_at").alias("last_seen_at"))
    return postings.link_upsert(links, late.withColumnRenamed("seen_at", "now")).select("posting_id", "job", F.unix_micros("last_seen_at").alias("last_seen"))


def company_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The companies after those of list items are merged in, counted a key; new ones are told by their ids."""
    item = table(spark, d, "list_item").select(F.col("company_csn").alias("csn"), F.col("company_name").alias("name"), "group_name", "size_label", F.struct("seen_at", "item_id").alias("at"))
    out = dimensions.company_merge(table(spark, d, "company"), item)
    stored = table(spark, d, "company").agg(F.max("company_id").alias("top"))
    new = F.col("company_id") > F.col("top")  # one row
    return out.crossJoin(F.broadcast(stored)).select("saramin_csn", "name", "group_name", "size_label", new.alias("is_new"), F.when(~new, F.col("company_id")).alias("company_id"))


def company_lookup(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "list_item").select(F.col("company_name").alias("name"), F.col("company_csn").alias("csn"))
    return dimensions.company_keys(table(spark, d, "company"), seen)


def alias_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return dimensions.alias_conflicts(table(spark, d, "skill"), table(spark, d, "skill_alias").where("skill is not null"))


def skill_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan to a seed of the active skills, those of category ETC under new names."""
    stored = table(spark, d, "skill")
    name = F.when(F.col("category") == "ETC", F.concat(F.lit("New "), F.col("name"))).otherwise(F.col("name"))
    seed = stored.where("is_active = 1").select(F.col("saramin_code").cast("int").alias("code"), name.alias("name"), "category")
    return dimensions.skill_plan(seed, stored).select("action", F.col("skill_id").cast("bigint").alias("skill_id"), "code", "name", "category")


# -- texts --------------------------------------------------------------------------------
def _seen(spark: SparkSession, d: str) -> DataFrame:
    """List items with the epoch second and the UTC day at which they were seen."""
    item = table(spark, d, "list_item").withColumn("now_s", F.floor(F.unix_micros("seen_at") / 1_000_000).cast("bigint"))
    return item.withColumn("today", columns.utc_day(F.col("now_s")))


def parse_deadline(spark: SparkSession, d: str) -> DataFrame:
    df = _seen(spark, d).select("item_id", listtexts.deadline(F.col("deadline_text"), F.col("today")).alias("x"))
    return df.select("item_id", F.col("x.type").alias("type"), F.date_format("x.date", "yyyy-MM-dd").alias("date"), "x.unknown")


def parse_posted(spark: SparkSession, d: str) -> DataFrame:
    df = _seen(spark, d).select("item_id", listtexts.posted(F.col("posted_text"), F.col("now_s")).alias("x"))
    return df.where("x is not null").select("item_id", "x.modified", "x.at_second", "x.precision_second", listtexts.tolerance_minutes(F.col("x.precision_second")).alias("tolerance"))


def parse_career(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "list_item").select("item_id", listtexts.career(F.col("career_text")).alias("x"))
    return df.select("item_id", "x.type", "x.exp_min", "x.exp_max")


def text_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "list_item").select("item_id", columns.cut(F.col("title"), 20).alias("title"), columns.is_blank(F.col("deadline_text")).alias("blank"))


def match_documents(spark: SparkSession, d: str) -> DataFrame:
    """The skills whose full names stand in documents, the longest names first."""
    names = table(spark, d, "skill").select(F.lower("name").alias("alias"), "skill_id", F.lit(1).alias("text_match"))
    patterns = matcher.alias_rules(names)
    return matcher.match_names(table(spark, d, "documents"), patterns, key=["doc_id"], text="text")


def _raw_tags(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_document").select("raw_id", F.explode("tags").alias("t"))
    return raw.select(F.col("raw_id").alias("posting_id"), "t.code", "t.name")


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    """(alias, skill_id, text_match) of the aliases whose typed skill is a skill's name."""
    skill = table(spark, d, "skill").select("skill_id", F.lower("name").alias("k"))
    listed = table(spark, d, "skill_alias").select("alias", F.lower("skill").alias("k"), "text_match").join(skill, "k").select("alias", "skill_id", "text_match")
    own = skill.select(F.col("k").alias("alias"), "skill_id", F.lit(1).alias("text_match"))
    return listed.unionByName(own)


def tag_skills(spark: SparkSession, d: str) -> DataFrame:
    resolved = matcher.resolved_tags(_raw_tags(spark, d), table(spark, d, "skill"), _aliases(spark, d))
    return resolved.where("skill_id is not null").groupBy("skill_id").agg(F.count("*").alias("tags"), F.countDistinct("posting_id").alias("documents"))


def unmatched_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tag names that neither a code nor an alias of the list resolves; names of skills count as aliases only if they are listed."""
    skill = table(spark, d, "skill").select("skill_id", F.lower("name").alias("k"))
    listed = table(spark, d, "skill_alias").select("alias", F.lower("skill").alias("k")).join(skill, "k").select("alias", "skill_id")
    return matcher.unmatched_tags(matcher.resolved_tags(_raw_tags(spark, d), table(spark, d, "skill"), listed))


def match_raw_skills(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (raw_id, skill_id, source) of tags and of the texts, by aliases in context."""
    raw = table(spark, d, "raw_document")
    aliases = _aliases(spark, d)
    rules = matcher.alias_rules(aliases)
    lines = lambda *c: F.array_join(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in c]), "\n")
    storage = table(spark, d, "skill").where("lower(name) = 'sas'").agg(F.min("skill_id")).first()[0]
    whole = raw.select(F.col("raw_id").alias("posting_id"), lines("required", "preferred").alias("text"))

    def of(column: str) -> DataFrame:
        found = matcher.match_names(raw.select(F.col("raw_id").alias("posting_id"), lines(column).alias("text")), rules, key=["posting_id"], text="text")
        return matcher.drop_by_context(found, whole, key="posting_id", text="text", skill_id=storage)

    tags = matcher.resolved_tags(_raw_tags(spark, d), table(spark, d, "skill"), aliases)
    return matcher.with_sources(tags, of("required"), of("preferred")).withColumnRenamed("posting_id", "raw_id")


# -- pages and documents ------------------------------------------------------------------
def _escaped(c):  # type: ignore[no-untyped-def]
    s = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def list_page_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of list pages, written as HTML from the list items and read back from it; all thirteen fields."""
    tag = lambda name, cls, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<{name} class="{cls}">'), _escaped(c), F.lit(f"</{name}>"))).otherwise("")
    item = table(spark, d, "list_item").withColumn("sectors", F.array_join(F.transform(F.filter("sector_preview", lambda x: x.isNotNull()), lambda x: F.concat(F.lit("<span>"), _escaped(x), F.lit("</span>"))), ""))
    page = item.select(
        "item_id",
        F.concat(
            F.lit('<html><body><div class="list_body"><div class="list_item" id="rec-'), F.col("posting_id"), F.lit('"><div class="company_nm">'),
            F.when(F.col("company_csn").isNull(), F.lit('<a class="str_tit" href="/c?x=1">')).otherwise(
                F.concat(F.lit('<a class="str_tit" href="/c?x=1&amp;csn='), F.replace(F.replace(_escaped("company_csn"), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit('">'))
            ),
            F.coalesce(_escaped("company_name"), F.lit("")), F.lit("</a>"), tag("span", "main_corp", "group_name"), tag("span", "info_stock", "size_label"), F.when(F.col("headhunting"), "<i>헤드헌팅</i>").otherwise(""),
            F.lit('</div><div class="job_tit"><a href="#">'), F.coalesce(_escaped("title"), F.lit("")), F.lit('</a></div><div class="job_sector">'), F.coalesce("sectors", F.lit("")), F.lit("</div>"),
            tag("p", "work_place", "region"), tag("p", "career", "career_text"), tag("p", "education", "education_text"),
            F.lit('<div class="support_detail">'), tag("span", "date", "deadline_text"), tag("span", "deadlines", "posted_text"), F.lit("</div></div></div></body></html>"),
        ).alias("html"),
    )
    read = html.list_items(page)
    return read.select(*[F.array_join("sector_preview", "|").alias(c) if c == "sector_preview" else c for c in read.columns])


def detail_page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Detail pages, written as HTML from raw documents and read back: lines, tags, summary and period."""
    part = lambda c, inner: F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), inner), "")
    lines = lambda c: part(c, lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>")))
    tag = lambda t: F.concat(F.lit('<a href="/s?cat_kewd='), t["code"].cast("string"), F.lit('">#'), _escaped(t["name"]), F.lit("</a>"))
    raw = table(spark, d, "raw_document").select("raw_id", "required", "preferred", F.filter("tags", lambda t: t["code"].isNotNull() & t["name"].isNotNull()).alias("tags"), F.date_format("fetched_at", "yyyy.MM.dd HH:mm").alias("at"))
    page = raw.select(
        "raw_id",
        F.concat(
            F.lit('<h1 class="tit_job">제목</h1><div class="jv_summary"><dl><dt>경력</dt><dd><strong>경력 3~5년</strong><button>보기</button></dd></dl><dl><dt>번호</dt><dd>'), F.col("raw_id"),
            F.lit('<span style="display:none">숨김</span></dd></dl><div id="details-required-1">'), F.coalesce(lines("required"), F.lit("")), F.lit('</div><div id="details-preferred-1">'),
            F.coalesce(lines("preferred"), F.lit("")), F.lit('</div></div><div class="jv_howto"><dl class="info_period"><dt>시작일</dt><dd>'), F.coalesce("at", F.lit("")), F.lit("</dd></dl></div>"),
            F.lit('<div class="jv_footer"><div class="tags">'), F.coalesce(F.array_join(F.transform("tags", tag), ""), F.lit("")), F.lit("</div></div>"),
        ).alias("html"),
    )
    p = html.detail_pages(page)
    career = listtexts.career(F.col("page.summary")["경력"])
    return p.select(
        "raw_id", "page.error", F.array_join("page.required", "|").alias("required"), F.array_join("page.preferred", "|").alias("preferred"), F.size("page.tags").cast("bigint").alias("tags"),
        F.aggregate("page.tags", F.lit(0).cast("bigint"), lambda s, t: s + t["code"]).alias("codes"), F.col("page.summary")["번호"].alias("number"), career["exp_min"].alias("exp_min"), career["exp_max"].alias("exp_max"),
        F.date_format("page.start_at", "yyyy-MM-dd HH:mm").alias("start_at"),
    )


def raw_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Raw documents written as JSON, each seventh cut off, and read back, with their content."""
    body = store.to_json(table(spark, d, "raw_document"), "raw_id").withColumn("body", F.when(F.col("raw_id") % 7 == 0, F.expr("left(body, length(body) - 1)")).otherwise(F.col("body")))
    text = lambda c: F.array_join(c, "|", "~").alias(c)
    tags = F.array_join(F.transform("tags", lambda t: F.concat_ws(":", F.coalesce(t["code"].cast("string"), F.lit("~")), F.coalesce(t["name"], F.lit("~")))), "|").alias("tags")
    return store.from_json(body, "raw_id").select("raw_id", "readable", tags, text("required"), text("preferred"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p5_found, p7_found, job_skill_stat, stat_top20, stat_replace_day, report_totals, report_jobs, report_sources, report_categories, report_careers, report_deadlines, report_text_only, report_runs,
            open_per_job, detail_targets, skill_targets, missing_guard_job, missing_guard_overall, stale_link_guard, unlink_unconfirmed, list_completeness, raw_retention, posting_upsert, list_upsert, link_upsert, company_lookup, company_upsert,
            alias_conflicts, skill_sync_plan, parse_deadline, parse_posted, parse_career, text_cut, match_documents, tag_skills, unmatched_tags, match_raw_skills, list_page_items, detail_page_fields, raw_round_trip,
        )
    }


def oracle_sql() -> dict[str, str]:
    from fernmill.core_sql import SQL

    return SQL
