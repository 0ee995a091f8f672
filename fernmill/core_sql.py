"""The core queries in SQL, written apart from the operators, for comparison."""

_CUR = """
    cur AS (SELECT * FROM posting WHERE posting_id IS NOT NULL AND snap_no = (SELECT max(snap_no) FROM posting)
            QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY last_seen_at DESC NULLS LAST, row_id DESC) = 1)"""
_PRE = """
    pre AS (SELECT * FROM posting WHERE posting_id IS NOT NULL
              AND snap_no = (SELECT max(snap_no) FROM posting WHERE snap_no < (SELECT max(snap_no) FROM posting))
            QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY last_seen_at DESC NULLS LAST, row_id DESC) = 1)"""
_PJ = """
    pj AS (SELECT posting_id, regexp_extract(region, '^\\s*(\\S+)', 1) AS job, max(snap_no) AS last_snap FROM posting
           WHERE posting_id IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2 HAVING regexp_extract(region, '^\\s*(\\S+)', 1) <> '')"""
_ACT = """
    act AS (SELECT DISTINCT x.posting_id, x.skill_id FROM posting_skill x JOIN skill k ON k.skill_id = x.skill_id WHERE k.is_active = 1)"""
_STORED = r"CASE WHEN regexp_full_match(list_modified_at, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}') THEN TRY_CAST(list_modified_at AS TIMESTAMP) END"
_NOW = "CAST(floor(epoch(seen_at)) AS BIGINT)"
_DAY = "(DATE '1970-01-01' + CAST(floor(epoch(seen_at) / 86400) AS INTEGER))"


def _date(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"


def _near(m: str, d: str) -> str:
    tries = [_date(f"CAST(year(today) + {k} AS INTEGER)", m, d) for k in (-1, 0, 1)]
    return "coalesce(" + ", ".join(f"CASE WHEN {t} >= today - 30 THEN {t} END" for t in tries) + ")"


def _num(c: str, p: str, g: int) -> str:
    return f"TRY_CAST(regexp_extract({c}, '{p}', {g}) AS INTEGER)"


_FULL = r"~\s*(\d{4})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})(?:\D|$)"
_MD = r"~\s*(\d{1,2})\s*[./]\s*(\d{1,2})(?:\D|$)"
_CLOSE = r"(?:^|[^0-9.~/])(\d{1,2})\s*[./]\s*(\d{1,2})(?:(?:\s*\([^)]*\)\s*|\s+)(?:\d{1,2}\s*(?:시|:\s*\d{2}))?)?\s*마감"
_AGO = r"(?:^|\D)(\d{1,4})\s*(분|시간|일)\s*전\s*(등록|수정)"
_WORD = r"(방금\s*전|어제)\s*(등록|수정)"
_BETWEEN = r"(?:^|\D)(\d{1,2})\s*년?\s*[~\-]\s*(\d{1,2})\s*년"
_OPEN = r"(?:^|\D)(\d{1,2})(?:\s*년\s*[~\-]|\s*년?\s*[~\-]\s*\d{3,})"
_LEAST = r"(?:^|\D)(\d{1,2})\s*년\s*(?:↑|이상)"
_MOST = r"(?:^|\D)(\d{1,2})\s*년\s*(?:↓|이하)"
_TRIM = r"regexp_replace(regexp_replace({}, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"
_NORM = "trim(regexp_replace(lower(nfc_normalize({})), '[ \\t]+', ' ', 'g'))"

SQL: dict[str, str] = {
    "p7_found": """
        WITH one AS (
            SELECT * FROM posting WHERE posting_id IS NOT NULL AND snap_no IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY snap_no, posting_id ORDER BY last_seen_at DESC NULLS LAST, row_id DESC) = 1),
        s AS (SELECT snap_no, lag(snap_no) OVER (ORDER BY snap_no) AS prev FROM (SELECT DISTINCT snap_no FROM one)),
        cur AS (SELECT one.*, s.prev FROM one JOIN s USING (snap_no) WHERE s.prev IS NOT NULL),
        prv AS (SELECT one.*, s.snap_no AS next_no FROM one JOIN s ON s.prev = one.snap_no)
        SELECT coalesce(c.snap_no, p.next_no)::BIGINT AS snap_no, coalesce(c.posting_id, p.posting_id) AS posting_id,
               CASE WHEN p.posting_id IS NULL THEN 'added' WHEN c.posting_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM cur c FULL JOIN prv p ON p.next_no = c.snap_no AND p.posting_id = c.posting_id
        WHERE p.posting_id IS NULL OR c.posting_id IS NULL
           OR c.company_id IS DISTINCT FROM p.company_id OR c.title IS DISTINCT FROM p.title OR c.region IS DISTINCT FROM p.region
           OR c.deadline_on IS DISTINCT FROM p.deadline_on OR c.is_closed IS DISTINCT FROM p.is_closed
           OR date_trunc('second', c.closed_at) IS DISTINCT FROM date_trunc('second', p.closed_at)
           OR date_trunc('second', c.first_seen_at) IS DISTINCT FROM date_trunc('second', p.first_seen_at)""",
    "job_skill_stat": f"""
        WITH {_CUR}, {_PJ}, {_ACT},
        base AS (SELECT posting_id FROM cur WHERE is_closed = 0 AND detail_at IS NOT NULL AND is_excluded = 0 AND posting_id IN (SELECT posting_id FROM act)),
        pw AS (SELECT posting_id, job, 232792560 // count(*) OVER (PARTITION BY posting_id) AS w FROM pj WHERE posting_id IN (SELECT posting_id FROM base)),
        jt AS (SELECT job, count(*) AS total, CAST(sum(w) AS HUGEINT) AS whole FROM pw GROUP BY job),
        js AS (SELECT job, skill_id, count(*) AS cnt, CAST(sum(w) AS HUGEINT) AS part FROM pw JOIN act USING (posting_id) GROUP BY 1, 2)
        SELECT js.job, skill_id, cnt AS posting_cnt, total AS job_total,
               CAST(((20000 * part + whole) // (2 * whole)) / 10000.0 AS DECIMAL(5,4)) AS ratio,
               row_number() OVER (PARTITION BY js.job ORDER BY part DESC, cnt DESC, skill_id) AS rank_no
        FROM js JOIN jt USING (job)""",
    "stat_top20": """
        SELECT t.calc_date, t.job_id, t.rank_no, s.name AS skill, s.category, t.posting_cnt, t.job_total, t.ratio
        FROM job_skill_stat t JOIN skill s USING (skill_id)
        WHERE t.calc_date = (SELECT max(calc_date) FROM job_skill_stat) AND t.rank_no BETWEEN 1 AND 20""",
    "stat_replace_day": """
        WITH top AS (SELECT max(calc_date) AS m FROM job_skill_stat WHERE rank_no BETWEEN 1 AND 20 AND calc_date = (SELECT max(calc_date) FROM job_skill_stat) AND skill_id IN (SELECT skill_id FROM skill))
        SELECT calc_date, count(*) AS cnt, CAST(sum(posting_cnt) AS BIGINT) AS posting_cnt FROM job_skill_stat, top
        WHERE calc_date IS DISTINCT FROM top.m OR (rank_no BETWEEN 1 AND 20 AND skill_id IN (SELECT skill_id FROM skill)) GROUP BY 1""",
    "report_totals": f"""
        WITH {_CUR}, {_PJ}, {_ACT}
        SELECT (SELECT count(*) FROM cur) AS postings, (SELECT count(*) FROM cur WHERE is_closed = 0) AS open_postings,
               (SELECT count(*) FROM cur WHERE is_closed = 0 AND detail_at IS NOT NULL) AS with_detail,
               (SELECT count(*) FROM cur WHERE is_closed = 0 AND detail_at IS NULL AND detail_fail_cnt > 0) AS fail_now,
               (SELECT count(*) FROM cur WHERE is_closed = 0 AND detail_fail_cnt >= 3) AS fail_resting,
               (SELECT count(*) FROM cur WHERE is_closed = 0 AND detail_at IS NOT NULL AND posting_id NOT IN (SELECT posting_id FROM act WHERE posting_id IS NOT NULL)) AS no_skill,
               (SELECT count(*) FROM cur WHERE is_closed = 0 AND is_excluded = 1) AS excluded,
               (SELECT count(*) FROM cur WHERE is_closed = 0 AND detail_at IS NOT NULL AND is_excluded = 0 AND posting_id IN (SELECT posting_id FROM act)) AS stat_base,
               (SELECT count(*) FROM company) AS companies,
               (SELECT count(*) FROM pj WHERE posting_id IN (SELECT posting_id FROM cur WHERE is_closed = 0)) AS posting_jobs,
               (SELECT count(*) FROM skill WHERE is_active = 1) AS skills, (SELECT count(DISTINCT skill_id) FROM act) AS skills_seen,
               (SELECT count(*) FROM posting_skill) AS posting_skills""",
    "report_jobs": f"""
        WITH {_CUR}, {_PJ}, {_ACT}, k AS (SELECT posting_id, count(*) AS k FROM pj GROUP BY 1),
        o AS (SELECT c.*, c.posting_id IN (SELECT posting_id FROM act) AS has_skill FROM cur c WHERE is_closed = 0)
        SELECT pj.job, count(o.posting_id) AS open_postings, count(*) FILTER (o.detail_at IS NOT NULL) AS with_detail,
               count(*) FILTER (o.is_headhunting = 1) AS headhunting, count(*) FILTER (o.career_type IN ('NEW', 'NEW_OR_EXP', 'ANY')) AS newcomer_ok,
               count(*) FILTER (o.detail_at IS NOT NULL AND NOT o.has_skill) AS no_skill,
               count(*) FILTER (o.posting_id IS NOT NULL AND k.k = 1) AS only_this_job, count(*) FILTER (o.is_excluded = 1) AS excluded,
               count(*) FILTER (o.detail_at IS NOT NULL AND o.is_excluded = 0 AND o.has_skill) AS stat_base,
               count(*) FILTER (o.detail_at IS NOT NULL AND o.is_excluded = 0 AND o.has_skill AND k.k = 1) AS only_this_job_base
        FROM pj JOIN k USING (posting_id) LEFT JOIN o ON o.posting_id = pj.posting_id GROUP BY 1""",
    "report_sources": "SELECT source, count(*) AS cnt, count(DISTINCT posting_id) AS postings FROM posting_skill GROUP BY 1",
    "report_categories": """
        SELECT s.category, count(DISTINCT p.posting_id) AS postings, count(DISTINCT p.skill_id) AS skills FROM posting_skill p JOIN skill s USING (skill_id) GROUP BY 1""",
    "report_careers": f"WITH {_CUR} SELECT coalesce(career_type, '(없음)') AS career_type, count(*) AS cnt FROM cur WHERE is_closed = 0 AND detail_at IS NOT NULL GROUP BY 1",
    "report_deadlines": f"WITH {_CUR} SELECT deadline_type, count(*) AS cnt FROM cur WHERE is_closed = 0 GROUP BY 1",
    "report_text_only": f"""
        WITH {_CUR} SELECT s.name AS skill, count(DISTINCT p.posting_id) AS postings FROM posting_skill p JOIN skill s USING (skill_id)
        WHERE s.saramin_code IS NULL AND p.source IN ('REQUIRED', 'PREFERRED') AND p.posting_id IN (SELECT posting_id FROM cur WHERE is_closed = 0)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "report_runs": """
        SELECT snap_no, max(snap_on) AS snap_on, count(*) AS list_cnt, count(DISTINCT posting_id) AS postings, count(*) FILTER (is_closed = 1) AS closed_cnt
        FROM posting GROUP BY 1 ORDER BY 1 DESC LIMIT 10""",
    "open_per_job": f"WITH {_CUR}, {_PJ} SELECT job, count(*) AS open_postings FROM pj WHERE posting_id IN (SELECT posting_id FROM cur WHERE is_closed = 0) GROUP BY 1",
    "detail_targets": f"""
        WITH {_CUR} SELECT posting_id FROM cur
        WHERE is_closed = 0 AND coalesce(detail_fail_cnt, 0) < 3 AND (detail_at IS NULL OR {_STORED} > detail_at)""",
    "skill_targets": f"WITH {_CUR} SELECT posting_id FROM cur WHERE is_closed = 0 AND detail_at IS NOT NULL",
    "missing_guard_job": f"""
        WITH {_CUR}, {_PRE}, {_PJ}, m AS (
            SELECT job, count(*) FILTER (pre.posting_id NOT IN (SELECT posting_id FROM cur)) AS missing, count(*) AS open_before
            FROM pre JOIN pj USING (posting_id) WHERE is_closed = 0 GROUP BY 1)
        SELECT *, open_before >= 20 AND missing * 10 > open_before AS blocked FROM m""",
    "missing_guard_overall": f"""
        WITH {_CUR}, {_PRE}, m AS (SELECT count(*) FILTER (posting_id NOT IN (SELECT posting_id FROM cur)) AS missing, count(*) AS open_before FROM pre WHERE is_closed = 0)
        SELECT *, open_before >= 1 AND missing * 10 > open_before AS blocked FROM m""",
    "stale_link_guard": f"""
        WITH {_CUR}, {_PJ}, m AS (
            SELECT job, count(*) FILTER (last_snap < (SELECT max(snap_no) FROM posting)) AS stale, count(*) AS links FROM pj WHERE posting_id IN (SELECT posting_id FROM cur) GROUP BY 1)
        SELECT *, links >= 20 AND stale * 10 > links AS blocked FROM m""",
    "unlink_unconfirmed": f"""
        WITH {_CUR}, {_PJ}, m AS (
            SELECT job, count(*) FILTER (last_snap < (SELECT max(snap_no) FROM posting)) AS stale, count(*) AS links FROM pj WHERE posting_id IN (SELECT posting_id FROM cur) GROUP BY 1)
        SELECT posting_id, job FROM pj
        WHERE NOT (last_snap < (SELECT max(snap_no) FROM posting) AND job IN (SELECT job FROM m WHERE NOT (links >= 20 AND stale * 10 > links)))""",
    "list_completeness": """
        WITH s AS (SELECT snap_no, count(DISTINCT posting_id) AS seen FROM posting GROUP BY 1), t AS (SELECT *, lag(seen) OVER (ORDER BY snap_no) AS total FROM s)
        SELECT snap_no, seen, total, coalesce(total > 0 AND seen >= total - 2, false) AS complete, coalesce(total >= 20 AND 2 * seen < total, false) AS dropped FROM t""",
    "raw_retention": f"""
        WITH {_CUR} SELECT posting_id, closed_at < TIMESTAMP '2026-12-31' - INTERVAL 120 DAY AS long_gone FROM cur WHERE is_closed = 1 AND closed_at < TIMESTAMP '2026-12-31' - INTERVAL 90 DAY""",
    "posting_upsert": f"""
        WITH {_CUR}, {_PRE}
        SELECT coalesce(p.posting_id, c.posting_id) AS posting_id,
               CASE WHEN p.posting_id IS NULL THEN c.title ELSE coalesce(c.title, p.title) END AS title,
               CASE WHEN c.posting_id IS NULL THEN p.region ELSE c.region END AS region,
               greatest(p.deadline_on, c.deadline_on) AS deadline_on,
               CAST(CASE WHEN p.posting_id IS NULL THEN c.detail_fail_cnt WHEN c.posting_id IS NULL THEN p.detail_fail_cnt
                         ELSE c.detail_fail_cnt END AS BIGINT) AS detail_fail_cnt
        FROM pre p FULL JOIN cur c ON p.posting_id = c.posting_id""",
    "company_lookup": """
        WITH s AS (SELECT DISTINCT company_name AS name, company_csn AS csn FROM list_item),
        k AS (SELECT saramin_csn, min(company_id) AS id FROM company WHERE saramin_csn IS NOT NULL GROUP BY 1),
        n AS (SELECT name, min(company_id) AS id FROM company WHERE saramin_csn IS NULL GROUP BY 1)
        SELECT s.name, s.csn, CASE WHEN s.csn IS NOT NULL THEN k.id ELSE n.id END AS company_id
        FROM s LEFT JOIN k ON k.saramin_csn = s.csn LEFT JOIN n ON n.name = s.name""",
    "alias_conflicts": r"""
        WITH n AS (SELECT trim(regexp_replace(lower(name), '[ \t\x{00a0}\x{3000}]+', ' ', 'g')) AS alias, name AS owner FROM skill),
        l AS (SELECT trim(regexp_replace(lower(alias), '[ \t\x{00a0}\x{3000}]+', ' ', 'g')) AS alias, skill, text_match FROM skill_alias WHERE skill IS NOT NULL)
        SELECT 'name stands twice' AS problem, alias FROM n GROUP BY alias HAVING count(*) > 1
        UNION SELECT 'unknown skill', alias FROM l WHERE skill NOT IN (SELECT owner FROM n)
        UNION SELECT 'length of alias', alias FROM l WHERE alias IS NULL OR length(alias) = 0 OR length(alias) > 60
        UNION SELECT 'listed differently', alias FROM (SELECT DISTINCT * FROM l) GROUP BY alias HAVING count(*) > 1
        UNION SELECT 'name of another skill', l.alias FROM l JOIN n USING (alias) WHERE owner <> skill""",
    "skill_sync_plan": """
        WITH s AS (SELECT CAST(saramin_code AS INTEGER) AS code, CASE WHEN category = 'ETC' THEN 'New ' || name ELSE name END AS name, category FROM skill WHERE is_active = 1),
        d AS (SELECT CAST(skill_id AS BIGINT) AS skill_id, CAST(saramin_code AS INTEGER) AS code, name FROM skill),
        u AS (SELECT d.skill_id, s.* FROM s JOIN d USING (name)
              UNION ALL SELECT d.skill_id, s.* FROM s JOIN d ON d.code = s.code WHERE s.name NOT IN (SELECT name FROM d) AND d.name NOT IN (SELECT name FROM s))
        SELECT 'update' AS action, skill_id, code, name, category FROM u
        UNION ALL SELECT 'insert', NULL, code, name, category FROM s WHERE name NOT IN (SELECT name FROM u)
        UNION ALL SELECT 'deactivate', skill_id, CASE WHEN code IN (SELECT code FROM s WHERE code IS NOT NULL) THEN NULL ELSE code END, name, NULL FROM d WHERE skill_id NOT IN (SELECT skill_id FROM u)""",
    "parse_deadline": f"""
        WITH t AS (SELECT item_id, deadline_text AS x, replace(deadline_text, ' ', '') AS t, {_DAY} AS today FROM list_item),
        v AS (SELECT *, {_date(_num('x', _FULL, 1), _num('x', _FULL, 2), _num('x', _FULL, 3))} AS full_date, {_near(_num('x', _MD, 1), _num('x', _MD, 2))} AS tilde,
                     {_near(_num('x', _CLOSE, 1), _num('x', _CLOSE, 2))} AS closes,
                     TRY_CAST(regexp_extract(x, '(?i)(?:^|[^a-z])D\\s*-\\s*(\\d{{1,4}})(?:\\D|$)', 1) AS INTEGER) AS ahead FROM t),
        r AS (SELECT item_id, CASE WHEN x IS NULL OR regexp_full_match(x, '[\\x09-\\x0d\\x1c-\\x20]*') THEN 'unknown'
                   WHEN contains(t, '채용시') THEN 'UNTIL_FILLED' WHEN contains(t, '상시') THEN 'ALWAYS' WHEN contains(t, '수시') THEN 'ROLLING'
                   WHEN full_date IS NOT NULL THEN CAST(full_date AS VARCHAR) WHEN tilde IS NOT NULL THEN CAST(tilde AS VARCHAR) WHEN closes IS NOT NULL THEN CAST(closes AS VARCHAR)
                   WHEN regexp_matches(x, '(?i)(?:^|[^a-z])D\\s*-\\s*day') THEN CAST(today AS VARCHAR) WHEN ahead > 365 THEN 'unknown' WHEN ahead IS NOT NULL THEN CAST(today + ahead AS VARCHAR)
                   WHEN contains(t, '내일') THEN CAST(today + 1 AS VARCHAR) WHEN contains(t, '오늘마감') OR regexp_matches(t, '\\d+시마감') THEN CAST(today AS VARCHAR) ELSE 'unknown' END AS c FROM v)
        SELECT item_id, CASE WHEN c IN ('UNTIL_FILLED', 'ALWAYS', 'ROLLING') THEN c ELSE 'DATE' END AS type, CASE WHEN regexp_matches(c, '^\\d') THEN c END AS date, c = 'unknown' AS unknown FROM r""",
    "parse_posted": f"""
        WITH t AS (SELECT item_id, {_NOW} AS now, posted_text AS x, regexp_extract(posted_text, '{_WORD}', 1) AS w, regexp_extract(posted_text, '{_WORD}', 2) AS wv,
                          TRY_CAST(regexp_extract(posted_text, '{_AGO}', 1) AS INTEGER) AS n, regexp_extract(posted_text, '{_AGO}', 2) AS u, regexp_extract(posted_text, '{_AGO}', 3) AS v FROM list_item),
        r AS (SELECT item_id, CASE WHEN w <> '' THEN wv ELSE v END = '수정' AS modified,
                     CAST(CASE WHEN w = '어제' THEN now - 86400 WHEN w <> '' THEN now ELSE now - n * CASE u WHEN '분' THEN 60 WHEN '시간' THEN 3600 ELSE 86400 END END AS BIGINT) AS at_second,
                     CAST(CASE WHEN w = '어제' THEN 86400 WHEN w <> '' THEN 60 WHEN u = '분' THEN 60 WHEN u = '시간' THEN 3600 ELSE 86400 END AS BIGINT) AS precision_second
              FROM t WHERE w <> '' OR n IS NOT NULL)
        SELECT *, CAST(greatest(precision_second // 60, 60) AS BIGINT) AS tolerance FROM r""",
    "parse_career": f"""
        WITH t AS (SELECT item_id, replace(career_text, ' ', '') AS t FROM list_item),
        v AS (SELECT *, {_num('t', _BETWEEN, 1)} AS b1, {_num('t', _BETWEEN, 2)} AS b2, coalesce({_num('t', _LEAST, 1)}, {_num('t', _OPEN, 1)}) AS lo, {_num('t', _MOST, 1)} AS hi FROM t)
        SELECT item_id, CASE WHEN contains(t, '경력무관') THEN 'ANY' WHEN contains(t, '신입') AND contains(t, '경력') THEN 'NEW_OR_EXP' WHEN contains(t, '신입') THEN 'NEW'
                             WHEN contains(t, '경력') OR b1 IS NOT NULL OR lo IS NOT NULL OR hi IS NOT NULL THEN 'EXPERIENCED' END AS type,
               CASE WHEN b1 IS NOT NULL THEN b1 ELSE lo END AS exp_min, CASE WHEN b1 IS NOT NULL THEN b2 ELSE hi END AS exp_max FROM v""",
    "text_cut": f"""
        SELECT item_id, left({_TRIM.format('title')}, 20) AS title, deadline_text IS NULL OR regexp_full_match(deadline_text, '[\\x09-\\x0d\\x1c-\\x20]*') AS blank FROM list_item""",
    "tag_skills": f"""
        WITH t AS (SELECT raw_id, unnest(tags) AS g FROM raw_document),
        u AS (SELECT raw_id, g FROM t WHERE g.code IS DISTINCT FROM 193 OR raw_id IN (SELECT raw_id FROM t WHERE g.code IN (305, 246, 288, 207, 303))),
        g AS (SELECT raw_id, g.code AS code, {_NORM.format('g.name')} AS alias FROM u),
        a AS (SELECT {_NORM.format('alias')} AS alias, max(skill_id) AS skill_id
              FROM (SELECT l.alias, s.skill_id FROM skill_alias l JOIN skill s ON lower(s.name) = lower(l.skill) UNION SELECT lower(name), skill_id FROM skill) GROUP BY 1 HAVING count(DISTINCT skill_id) = 1),
        r AS (SELECT raw_id, coalesce(s.skill_id, a.skill_id) AS skill_id FROM g LEFT JOIN skill s ON s.saramin_code = g.code AND s.is_active = 1 LEFT JOIN a ON a.alias = g.alias)
        SELECT skill_id, count(*) AS tags, count(DISTINCT raw_id) AS documents FROM r WHERE skill_id IS NOT NULL GROUP BY 1""",
    "unmatched_tags": f"""
        WITH t AS (SELECT raw_id, unnest(tags) AS g FROM raw_document),
        g AS (SELECT g.code AS code, g.name AS name, {_NORM.format('g.name')} AS alias FROM t
              WHERE g.code IS DISTINCT FROM 193 OR raw_id IN (SELECT raw_id FROM t WHERE g.code IN (305, 246, 288, 207, 303))),
        a AS (SELECT {_NORM.format('alias')} AS alias FROM skill_alias l JOIN skill s ON lower(s.name) = lower(l.skill) GROUP BY 1 HAVING count(DISTINCT skill_id) = 1)
        SELECT name, count(*) AS cnt FROM g WHERE name IS NOT NULL AND alias NOT IN (SELECT alias FROM a WHERE alias IS NOT NULL)
          AND (code IS NULL OR code NOT IN (SELECT saramin_code FROM skill WHERE is_active = 1 AND saramin_code IS NOT NULL))
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""",
}

_ONE = "trim(regexp_replace({}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
_EDGE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _lines(c: str) -> str:
    """The lines of a list's texts: no-break spaces as spaces, without white space at the ends, no empty ones."""
    parts = f"flatten(list_transform(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL), lambda x: string_split(x, chr(10))))"
    ends = f"list_transform({parts}, lambda x: regexp_replace(regexp_replace(replace(x, chr(160), ' '), '^{_EDGE}', ''), '{_EDGE}$', ''))"
    return f"array_to_string(list_filter({ends}, lambda x: x <> ''), '|')"


_SEOUL_DAY = "(DATE '1970-01-01' + CAST(floor((floor(epoch(seen_at)) + 32400) / 86400) AS INTEGER))"
_WALL = "(TIMESTAMP '1970-01-01' + to_seconds({} + 32400))"
SQL |= {
    "list_page_items": f"""
        SELECT item_id, posting_id, coalesce({_ONE.format('title')}, '') AS title, coalesce({_ONE.format('company_name')}, '') AS company_name, company_csn,
               {', '.join(f"{_ONE.format(c)} AS {c}" for c in ('group_name', 'size_label'))},
               coalesce(headhunting, false) OR contains(concat_ws(' ', company_name, group_name, size_label), '헤드헌팅') AS headhunting,
               array_to_string(list_filter(list_transform(coalesce(sector_preview, []), lambda x: {_ONE.format('x')}), lambda x: x <> ''), '|') AS sector_preview,
               {', '.join(f"{_ONE.format(c)} AS {c}" for c in ('region', 'career_text', 'education_text', 'deadline_text', 'posted_text'))}
        FROM list_item""",
    "detail_page_fields": f"""
        WITH t AS (SELECT *, list_filter(coalesce(tags, []), lambda t: t.code IS NOT NULL AND t.name IS NOT NULL) AS g FROM raw_document), v AS (SELECT *, len(g) > 0 AS ok FROM t)
        SELECT raw_id, CASE WHEN NOT ok THEN 'no tag with a code' END AS error, CASE WHEN ok THEN {_lines('required')} END AS required, CASE WHEN ok THEN {_lines('preferred')} END AS preferred,
               CASE WHEN ok THEN CAST(len(g) AS BIGINT) END AS tags, CASE WHEN ok THEN CAST(list_sum(list_transform(g, lambda t: t.code)) AS BIGINT) END AS codes,
               CASE WHEN ok THEN CAST(raw_id AS VARCHAR) END AS number, CASE WHEN ok THEN 3 END AS exp_min, CASE WHEN ok THEN 5 END AS exp_max,
               CASE WHEN ok THEN strftime(fetched_at, '%Y-%m-%d %H:%M') END AS start_at
        FROM v""",
    "raw_round_trip": """
        SELECT raw_id, raw_id % 7 <> 0 AS readable,
               CASE WHEN raw_id % 7 <> 0 THEN array_to_string(list_transform(tags, lambda t: concat(coalesce(CAST(t.code AS VARCHAR), '~'), ':', coalesce(t.name, '~'))), '|') END AS tags,
               CASE WHEN raw_id % 7 <> 0 THEN array_to_string(list_transform(required, lambda x: coalesce(x, '~')), '|') END AS required,
               CASE WHEN raw_id % 7 <> 0 THEN array_to_string(list_transform(preferred, lambda x: coalesce(x, '~')), '|') END AS preferred
        FROM raw_document""",
    "list_upsert": f"""
        WITH {_CUR}, st AS (SELECT *, {_STORED} AS lm FROM cur),
        dl AS ({SQL['parse_deadline'].replace(_DAY, _SEOUL_DAY)}), po AS ({SQL['parse_posted']}),
        o AS (SELECT i.posting_id, i.title, regexp_full_match(coalesce(i.title, ''), '[\\x09-\\x0d\\x1c-\\x20]*') OR regexp_full_match(coalesce(i.company_name, ''), '[\\x09-\\x0d\\x1c-\\x20]*') AS blank,
                     dl.type, TRY_CAST(dl.date AS DATE) AS day, dl.unknown AS odd, CASE WHEN po.modified THEN {_WALL.format('po.at_second')} END AS mod, coalesce(po.tolerance, 60) AS tol,
                     {_WALL.format('floor(epoch(i.seen_at))')} AS now
              FROM list_item i JOIN dl USING (item_id) LEFT JOIN po USING (item_id) WHERE i.posting_id IS NOT NULL AND i.seen_at IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY i.posting_id ORDER BY i.seen_at DESC, i.item_id DESC) = 1),
        b AS (SELECT s.posting_id AS sid, o.posting_id AS oid, s.title AS stitle, o.title AS otitle, s.deadline_type, s.deadline_on, s.detail_fail_cnt, s.lm, s.last_seen_at, o.* EXCLUDE (posting_id, title),
                     coalesce(o.mod IS NOT NULL AND (s.lm IS NULL OR o.mod > s.lm + to_minutes(CAST(o.tol AS BIGINT))), false) AS fresh
              FROM st s FULL JOIN o ON s.posting_id = o.posting_id WHERE s.posting_id IS NOT NULL OR NOT o.blank)
        SELECT coalesce(sid, oid) AS posting_id,
               CASE WHEN sid IS NOT NULL THEN stitle ELSE left({_TRIM.format('otitle')}, 300) END AS title,
               CASE WHEN oid IS NULL OR (sid IS NOT NULL AND odd) THEN deadline_type ELSE type END AS deadline_type,
               strftime(CASE WHEN oid IS NULL THEN deadline_on WHEN sid IS NULL THEN day WHEN NOT odd AND type <> 'DATE' AND deadline_type = 'DATE' THEN NULL
                             WHEN day IS NOT NULL AND (deadline_on IS NULL OR deadline_on < day) THEN day ELSE deadline_on END, '%Y-%m-%d') AS deadline_on,
               CAST(coalesce(CASE WHEN oid IS NULL THEN detail_fail_cnt WHEN sid IS NULL OR fresh THEN 0 ELSE detail_fail_cnt END, -1) AS BIGINT) AS detail_fail_cnt,
               strftime(CASE WHEN oid IS NULL OR (sid IS NOT NULL AND NOT fresh) THEN lm ELSE mod END, '%Y-%m-%d %H:%M:%S') AS list_modified_at,
               strftime(CASE WHEN oid IS NULL THEN last_seen_at ELSE now END, '%Y-%m-%d %H:%M:%S') AS last_seen_at,
               CASE WHEN oid IS NULL THEN 'kept' WHEN sid IS NULL THEN 'inserted' ELSE 'updated' END AS change
        FROM b""",
    "link_upsert": """
        SELECT posting_id, size_label AS job, CAST(max(epoch_us(seen_at)) AS BIGINT) AS last_seen FROM list_item
        WHERE posting_id IS NOT NULL AND size_label IS NOT NULL AND seen_at IS NOT NULL GROUP BY 1, 2""",
    "company_upsert": """
        WITH k AS (SELECT * FROM list_item WHERE company_csn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_csn ORDER BY seen_at DESC NULLS LAST, item_id DESC) = 1),
        n AS (SELECT * FROM list_item WHERE company_csn IS NULL AND company_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY seen_at DESC NULLS LAST, item_id DESC) = 1),
        own AS (SELECT saramin_csn, min(company_id) AS company_id FROM company WHERE saramin_csn IS NOT NULL GROUP BY 1)
        SELECT c.saramin_csn, CASE WHEN k.item_id IS NULL THEN c.name ELSE k.company_name END AS name, CASE WHEN k.item_id IS NULL THEN c.group_name ELSE k.group_name END AS group_name,
               CASE WHEN k.item_id IS NULL THEN c.size_label ELSE k.size_label END AS size_label, false AS is_new, c.company_id
        FROM company c LEFT JOIN own ON own.company_id = c.company_id LEFT JOIN k ON k.company_csn = own.saramin_csn
        UNION ALL SELECT company_csn, company_name, group_name, size_label, true, NULL FROM k WHERE company_csn NOT IN (SELECT saramin_csn FROM own)
        UNION ALL SELECT NULL, company_name, group_name, size_label, true, NULL FROM n WHERE company_name NOT IN (SELECT name FROM company WHERE saramin_csn IS NULL AND name IS NOT NULL)""",
}
