"""Reference SQL for DuckDB, one statement per query, written apart from the Spark code."""

from __future__ import annotations

import re

from driver_queries.fixtures import AS_OF, DUCK_VIEWS, END_YEAR, FIRST_YEAR, VIEWS
from driver_queries.queries import LOOKUP_ID, REFRESHED_YEAR, SCORE_YEARS, TOP_K

# The core technology terms a posting is matched against.
_CORE = (
    "('ai', 'artificial intelligence', 'ml', 'machine learning', 'nlp', "
    "'natural language processing', 'cv', 'computer vision')"
)

_SKILL_YEARS = """
SELECT e.year, e.skill, count(*) AS cnt,
  cast(sum(CASE WHEN c.job_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS co_jobs_with_ai
FROM {exploded} e LEFT JOIN {core} c ON c.year = e.year AND c.job_id = e.job_id
{where} GROUP BY e.year, e.skill
"""

_SCORES = """
SELECT skill, cast(sum(cnt) AS BIGINT) AS total_cnt, cast(sum(co_jobs_with_ai) AS BIGINT) AS total_co,
  cast(sum(co_jobs_with_ai) AS DOUBLE) / cast(sum(cnt) AS DOUBLE) AS ai_score
FROM skill_years {where} GROUP BY skill {having}
"""

_JOBS = """
SELECT year, job_id, company, company_name, {mean} AS job_ai_score, count(*) AS n_skills,
  count(s.ai_score) AS n_matched_skills,
  cast(CASE WHEN {mean} > 0.1 THEN 1 ELSE 0 END AS INTEGER) AS ai_job
FROM {rows} d LEFT JOIN scores s ON s.skill = d.skill
GROUP BY year, job_id, company, company_name {having}
"""

_ROUNDED = "SELECT * REPLACE (round(job_ai_score, 9) AS job_ai_score) FROM ({jobs})"

_MONTH = "cast(try_strptime(nullif(trim({0}), '') || '-01', '%Y-%m-%d') AS DATE)"


def _position(order: str) -> str:
    keys = ", ".join(f"{key.strip()} NULLS LAST" for key in order.split(","))
    return f"rank() OVER (ORDER BY {keys}) AS position"


CTES = {
    **DUCK_VIEWS,
    "exploded": """
SELECT p.year, cast(p.id AS VARCHAR) AS job_id, p.company, p.company_name, lower(trim(u.x)) AS skill
FROM fx_postings p, unnest(string_split(p.skills_name, '|')) AS u(x)
WHERE p.skills_name <> '' AND u.x <> ''""",
    "exploded_shared": """
SELECT year, cast(cast(cast(company AS DOUBLE) AS BIGINT) AS VARCHAR) AS job_id, company, company_name, skill
FROM exploded""",
    "core_ids": f"SELECT DISTINCT year, job_id FROM exploded WHERE skill IN {_CORE}",
    "core_ids_shared": "SELECT DISTINCT year, job_id FROM exploded_shared WHERE skill = 'nlp'",
    "skill_years": _SKILL_YEARS.format(exploded="exploded", core="core_ids", where=""),
    "scores": _SCORES.format(where="", having="HAVING sum(cnt) >= 50"),
    "job_skills": "SELECT DISTINCT year, job_id, company, company_name, skill FROM exploded",
    "job_skills_shared": "SELECT DISTINCT year, job_id, company, company_name, skill FROM exploded_shared",
    "jobs": _JOBS.format(mean="avg(s.ai_score)", rows="job_skills", having=""),
    "share": """
SELECT year, company, company_name, count(*) AS n_postings, cast(sum(ai_job) AS BIGINT) AS n_ai_jobs,
  avg(cast(ai_job AS DOUBLE)) AS ai_job_share
FROM jobs GROUP BY year, company, company_name""",
    "merged": """
SELECT p.id, p.company, p.company_name, p.title_raw, p.most_recent_company_start_month,
  p.most_recent_company_end_month, d.description_raw
FROM fx_profile p JOIN fx_description d ON d.id = p.id
WHERE p.most_recent_company_start_month IS NOT NULL AND p.company_name IS NOT NULL
  AND d.description_raw IS NOT NULL""",
    "spells": f"""
SELECT cast(id AS VARCHAR) AS id, title_raw AS title_name, company_name AS company_name_raw, description_raw,
  {_MONTH.format("most_recent_company_start_month")} AS job_start_ym,
  {_MONTH.format("most_recent_company_end_month")} AS job_end_ym
FROM merged""",
    "spells_current": f"""
SELECT ID AS id, TITLE_NAME AS title_name, COMPANY_NAME_RAW AS company_name_raw, DESCRIPTION_RAW AS description_raw,
  {_MONTH.format("JOB_START_YM")} AS job_start_ym, {_MONTH.format("JOB_END_YM")} AS job_end_ym,
  coalesce(try_cast(nullif(trim(IS_CURRENT), '') AS INTEGER), 0) AS is_current
FROM fx_sample""",
    "years_current": f"""
SELECT s.id, s.title_name, s.company_name_raw, s.description_raw, cast(y.y AS INTEGER) AS year
FROM (SELECT *, CASE WHEN job_end_ym IS NOT NULL THEN year(job_end_ym) WHEN is_current = 1 THEN {AS_OF} END AS ey
      FROM spells_current) s, range(year(s.job_start_ym), greatest(s.ey, year(s.job_start_ym)) + 1) AS y(y)
WHERE s.job_start_ym IS NOT NULL AND s.ey IS NOT NULL""",
    "keywords": """
SELECT DISTINCT lower(trim(skill)) AS skill
FROM (SELECT * FROM scores ORDER BY ai_score DESC, total_cnt DESC, skill LIMIT 100)
WHERE trim(skill) <> ''""",
    "texts": """
SELECT *, lower(coalesce(title_name, '')) || ' ' || lower(coalesce(description_raw, '')) AS searched FROM spells""",
    "hits": """
SELECT t.id, t.title_name, t.company_name_raw, t.description_raw, t.job_start_ym, t.job_end_ym,
  (SELECT k.skill FROM keywords k WHERE position(k.skill IN t.searched) > 0
   ORDER BY position(k.skill IN t.searched), k.skill LIMIT 1) AS first_hit_skill
FROM texts t""",
    "flagged": f"""
SELECT h.id, h.title_name, h.company_name_raw, h.description_raw, cast(y.y AS INTEGER) AS year,
  cast(CASE WHEN h.first_hit_skill IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS ai_related, h.first_hit_skill
FROM hits h, range(year(h.job_start_ym),
  greatest(coalesce(year(h.job_end_ym), {AS_OF}), year(h.job_start_ym)) + 1) AS y(y)
WHERE h.job_start_ym IS NOT NULL""",
    "persons": """
SELECT lower(trim(company_name_raw)) AS company_key, company_name_raw AS company_name, year, id,
  max(ai_related) AS ai_related_any
FROM flagged GROUP BY 1, 2, 3, 4""",
    "found_current": """
SELECT DISTINCT title_name, description_raw FROM years_current t
WHERE EXISTS (SELECT 1 FROM keywords k
  WHERE position(k.skill IN lower(coalesce(t.title_name, '')) || ' ' || lower(coalesce(t.description_raw, ''))) > 0)""",
    "persons_current": """
SELECT y.company_name_raw AS company_name, y.year, y.id, max(CASE WHEN f.found THEN 1 ELSE 0 END) AS ai_related_any
FROM years_current y LEFT JOIN (SELECT *, true AS found FROM found_current) f
  ON f.title_name IS NOT DISTINCT FROM y.title_name AND f.description_raw IS NOT DISTINCT FROM y.description_raw
GROUP BY 1, 2, 3""",
    "measure_current": """
SELECT company_name, year, count(*) AS employees, cast(sum(ai_related_any) AS BIGINT) AS ai_employees,
  cast(sum(ai_related_any) AS DOUBLE) / count(*) AS ai_measure
FROM persons_current GROUP BY company_name, year""",
    "long_texts": """
SELECT DISTINCT id, title_raw, lower(coalesce(title_raw, '')) || ' ' || lower(description_raw) AS searched FROM merged""",
    "long_found": """
SELECT t.id, t.title_raw, k.skill, position(k.skill IN t.searched) AS pos
FROM long_texts t JOIN (SELECT DISTINCT skill FROM exploded WHERE skill <> '') k ON contains(t.searched, k.skill)
UNION ALL
SELECT t.id, t.title_raw, k.skill, position(k.skill IN t.searched) AS pos
FROM (SELECT * FROM long_texts WHERE contains(searched, 'job ') OR contains(searched, 'task ')) t
JOIN (SELECT 'job ' || o_orderkey AS skill FROM orders UNION ALL SELECT 'task ' || o_orderkey FROM orders) k
  ON contains(t.searched, k.skill)""",
    "long_hits": """
SELECT t.id, t.title_raw, first(f.skill ORDER BY f.pos, f.skill) AS first_hit_skill
FROM long_texts t LEFT JOIN long_found f ON f.id = t.id AND f.title_raw IS NOT DISTINCT FROM t.title_raw
GROUP BY t.id, t.title_raw""",
    "measure": """
SELECT company_name, year, count(*) AS employees, cast(sum(ai_related_any) AS BIGINT) AS ai_employees,
  cast(sum(ai_related_any) AS DOUBLE) / count(*) AS ai_measure
FROM persons GROUP BY company_name, year""",
}

_YEAR = "cast(year AS INTEGER) AS year"

_SELECTS = {
    "q_explode_skills": f"SELECT * REPLACE ({_YEAR}) FROM exploded",
    "q_core_jobs": f"SELECT * REPLACE ({_YEAR}) FROM core_ids",
    "q_core_jobs_term_table": f"SELECT * REPLACE ({_YEAR}) FROM core_ids",
    "q_skill_year_counts": f"SELECT * REPLACE ({_YEAR}) FROM skill_years",
    "q_skill_year_counts_shared_ids": f"SELECT * REPLACE ({_YEAR}) FROM ("
    + _SKILL_YEARS.format(exploded="exploded_shared", core="core_ids_shared", where="")
    + ")",
    "q_skill_counts_no_core": f"SELECT * REPLACE ({_YEAR}) FROM ("
    + _SKILL_YEARS.format(exploded="exploded", core="core_ids", where=f"WHERE e.skill NOT IN {_CORE}")
    + ")",
    "q_skill_scores": "SELECT * FROM scores",
    "q_skill_scores_years": _SCORES.format(
        where=f"WHERE year >= {SCORE_YEARS[0]} AND year <= {SCORE_YEARS[1]}", having=""
    ),
    "q_top_skills": f"SELECT * FROM scores ORDER BY ai_score DESC, total_cnt DESC, skill LIMIT {TOP_K}",
    "q_job_scores": f"SELECT * REPLACE ({_YEAR}) FROM (" + _ROUNDED.format(jobs="SELECT * FROM jobs") + ")",
    "q_job_scores_matched": f"SELECT * REPLACE ({_YEAR}) FROM ("
    + _ROUNDED.format(jobs="SELECT * FROM jobs WHERE n_matched_skills > 0")
    + ")",
    "q_job_scores_zero": f"SELECT * REPLACE ({_YEAR}) FROM ("
    + _ROUNDED.format(jobs=_JOBS.format(mean="avg(coalesce(s.ai_score, 0))", rows="job_skills", having=""))
    + ")",
    "q_job_scores_dups": f"SELECT * REPLACE ({_YEAR}) FROM ("
    + _ROUNDED.format(jobs=_JOBS.format(mean="avg(s.ai_score)", rows="exploded", having=""))
    + ")",
    "q_job_scores_shared_ids": f"SELECT * REPLACE ({_YEAR}) FROM ("
    + _ROUNDED.format(jobs=_JOBS.format(mean="avg(s.ai_score)", rows="job_skills_shared", having=""))
    + ")",
    "q_company_share": f"SELECT * REPLACE ({_YEAR}) FROM share",
    "q_yearly_share": f"SELECT {_YEAR}, avg(cast(ai_job AS DOUBLE)) AS share FROM jobs GROUP BY year",
    "q_link_by_id": f"""
SELECT * REPLACE ({_YEAR}) FROM (SELECT s.*, try_cast(s.company AS DOUBLE) AS company_num, l.*
FROM share s JOIN fx_link l ON try_cast(s.company AS DOUBLE) = l.ID)""",
    "q_link_by_id_nullsafe": f"""
SELECT * REPLACE ({_YEAR}) FROM (
SELECT s.* REPLACE (CASE WHEN s.company_name IS NULL THEN 'n.a.' ELSE s.company END AS company),
  CASE WHEN s.company_name IS NULL THEN NULL ELSE cast(s.company AS DOUBLE) END AS company_num, l.*
FROM share s JOIN fx_link l
  ON (CASE WHEN s.company_name IS NULL THEN NULL ELSE cast(s.company AS DOUBLE) END) IS NOT DISTINCT FROM l.ID)""",
    "q_merge_profiles": "SELECT * FROM merged",
    "q_parse_spells": "SELECT * FROM spells",
    "q_parse_spells_current": "SELECT * FROM spells_current",
    "q_expand_years": f"""
SELECT s.id, s.title_name, s.company_name_raw, s.description_raw, cast(y.y AS INTEGER) AS year
FROM spells s, range(year(s.job_start_ym),
  greatest(coalesce(year(s.job_end_ym), {AS_OF}), year(s.job_start_ym)) + 1) AS y(y)
WHERE s.job_start_ym IS NOT NULL""",
    "q_expand_years_current": "SELECT * FROM years_current",
    "q_resume_measure_current": "SELECT * FROM measure_current",
    "q_first_hit_long_list": """
SELECT m.id, m.title_raw, m.most_recent_company_start_month, h.first_hit_skill
FROM merged m JOIN long_hits h ON h.id = m.id AND h.title_raw IS NOT DISTINCT FROM m.title_raw""",
    "q_link_overlap": f"""
SELECT * REPLACE ({_YEAR}) FROM (
SELECT s.* RENAME (company_name AS company_name_x), try_cast(s.company AS DOUBLE) AS company_num, l.*,
  upper(l.NAME) AS company_name_y
FROM share s JOIN fx_link l ON try_cast(s.company AS DOUBLE) = l.ID)""",
    "q_ordered_skill_years": f"SELECT * REPLACE ({_YEAR}), "
    + _position("co_jobs_with_ai DESC, cnt DESC, skill")
    + " FROM skill_years",
    "q_ordered_jobs": f"SELECT * REPLACE ({_YEAR}), "
    + _position("job_ai_score DESC, n_matched_skills DESC, job_id")
    + " FROM ("
    + _ROUNDED.format(jobs="SELECT * FROM jobs")
    + ")",
    "q_ordered_companies": f"SELECT * REPLACE ({_YEAR}), "
    + _position("ai_job_share DESC, n_postings DESC, company_name")
    + " FROM share",
    "q_ordered_spell_years": f"SELECT *, {_position('id, title_name, year')} FROM flagged",
    "q_ordered_firm_years": f"SELECT *, {_position('company_name, year')} FROM measure",
    "q_keyword_list": "SELECT skill FROM keywords",
    "q_first_hit": "SELECT * FROM hits",
    "q_flag_years": "SELECT * FROM flagged",
    "q_company_year_person": "SELECT * FROM persons",
    "q_company_year_share": "SELECT * FROM measure",
    "q_link_by_name": f"""
SELECT m.*, l.* FROM measure m JOIN fx_link l ON l.NAME = m.company_name
WHERE m.year >= {FIRST_YEAR} AND m.year < {END_YEAR}""",
    "q_src_union_by_name": f"""
SELECT id, company, CASE WHEN id % 2 = 0 THEN company_name END AS company_name, skills_name, {_YEAR}
FROM fx_postings""",
    "q_src_skill_years": f"SELECT * REPLACE ({_YEAR}) FROM skill_years",
    "q_src_csv_roundtrip": "SELECT * REPLACE (nullif(skill, '') AS skill) FROM scores",
    "q_src_csv_mixed_headers": f"""
SELECT nullif(skill, '') AS skill, cast(cnt AS INTEGER) AS cnt, CASE WHEN year % 2 = 1 THEN cast(year AS INTEGER) END AS year
FROM skill_years""",
    "q_src_parquet_before_csv": "SELECT * FROM scores",
    "q_read_link": "SELECT *, 'sub ' || GVKEY AS Unnamed_Sub FROM fx_link",
    "q_src_csv_all_string": """
SELECT ID, nullif(TITLE_NAME, '') AS TITLE_NAME, nullif(COMPANY_NAME_RAW, '') AS COMPANY_NAME_RAW,
  nullif(IS_CURRENT, '') AS IS_CURRENT, nullif(JOB_START_YM, '') AS JOB_START_YM, nullif(JOB_END_YM, '') AS JOB_END_YM,
  nullif(DESCRIPTION_RAW, '') AS DESCRIPTION_RAW
FROM fx_sample""",
    "q_csv_to_parquet": """
SELECT ID, nullif(TITLE_NAME, '') AS TITLE_NAME, nullif(COMPANY_NAME_RAW, '') AS COMPANY_NAME_RAW,
  nullif(IS_CURRENT, '') AS IS_CURRENT, nullif(JOB_START_YM, '') AS JOB_START_YM,
  nullif(nullif(JOB_END_YM, ''), 'n/a') AS JOB_END_YM, nullif(DESCRIPTION_RAW, '') AS DESCRIPTION_RAW
FROM fx_sample""",
    "q_ingest_prune": f"""
SELECT id, 'last_updated_date ' || id AS last_updated_date, 'duplicates ' || id AS duplicates,
  'posted ' || id AS posted, 'expired ' || id AS expired, company, company_name, 'title_name ' || id AS title_name,
  'title_clean ' || id AS title_clean, 'specialized_skills_name ' || id AS specialized_skills_name,
  nullif(skills_name, '') AS skills_name, {_YEAR}, 'month=' || lpad(cast(id % 12 + 1 AS VARCHAR), 2, '0') AS month
FROM fx_postings""",
    "q_file_rowcount_rollup": """
SELECT coalesce(filename, 'Total') AS filename, count(*) AS nrows
FROM (SELECT year || '/month=' || lpad(cast(id % 12 + 1 AS VARCHAR), 2, '0') AS filename FROM fx_postings)
GROUP BY ROLLUP (filename)""",
    "q_reconcile": f"""
SELECT {_YEAR}, count(*) AS rows_before, count(*) AS rows_after, cast(0 AS BIGINT) AS difference
FROM fx_postings GROUP BY year""",
    "q_rowcount": "SELECT count(*) AS n_rows, count(*) AS n_written FROM jobs",
    "q_point_lookup": f"SELECT * FROM fx_profile WHERE id = {LOOKUP_ID}",
    "q_write_year": f"""
SELECT * REPLACE ({_YEAR}) FROM skill_years WHERE NOT (year = {REFRESHED_YEAR} AND skill IN {_CORE})""",
}
_SELECTS["q_point_lookup_clustered"] = _SELECTS["q_point_lookup"]
_SELECTS["q_merge_bucketed"] = _SELECTS["q_merge_profiles"]
_SELECTS["q_pooled_years"] = _SELECTS["q_write_year"]
_SELECTS["q_pooled_refresh"] = _SCORES.format(
    where=f"WHERE NOT (year = {REFRESHED_YEAR} AND skill IN {_CORE})", having="HAVING sum(cnt) >= 50"
)
_SELECTS["q_ingest_members"] = _SELECTS["q_ingest_prune"].replace(
    "'month=' || lpad(cast(id % 12 + 1 AS VARCHAR), 2, '0') AS month", "'all' AS month"
)
_SELECTS["q_file_rowcount_scan"] = _SELECTS["q_file_rowcount_rollup"]
_SELECTS["q_reconcile_scan"] = _SELECTS["q_reconcile"]
_SELECTS["q_link_workbook"] = _SELECTS["q_link_by_id"]
_SELECTS["q_read_workbook"] = "SELECT * FROM fx_link"
_SELECTS["q_posting_measure"] = _SELECTS["q_link_by_id"]
_SELECTS["q_resume_measure"] = _SELECTS["q_link_by_name"]


def _needed(text: str) -> set[str]:
    found = {name for name in CTES if re.search(rf"\b{name}\b", text)}
    return found.union(*(_needed(CTES[name]) for name in found)) if found else found


def _statement(select: str, given: frozenset[str] = frozenset()) -> str:
    needed = _needed(select) - given
    ctes = ",\n".join(f"{name} AS ({body.strip()})" for name, body in CTES.items() if name in needed)
    return f"WITH {ctes}\n{select.strip()}" if ctes else select.strip()


def all_oracles() -> dict[str, str]:
    return {query: _statement(select) for query, select in _SELECTS.items()}


def over_stored_inputs() -> dict[str, str]:
    """The same statements for a database in which the input views already exist."""
    return {query: _statement(select, frozenset(DUCK_VIEWS)) for query, select in _SELECTS.items()}
