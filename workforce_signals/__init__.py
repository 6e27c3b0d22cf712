"""Firm-level workforce measures from job postings and employment histories, on Spark."""

from workforce_signals.functions.text import CORE_TERMS
from workforce_signals.operators.checks import file_count_totals, file_row_counts, reconcile_counts, row_count
from workforce_signals.operators.firms import company_year_person, company_year_share
from workforce_signals.operators.jobs import company_share, flag_jobs, job_scores, yearly_share
from workforce_signals.operators.keywords import first_keyword_hit, flag_keyword, keyword_list
from workforce_signals.operators.linking import link_by_id, link_by_name
from workforce_signals.operators.lookup import lookup, order_output, with_position, write_clustered
from workforce_signals.operators.skills import (
    core_jobs,
    explode_skills,
    repeated_ids,
    skill_scores,
    skill_year_counts,
    terms_df,
    top_skills,
)
from workforce_signals.operators.spells import expand_years, merge_profiles, parse_spells
from workforce_signals.plans.bucketed import bucket_pair, merge_bucketed, open_bucketed, write_bucketed
from workforce_signals.plans.measures import flag_years, merge_with_hits, posting_measure, resume_measure
from workforce_signals.plans.pooled import pooled_scores, pooled_years, replace_years
from workforce_signals.plans.stored import Stored, store
from workforce_signals.sources.ingest import csv_to_parquet, ingest_audited, ingest_postings, read_raw_postings
from workforce_signals.sources.read import (
    list_files,
    read_link,
    read_postings,
    read_profiles_csv,
    read_skill_years,
    read_table,
    require_input,
    with_source_file,
)
from workforce_signals.sources.workbook import read_workbook
from workforce_signals.sources.write import write_counted, write_table, write_year

__all__ = [
    "CORE_TERMS",
    "Stored",
    "bucket_pair",
    "company_share",
    "company_year_person",
    "company_year_share",
    "core_jobs",
    "csv_to_parquet",
    "expand_years",
    "explode_skills",
    "file_count_totals",
    "file_row_counts",
    "first_keyword_hit",
    "flag_jobs",
    "flag_keyword",
    "flag_years",
    "ingest_audited",
    "ingest_postings",
    "job_scores",
    "keyword_list",
    "link_by_id",
    "link_by_name",
    "list_files",
    "lookup",
    "merge_bucketed",
    "merge_profiles",
    "merge_with_hits",
    "open_bucketed",
    "order_output",
    "parse_spells",
    "pooled_scores",
    "pooled_years",
    "posting_measure",
    "read_link",
    "read_postings",
    "read_profiles_csv",
    "read_raw_postings",
    "read_skill_years",
    "read_table",
    "read_workbook",
    "reconcile_counts",
    "repeated_ids",
    "replace_years",
    "require_input",
    "resume_measure",
    "row_count",
    "skill_scores",
    "skill_year_counts",
    "store",
    "terms_df",
    "top_skills",
    "with_position",
    "with_source_file",
    "write_bucketed",
    "write_clustered",
    "write_counted",
    "write_table",
    "write_year",
    "yearly_share",
]
