"""One query per operator, over whole tables."""

from __future__ import annotations

import gzip
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import workforce_signals as ws
from driver_queries import fixtures as fx
from workforce_signals.operators import lookup
from workforce_signals.operators.spells import SAMPLE_NAMES
from workforce_signals.plans.stored import new_path
from workforce_signals.sources import schemas
from workforce_signals.sources.read import csv_parts

Query = Callable[[SparkSession, str], DataFrame]

LOOKUP_ID = 7
TOP_K = 25
SCORE_YEARS = (1993, 1996)
REFRESHED_YEAR = 1995
BUCKETS, FREQUENT_ROWS = 8, 12
MEMBERS, RANGE_BYTES = 6, 1 << 14


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return ws.read_postings(spark, fx.postings_path(spark, sf))


def _shared_id_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings whose id is the firm's number, so that every id covers many rows."""
    return _postings(spark, sf).withColumn("id", F.col("company").try_cast("double").cast("bigint"))


def _scores(postings: DataFrame, repeated: ws.Stored | None = None, **options) -> DataFrame:
    return ws.skill_scores(ws.skill_year_counts(postings, repeated=repeated), **options)


def _job_scores(spark: SparkSession, sf: str, **options) -> DataFrame:
    postings = _postings(spark, sf)
    repeated = ws.repeated_ids(postings)
    return ws.job_scores(postings, _scores(postings, repeated), repeated=repeated, **options)


def _rounded(jobs: DataFrame) -> DataFrame:
    """Mean scores to nine digits: the last bit of a mean depends on the order of its terms."""
    return jobs.withColumn("job_ai_score", F.round("job_ai_score", 9))


def _merged(spark: SparkSession, sf: str, searched: bool = False) -> DataFrame:
    return ws.merge_profiles(fx.profiles(spark, sf), fx.descriptions(spark, sf, searched))


def _spells(spark: SparkSession, sf: str, searched: bool = False) -> DataFrame:
    return ws.parse_spells(_merged(spark, sf, searched))


def _current_spells(spark: SparkSession, sf: str) -> DataFrame:
    """Spells of the older sample, with texts and the is-current flag."""
    return ws.parse_spells(fx.sample(spark, sf), with_current=True, names=SAMPLE_NAMES)


def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    return ws.keyword_list(ws.top_skills(_scores(_postings(spark, sf))))


def _searched_spells(spark: SparkSession, sf: str) -> DataFrame:
    merged = ws.merge_with_hits(fx.profiles(spark, sf), fx.descriptions(spark, sf), _keywords(spark, sf))
    return ws.parse_spells(merged, keep=["first_hit_skill"])


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return ws.flag_years(_searched_spells(spark, sf), as_of=fx.AS_OF)


def q_explode_skills(spark: SparkSession, sf: str) -> DataFrame:
    return ws.explode_skills(_postings(spark, sf))


def q_core_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return ws.core_jobs(_postings(spark, sf))


def q_core_jobs_term_table(spark: SparkSession, sf: str) -> DataFrame:
    return ws.core_jobs(_postings(spark, sf), ws.terms_df(spark))


def q_skill_year_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ws.skill_year_counts(_postings(spark, sf))


def q_skill_year_counts_shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ws.skill_year_counts(_shared_id_postings(spark, sf), ("nlp",))


def q_skill_counts_no_core(spark: SparkSession, sf: str) -> DataFrame:
    return ws.skill_year_counts(_postings(spark, sf), drop_core=True)


def q_skill_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(_postings(spark, sf))


def q_skill_scores_years(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(_postings(spark, sf), min_jobs=0, years=SCORE_YEARS)


def q_top_skills(spark: SparkSession, sf: str) -> DataFrame:
    return ws.top_skills(_scores(_postings(spark, sf)), TOP_K)


def q_job_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_job_scores(spark, sf))


def q_job_scores_matched(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_job_scores(spark, sf, require_match=True))


def q_job_scores_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_job_scores(spark, sf, unmatched_as_zero=True))


def q_job_scores_dups(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_job_scores(spark, sf, dedup=False))


def q_job_scores_shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    postings = _shared_id_postings(spark, sf)
    return _rounded(ws.job_scores(postings, _scores(_postings(spark, sf))))


def q_company_share(spark: SparkSession, sf: str) -> DataFrame:
    return ws.company_share(_job_scores(spark, sf))


def q_yearly_share(spark: SparkSession, sf: str) -> DataFrame:
    return ws.yearly_share(_job_scores(spark, sf))


def q_link_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return ws.link_by_id(ws.company_share(_job_scores(spark, sf)), fx.link(spark, sf))


def q_link_workbook(spark: SparkSession, sf: str) -> DataFrame:
    """The link table comes as workbooks with row numbers in front."""
    link = ws.read_link(spark, fx.link_workbooks(spark, sf) + "/*.xlsx", index_col=0)
    return ws.link_by_id(ws.company_share(_job_scores(spark, sf)), link)


def q_read_workbook(spark: SparkSession, sf: str) -> DataFrame:
    return ws.read_link(spark, fx.link_workbooks(spark, sf) + "/*.xlsx", index_col=0)


def _unlinkable(spark: SparkSession, sf: str) -> DataFrame:
    """Firm shares in which some firm ids are no numbers."""
    share = ws.company_share(_job_scores(spark, sf))
    return share.withColumn("company", F.when(F.col("company_name").isNotNull(), F.col("company")).otherwise("n.a."))


def q_link_by_id_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    return ws.link_by_id(_unlinkable(spark, sf), fx.link(spark, sf), null_keys_match=True)


def q_merge_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


def q_parse_spells(spark: SparkSession, sf: str) -> DataFrame:
    return _spells(spark, sf)


def q_parse_spells_current(spark: SparkSession, sf: str) -> DataFrame:
    return _current_spells(spark, sf)


def q_expand_years(spark: SparkSession, sf: str) -> DataFrame:
    return ws.expand_years(_spells(spark, sf), fx.AS_OF)


def q_expand_years_current(spark: SparkSession, sf: str) -> DataFrame:
    return ws.expand_years(_current_spells(spark, sf), fx.AS_OF, "flag")


def q_keyword_list(spark: SparkSession, sf: str) -> DataFrame:
    return _keywords(spark, sf)


def q_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    return ws.first_keyword_hit(_spells(spark, sf, searched=True), _keywords(spark, sf))


def q_flag_years(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf)


def q_company_year_person(spark: SparkSession, sf: str) -> DataFrame:
    return ws.company_year_person(_flagged(spark, sf))


def q_company_year_share(spark: SparkSession, sf: str) -> DataFrame:
    return ws.company_year_share(_flagged(spark, sf))


def q_link_by_name(spark: SparkSession, sf: str) -> DataFrame:
    measure = ws.company_year_share(_flagged(spark, sf))
    return ws.link_by_name(measure, fx.link(spark, sf), fx.FIRST_YEAR, fx.END_YEAR)


def q_posting_measure(spark: SparkSession, sf: str) -> DataFrame:
    return ws.posting_measure(_postings(spark, sf), fx.link(spark, sf))


def q_resume_measure(spark: SparkSession, sf: str) -> DataFrame:
    return ws.resume_measure(
        fx.profiles(spark, sf),
        fx.descriptions(spark, sf),
        _keywords(spark, sf),
        fx.link(spark, sf),
        as_of=fx.AS_OF,
        first_year=fx.FIRST_YEAR,
        end_year=fx.END_YEAR,
    )


def q_resume_measure_current(spark: SparkSession, sf: str) -> DataFrame:
    """The older sample end to end: CSV with texts, is-current policy, keywords, firm-year shares."""
    sample = ws.read_profiles_csv(spark, fx.sample_csv(spark, sf))
    return ws.resume_measure(sample, None, _keywords(spark, sf), as_of=fx.AS_OF, open_end="flag", names=SAMPLE_NAMES)


def q_first_hit_long_list(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords from all skills and two for every order, far more than one pattern takes."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    tasks = orders.select(F.explode(F.array(F.lit("Job "), F.lit(" task "))).alias("kind"), "o_orderkey")
    keywords = ws.explode_skills(_postings(spark, sf)).select("skill").distinct()
    keywords = keywords.unionAll(tasks.select(F.concat("kind", "o_orderkey")))
    merged = ws.merge_with_hits(fx.profiles(spark, sf), fx.descriptions(spark, sf), keywords)
    return merged.select("id", "title_raw", "most_recent_company_start_month", "first_hit_skill")


def q_link_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A link table that has a firm name of its own, linked, written and read back."""
    link = fx.link(spark, sf).withColumn("company_name", F.upper("NAME"))
    path = new_path(spark, "linked")
    ws.write_table(ws.link_by_id(ws.company_share(_job_scores(spark, sf)), link), path)
    return spark.read.parquet(path)


def _ordered(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The table written in its order and read back with the place of the first row of each sort key.

    Rows meet those of their key by ranges of the sort key, in which neighbours in the files stay neighbours: what they have in common,
    such as the text of a spell in all of its years, is compressed away.
    """
    path = new_path(df.sparkSession, "ordered")
    ws.write_table(ws.order_output(df, *order), path)
    keys = [c.removeprefix("-") for c in order]
    placed = ws.with_position(df.sparkSession.read.parquet(path)).repartitionByRange(*keys)
    return placed.withColumn("position", F.min("position").over(Window.partitionBy(*keys)))


def _ordered_in_ranges(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The same rows for a table that is wide, and lies in ranges of its first sort keys already.

    Rows of one key are numbered before they are sorted and lie in that order in the files, so the key's first place follows from each row
    itself when it is read back, and no row meets another a second time.
    """
    path, number = new_path(df.sparkSession, "ordered"), "_number"
    rows_of_key = Window.partitionBy(*(c.removeprefix("-") for c in order)).orderBy(F.xxhash64(*df.columns))
    ws.write_table(ws.order_output(df.withColumn(number, F.row_number().over(rows_of_key)), *order, number), path)
    placed = ws.with_position(df.sparkSession.read.parquet(path))
    return placed.withColumn("position", F.col("position") - F.col(number) + 1).drop(number)


def q_ordered_skill_years(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(ws.skill_year_counts(_postings(spark, sf)), lookup.SKILL_YEAR_ORDER)


def q_ordered_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(_rounded(_job_scores(spark, sf)), lookup.JOB_ORDER)


def q_ordered_companies(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(ws.company_share(_job_scores(spark, sf)), lookup.COMPANY_ORDER)


def q_ordered_spell_years(spark: SparkSession, sf: str) -> DataFrame:
    """Spells go to ranges of person and title before they become years, and the years stay there: numbering and sorting them sends
    no row, so a text crosses the network once a spell and not twice a year."""
    ranges = (F.col(c).asc_nulls_last() for c in ("id", "title_name"))
    spells = _searched_spells(spark, sf).repartitionByRange(*ranges)
    return _ordered_in_ranges(ws.flag_years(spells, as_of=fx.AS_OF), lookup.SPELL_YEAR_ORDER)


def q_ordered_firm_years(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(ws.company_year_share(_flagged(spark, sf)), lookup.COMPANY_YEAR_ORDER)


def _side_by_side(jobs: list[Callable[[], None]]) -> None:
    """Several small writes at once; input folders of many years are built so."""
    with ThreadPoolExecutor(8) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def _years(df: DataFrame) -> list[int]:
    return sorted(r["year"] for r in df.select("year").distinct().collect())


def _year_folders(postings: DataFrame, root: str) -> None:
    """Year folders whose files disagree: ids as integers and as doubles, firm name missing in some."""

    def write(year: int) -> None:
        rows, path = postings.where(F.col("year") == year).drop("year"), f"{root}/{year}/parquet"
        rows.where("id % 2 = 0").write.parquet(path)
        odd = rows.where("id % 2 = 1").select("skills_name", "company", F.col("id").cast("double"))
        odd.write.mode("append").parquet(path)

    _side_by_side([lambda y=y: write(y) for y in _years(postings)])


def q_src_union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    postings = _postings(spark, sf)
    root = fx.built(spark, sf, "jobs_by_year", lambda path: _year_folders(postings, path))
    return ws.read_postings(spark, root)


def q_src_skill_years(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly result files, read back as one table."""
    root = new_path(spark, "out")
    counts = ws.store(ws.skill_year_counts(_postings(spark, sf)), "skill_years").df

    def write(year: int) -> None:
        rows = counts.where(F.col("year") == year).drop("year")
        ws.write_table(rows, f"{root}/{year}_skills_counts_co.parquet")

    _side_by_side([lambda y=y: write(y) for y in _years(counts)])
    return ws.read_skill_years(spark, root)


def q_src_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "scores") + "/all_years"
    ws.write_table(_scores(_postings(spark, sf)), path + ".csv", "csv")
    return ws.read_table(spark, path, schema=schemas.SKILL_SCORE)


def q_src_csv_mixed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files without a known schema that disagree on the order and the number of their columns."""
    root, counts = new_path(spark, "mixed"), ws.skill_year_counts(_postings(spark, sf))
    counts = ws.store(counts, "skill_years").df
    ws.write_table(counts.where("year % 2 = 0").select("skill", "cnt"), f"{root}/a", "csv")
    ws.write_table(counts.where("year % 2 = 1").select("cnt", "skill", "year"), f"{root}/b", "csv")
    return ws.read_table(spark, f"{root}/*", "csv")


def q_read_link(spark: SparkSession, sf: str) -> DataFrame:
    """A link CSV with row numbers in front and a column whose name looks like one made up for such numbers."""
    link = fx.link(spark, sf).withColumn("Unnamed_Sub", F.concat(F.lit("sub "), "GVKEY"))
    path = new_path(spark, "link") + ".csv"
    ws.write_table(link.select(F.xxhash64("GVKEY").alias("idx"), "*"), path, "csv")
    return ws.read_link(spark, path, index_col=0)


def q_src_parquet_before_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Both formats lie there; the CSV holds other rows."""
    path, scores = new_path(spark, "scores") + "/all_years", ws.store(_scores(_postings(spark, sf)), "scores").df
    ws.write_table(scores, path + ".parquet")
    ws.write_table(scores.limit(3), path + ".csv", "csv")
    return ws.read_table(spark, path, schema=schemas.SKILL_SCORE)


def q_src_csv_all_string(spark: SparkSession, sf: str) -> DataFrame:
    return ws.read_profiles_csv(spark, fx.sample_csv(spark, sf))


def q_csv_to_parquet(spark: SparkSession, sf: str) -> DataFrame:
    dst = new_path(spark, "profile")
    ws.csv_to_parquet(spark, fx.sample_csv(spark, sf), dst)
    return ws.read_table(spark, dst)


def _write_extracts(postings: DataFrame, path: str) -> None:
    """Raw extracts: one folder per year and month of gzip CSV files with more columns than are kept.

    Odd years have their columns the other way round and one more, so that headers differ.
    """
    raw = postings.select(
        F.lit("full text, of no use here").alias("body"),
        *(
            F.col(c) if c in postings.columns else F.concat(F.lit(c + " "), F.col("id")).alias(c)
            for c in schemas.RAW_POSTING.names
        ),
        F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0").alias("month"),
        "year",
    )

    def write(year: int) -> None:
        rows = raw.where(F.col("year") == year).drop("year").repartition("month")
        if year % 2:
            rows = rows.select(F.lit("more").alias("more"), *reversed(rows.columns))
        (
            rows.write.partitionBy("month")
            .options(header=True, quote='"', escape='"', compression="gzip")
            .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
            .csv(f"{path}/{year}")
        )

    _side_by_side([lambda y=y: write(y) for y in _years(postings)])


def _extracts(spark: SparkSession, sf: str) -> str:
    postings = fx.postings_path(spark, sf)
    return fx.built(spark, sf, "extracts", lambda path: _write_extracts(ws.read_postings(spark, postings), path))


def _audited(spark: SparkSession, sf: str):
    return ws.ingest_audited(spark, _extracts(spark, sf), new_path(spark, "audited"), same_headers=True)


def q_ingest_prune(spark: SparkSession, sf: str) -> DataFrame:
    dst = new_path(spark, "trimmed")
    ws.ingest_postings(spark, _extracts(spark, sf), dst, same_headers=True)
    return spark.read.parquet(dst)


def _write_chained_extracts(spark: SparkSession, postings: DataFrame, path: str) -> None:
    """Raw extracts of one gzip file a year that is a chain of members, as concatenated extracts are."""
    names = schemas.RAW_POSTING.names
    raw = postings.select(*(F.col(c).cast("string") if c in postings.columns else F.concat(F.lit(c + " "), F.col("id")).alias(c) for c in names), "year")
    hadoop, settings = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    options = {"quote": '"', "escape": '"', "compression": "gzip", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

    def write(year: int) -> None:
        parts = f"{path}/parts/{year}"
        raw.where(F.col("year") == year).drop("year").repartition(MEMBERS).write.options(**options).csv(parts)
        target = hadoop.fs.Path(f"{path}/{year}/all/{year}.csv.gz")
        system = target.getFileSystem(settings)
        out = system.create(target)
        out.write(gzip.compress((",".join(names) + "\n").encode()))
        for part in ws.list_files(spark, f"{parts}/*.csv.gz"):
            stream = system.open(hadoop.fs.Path(part))
            hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
        out.close()

    _side_by_side([lambda y=y: write(y) for y in _years(postings)])


def q_ingest_members(spark: SparkSession, sf: str) -> DataFrame:
    """Extracts that are chains of gzip members, each read by several tasks."""
    postings = fx.postings_path(spark, sf)
    root = fx.built(spark, sf, "chained", lambda path: _write_chained_extracts(spark, ws.read_postings(spark, postings), path))
    dst = new_path(spark, "trimmed")
    ws.ingest_postings(spark, root, dst, split_members=RANGE_BYTES)
    return spark.read.parquet(dst)


def q_file_rowcount_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every extract from the counts of an audited ingest. A month's files are added up: their names differ in each run."""
    counts = _audited(spark, sf).file_rows
    folder = F.concat_ws("/", "year", "month")
    return ws.file_count_totals(counts.select(folder.alias("filename"), "nrows"), "Total")


def q_file_rowcount_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same by reading the extracts, those of every header."""
    parts = [ws.with_source_file(part.select("id")) for part in csv_parts(spark, f"{_extracts(spark, sf)}/*/*/*.csv.gz")]
    rows = reduce(DataFrame.unionByName, parts)
    folder = F.regexp_extract("filename", r"/([0-9]{4}/month=[0-9]{2})/[^/]+$", 1)
    return ws.file_row_counts(rows.select(folder.alias("filename")), "Total")


def q_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).reconcile()


def q_reconcile_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same from two tables."""
    before = ws.read_raw_postings(spark, _extracts(spark, sf))
    return ws.reconcile_counts(before, q_ingest_prune(spark, sf), by=("year",))


def q_rowcount(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "jobs")
    written = ws.write_counted(_job_scores(spark, sf), path)
    return ws.row_count(spark.read.parquet(path)).withColumn("n_written", F.lit(written).cast("bigint"))


def q_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return ws.lookup(fx.stored(spark, sf, "fx_profile"), LOOKUP_ID)


def q_point_lookup_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """The same from files that the lookup can skip."""
    path = new_path(spark, "clustered")
    ws.write_clustered(fx.profiles(spark, sf), path, "id")
    return ws.lookup(spark.read.parquet(path), LOOKUP_ID)


def q_merge_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides stored in buckets; ids of more than FREQUENT_ROWS rows go apart."""
    pair = ws.bucket_pair(fx.profiles(spark, sf), fx.descriptions(spark, sf, searched=False), BUCKETS, frequent_rows=FREQUENT_ROWS)
    return ws.merge_bucketed(*pair)


def q_pooled_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all years after one year was replaced, from pooled counts kept by differences."""
    root, postings = new_path(spark, "pooled"), _postings(spark, sf)
    ws.replace_years(spark, root, ws.skill_year_counts(postings))
    one = postings.where(F.col("year") == REFRESHED_YEAR)
    ws.replace_years(spark, root, ws.skill_year_counts(one, drop_core=True), [REFRESHED_YEAR])
    return ws.pooled_scores(spark, root)


def q_pooled_years(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that are in force after one year was replaced."""
    root, postings = new_path(spark, "pooled"), _postings(spark, sf)
    ws.replace_years(spark, root, ws.skill_year_counts(postings))
    one = postings.where(F.col("year") == REFRESHED_YEAR)
    ws.replace_years(spark, root, ws.skill_year_counts(one, drop_core=True), [REFRESHED_YEAR])
    return ws.pooled_years(spark, root)


def q_write_year(spark: SparkSession, sf: str) -> DataFrame:
    """Write all years, then replace a single one."""
    path, postings = new_path(spark, "skill_years"), _postings(spark, sf)
    ws.write_year(ws.skill_year_counts(postings), path)
    one = postings.where(F.col("year") == REFRESHED_YEAR)
    ws.write_year(ws.skill_year_counts(one, drop_core=True), path)
    return ws.read_skill_years(spark, path)


def all_queries() -> dict[str, Query]:
    return {name: query for name, query in globals().items() if name.startswith("q_")}
