"""Tables stored so that later reads skip, join without a shuffle, or take only differences."""

import shutil
import time

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

import workforce_signals as ws
from workforce_signals.operators import skills
from workforce_signals.plans import pooled

PROFILE = (
    "id bigint, company string, company_name string, title_raw string, "
    "most_recent_company_start_month string, most_recent_company_end_month string"
)
COUNTS = "year int, skill string, cnt bigint, co_jobs_with_ai bigint"


def rows_scanned(df):
    """Rows that the file scan handed on, from the metrics of a run."""
    df.collect()
    top = df._jdf.queryExecution().executedPlan()
    top = top.executedPlan() if hasattr(top, "executedPlan") and "Adaptive" in top.nodeName() else top
    leaves = top.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_lookup_skips_row_groups(spark, tmp_path):
    path, loose = str(tmp_path / "clustered"), str(tmp_path / "loose")
    df = spark.range(200_000).selectExpr("(id * 7919) % 400000 * 3 AS id", "concat('firm ', id % 977) AS name", "repeat(uuid(), 4) AS text")
    ws.write_clustered(df, path, "id", bloom=("id", "name"), group_bytes=1 << 20, group_values=20_000)
    df.write.parquet(loose)
    table = spark.read.parquet(path)
    assert table.count() == 200_000 and rows(table.select("id")) == rows(df.select("id"))
    known = 7919 * 3
    assert rows(ws.lookup(table, known).select("name")) == [("firm 1",)]
    assert rows_scanned(ws.lookup(table, known)) < 20_000 < rows_scanned(ws.lookup(spark.read.parquet(loose), known))
    # Between the least and the greatest value of a row group, but in none: only the bloom filter can tell.
    assert rows_scanned(ws.lookup(table, known + 1)) < 20_000
    assert rows_scanned(ws.lookup(table, "firm 5000", id_col="name")) == 0  # not sorted by name


def test_clustered_files_of_one_frequent_value(spark, tmp_path):
    df = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 1000 = 1 THEN NULL ELSE id END AS id", "id AS n", "repeat(uuid(), 8) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ws.write_clustered(df, str(tmp_path / "t"), "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.read.parquet(str(tmp_path / "t"))
    assert ws.lookup(table, 5).count() == 20_001 and table.where("id IS NULL").count() == 40
    assert ws.lookup(table, 5).select(F.input_file_name()).distinct().count() > 1


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def people(spark, hot=0):
    profiles = [(i % 40 if i % 9 else None, "1", f"F{i % 3}" if i % 7 else None, f"t{i}", "2000-01", None) for i in range(300)]
    profiles += [(7, "1", "F", f"hot {i}", "2001-01", None) for i in range(hot)]
    texts = [(i if i % 5 else None, f"text {i}" if i % 4 else None) for i in range(50)] + [(7, "again")]
    return spark.createDataFrame(profiles, PROFILE), spark.createDataFrame(texts, "id bigint, description_raw string")


def test_bucketed_merge_has_no_exchange(spark, no_broadcast):
    profiles, texts = people(spark)
    pair = ws.bucket_pair(profiles, texts, 4)
    merged = ws.merge_bucketed(*pair)
    assert rows(merged) == rows(ws.merge_profiles(profiles, texts))
    text = plan(merged)
    assert "Exchange" not in text and "SortMergeJoin" in text and "Bucketed: true" in text
    assert "Exchange" in plan(ws.merge_profiles(profiles, texts))


def test_rows_of_a_frequent_id_lie_apart(spark, no_broadcast):
    profiles, texts = people(spark, hot=500)
    pair = ws.bucket_pair(profiles, texts, 4, frequent_rows=100)
    assert {r["id"] for r in pair[0].frequent.df.collect()} == {7} and pair[0].usual.where("id = 7").count() == 0
    assert pair[1].frequent.rows == 2 and pair[1].usual.where("id = 7").count() == 0
    assert rows(ws.merge_bucketed(*pair)) == rows(ws.merge_profiles(profiles, texts))


def test_buckets_opened_by_another_session(spark, no_broadcast):
    profiles, texts = people(spark)
    pair = ws.bucket_pair(profiles, texts, 4)
    again = [ws.open_bucketed(spark, b.path, ddl, f"again_{i}", "id", 4) for i, (b, ddl) in enumerate(zip(pair, (PROFILE, "id bigint, description_raw string"), strict=True))]
    merged = ws.merge_profiles(*again)
    assert rows(merged) == rows(ws.merge_profiles(profiles, texts)) and "Exchange" not in plan(merged)


YEARS = [(2010, "a", 60, 6), (2010, " B", 10, 0), (2011, "a", 5, 5), (2011, "c", 70, 7), (2012, "b", 50, 1)]


def scores(spark, counts, min_jobs=0):
    return rows(ws.skill_scores(spark.createDataFrame(counts, COUNTS), min_jobs))


def test_replacing_a_year_equals_starting_anew(spark, tmp_path):
    root = str(tmp_path / "pooled")
    assert ws.replace_years(spark, root, spark.createDataFrame(YEARS, COUNTS)) == 0
    assert rows(ws.pooled_scores(spark, root, 0)) == scores(spark, YEARS)
    new = [(2011, "a", 1, 0), (2011, "d", 9, 9)]
    assert ws.replace_years(spark, root, spark.createDataFrame(new, COUNTS)) == 1
    now = [r for r in YEARS if r[0] != 2011] + new
    assert rows(ws.pooled_scores(spark, root, 0)) == scores(spark, now)
    assert rows(ws.pooled_scores(spark, root, 50)) == scores(spark, now, 50)
    assert rows(ws.pooled_years(spark, root), "year", "skill", "cnt", "co_jobs_with_ai") == sorted(now)
    assert rows(ws.pooled_scores(spark, root, 0, version=0)) == scores(spark, YEARS)
    # A year without rows is emptied, a new one is added, a year may come twice in a row.
    assert ws.replace_years(spark, root, spark.createDataFrame([], COUNTS), [2010]) == 2
    assert ws.replace_years(spark, root, spark.createDataFrame([(2013, "a", 3, 1)], COUNTS)) == 3
    assert ws.replace_years(spark, root, spark.createDataFrame(new, COUNTS), [2011]) == 4
    now = [r for r in now if r[0] != 2010] + [(2013, "a", 3, 1)]
    assert rows(ws.pooled_scores(spark, root, 0)) == scores(spark, now)
    assert rows(ws.pooled_years(spark, root), "year", "skill", "cnt", "co_jobs_with_ai") == sorted(now)


def test_replacing_a_year_reads_no_other_year(spark, tmp_path):
    root = str(tmp_path / "pooled")
    ws.replace_years(spark, root, spark.createDataFrame(YEARS, COUNTS))
    for year in (2010, 2012):
        shutil.rmtree(f"{root}/years/version=0/year={year}")
    new = [(2011, "a", 1, 0)]
    ws.replace_years(spark, root, spark.createDataFrame(new, COUNTS))
    assert rows(ws.pooled_scores(spark, root, 0)) == scores(spark, [r for r in YEARS if r[0] != 2011] + new)


def test_a_run_that_dies_leaves_the_version_in_force(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "pooled")
    ws.replace_years(spark, root, spark.createDataFrame(YEARS, COUNTS))
    with monkeypatch.context() as broken:
        broken.setattr(pooled, "_totals", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ws.replace_years(spark, root, spark.createDataFrame([(2010, "x", 1, 1), (2012, "y", 1, 1)], COUNTS))
    assert rows(ws.pooled_scores(spark, root, 0)) == scores(spark, YEARS)
    assert ws.replace_years(spark, root, spark.createDataFrame([], COUNTS), [2012]) == 1
    assert rows(ws.pooled_years(spark, root), "year", "skill", "cnt", "co_jobs_with_ai") == sorted(r for r in YEARS if r[0] != 2012)
    with pytest.raises(FileNotFoundError, match="no complete version"):
        ws.pooled_scores(spark, str(tmp_path / "nothing"))


def test_ids_that_occur_once_are_not_shuffled(spark, monkeypatch):
    schema = "id bigint, year int, skills_name string"
    once = spark.createDataFrame([(i, 2010 + i % 2, "a") for i in range(100)], schema)
    seen, keep = [], skills.store
    monkeypatch.setattr(skills, "store", lambda df, name: seen.append((name, plan(df))) or keep(df, name))
    assert ws.repeated_ids(once).is_empty
    assert [name for name, _ in seen] == ["repeated_hashes", "repeated_ids"]
    assert "Exchange hashpartitioning(id_hash" in seen[0][1] and "Exchange hashpartitioning" not in seen[1][1]
    again = once.unionAll(spark.createDataFrame([(3, 2011, "b"), (4, 2011, None), (None, 2010, "x"), (None, 2010, "y")], schema))
    found = ws.repeated_ids(again)
    assert rows(found.df) == [(2010, None), (2011, "3")] and {n for n, _ in seen[2:]} == {"repeated_hashes", "repeated_ids"}


def test_audited_ingest_reads_each_extract_once(spark, tmp_path):
    from workforce_signals.sources import schemas

    names = schemas.RAW_POSTING.names
    for year, months in ((2020, ("2020-01", "2020-02")), (2021, ("2021-01",))):
        for month in months:
            values = [(i, *(f"{c} {i}" for c in names[1:])) for i in range(year % 10 + len(month) + 5)]
            df = spark.createDataFrame(values, ", ".join([f"{names[0]} bigint", *(f"{c} string" for c in names[1:])]))
            df = df.select(*(reversed(df.columns) if year % 2 else df.columns), F.lit("x").alias(f"extra{year}"))
            df.repartition(2).write.options(header=True, compression="gzip").csv(f"{tmp_path}/raw/{year}/{month}")
    audit = ws.ingest_audited(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    shutil.rmtree(tmp_path / "raw")  # nothing of the audit reads an extract
    assert audit.rows_read == {2020: 24, 2021: 13}
    assert rows(audit.reconcile()) == [(2020, 24, 24, 0), (2021, 13, 13, 0)]
    files = audit.file_rows.collect()
    assert len(files) == 6 and sum(f["nrows"] for f in files) == 37 and all(f"/{f['year']}/{f['month']}/" in f["filename"] for f in files)
    totals = {t["filename"]: t["nrows"] for t in ws.file_count_totals(audit.file_rows, "Total").collect()}
    assert len(totals) == 7 and totals["Total"] == 37


def test_totals_of_counts_taken_before(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 0), ("a", 3)], "filename string, nrows bigint")
    assert rows(ws.file_count_totals(counts, "All")) == [("All", 5), ("a", 5), ("b", 0)]
    assert rows(ws.file_count_totals(counts.limit(0), "All")) == []


def test_stored_tables_are_measured_with_all_they_hold(spark):
    rows_of = [(1, "abc", bytearray(1000), [1] * 50, ["ab"] * 10, {"k": "v" * 30}, (1, "z" * 40)), (None,) * 7]
    schema = "a int, b string, c binary, d array<int>, e array<string>, f map<string,string>, g struct<x:int,y:string>"
    found = ws.store(spark.createDataFrame(rows_of, schema), "measured")
    overhead, fields = 2 * 32, 2 * 7 * 8
    assert found.rows == 2 and found.nbytes == overhead + fields + 3 + 1000 + 400 + 10 * 10 + (8 + 9) + (8 + 38) + (8 + 8 + 40)
    assert ws.store(spark.createDataFrame([], schema), "empty").nbytes == 0


def test_storing_leaves_no_shuffle_files(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}

    before = shuffled()
    found = ws.store(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert found.rows == 7 and not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
