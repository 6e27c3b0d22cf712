"""The physical plans that large inputs depend on."""

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

import workforce_signals as ws
from workforce_signals.plans import stored

POSTING = "id bigint, year int, company string, company_name string, skills_name string, title_name string"
PROFILE = (
    "id bigint, company string, company_name string, title_raw string, "
    "most_recent_company_start_month string, most_recent_company_end_month string"
)


@pytest.fixture(scope="module")
def postings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "t")
    values = [(i, 2010 + i % 3, "1", "F", "ai|x", "t") for i in range(50)]
    ws.write_year(spark.createDataFrame(values, POSTING), path)
    return ws.read_postings(spark, path)


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(stored, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(text):
    lines = text.split("\n")
    return [(line, lines[i + 1]) for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


def test_counting_reads_two_columns_and_shuffles_partial_counts_once(postings):
    text = plan(ws.skill_year_counts(postings))
    assert len(exchanges(text)) == 1 and "Join" not in text
    assert "partial_count" in exchanges(text)[0][1]
    assert "ReadSchema: struct<id:bigint,skills_name:string>" in text
    assert "PushedFilters: [IsNotNull(skills_name), Not(EqualTo(skills_name,))]" in text


def test_jobs_collapse_before_their_only_shuffle(spark, postings):
    scores = spark.createDataFrame([("x", 0.5)], "skill string, ai_score double")
    text = plan(ws.job_scores(postings, scores))
    assert "BroadcastHashJoin" in text
    assert len(exchanges(text)) == 1 and "partial_sum" in exchanges(text)[0][1]


def test_tables_above_the_limit_are_not_broadcast(spark, postings, no_broadcast):
    scores = spark.createDataFrame([("x", 0.5)], "skill string, ai_score double")
    text = plan(ws.job_scores(postings, scores))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_only_repeated_ids_carry_skills(spark, monkeypatch):
    """Also where their set is too large to broadcast."""
    values = [(i if i else 1, 2010, "1", "F", "ai|x", "t") for i in range(50)]
    df = spark.createDataFrame(values, POSTING)
    scores = spark.createDataFrame([("x", 0.5), ("ai", 1.0)], "skill string, ai_score double")
    expected = sorted(map(tuple, ws.job_scores(df, scores).collect()))
    monkeypatch.setattr(stored, "BROADCAST_BYTES", 0)
    found = ws.job_scores(df, scores)
    assert sorted(map(tuple, found.collect())) == expected
    assert "coalesce(found" in plan(found)


def test_a_year_filter_prunes_partitions(spark, postings):
    text = plan(ws.skill_scores(ws.skill_year_counts(postings, unique_ids=True), years=(2011, 2011)))
    assert "PartitionFilters: [isnotnull(year" in text


def test_top_skills_sorts_no_whole_table(spark):
    scores = spark.createDataFrame([], "skill string, total_cnt bigint, total_co bigint, ai_score double")
    assert "TakeOrderedAndProject" in plan(ws.top_skills(scores.union(scores).distinct(), 5))


@pytest.fixture(scope="module")
def resumes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("resumes")
    spark.createDataFrame([(1, "1", "F", "t", "2000-01", None)], PROFILE).write.parquet(f"{root}/p")
    spark.createDataFrame([(1, "ai")], "id bigint, description_raw string").write.parquet(f"{root}/d")
    return spark.read.parquet(f"{root}/p"), spark.read.parquet(f"{root}/d")


def test_no_text_is_shuffled_for_the_firm_measure(resumes, no_broadcast):
    text = plan(ws.resume_measure(*resumes, ["ai", "deep learning"], as_of=2003))
    assert "SortMergeJoin" in text
    assert len(exchanges(text)) == 5
    for line, child in exchanges(text):
        assert "description_raw" not in line + child and "title_raw" not in child.split("FileScan")[0]


def test_profiles_meet_descriptions_by_an_inner_join(resumes):
    text = plan(ws.merge_profiles(*resumes))
    assert "Inner" in text and "LeftOuter" not in text
    assert "IsNotNull(description_raw)" in text and "IsNotNull(company_name)" in text


def test_firms_are_collapsed_before_each_shuffle(spark):
    flagged = spark.createDataFrame([], "id string, company_name_raw string, year int, ai_related int")
    text = plan(ws.company_year_share(flagged.union(flagged).repartition(3)))
    keys = [line for line, _ in exchanges(text)]
    assert len(keys) == 2 and "id#" in keys[1] and "id#" not in keys[0]
    assert all("partial_" in child for _, child in exchanges(text))


def test_lookup_reaches_the_scan(resumes):
    assert "EqualTo(id,7)" in plan(ws.lookup(resumes[0], 7))


def test_an_id_with_a_third_of_all_rows_is_split(spark, tmp_path, no_broadcast):
    n = 30_000
    ids = "CASE WHEN id % 3 = 0 THEN 7 ELSE id END"
    months = "concat(1990 + id % 20, '-01')"
    profiles = spark.range(n).selectExpr(
        f"{ids} AS id",
        "'1' AS company",
        "concat('Firm ', sha2(cast(id AS string), 256)) AS company_name",
        "'clerk' AS title_raw",
        f"{months} AS most_recent_company_start_month",
        f"{months} AS most_recent_company_end_month",
    )
    texts = spark.range(n).selectExpr("id", "if(id % 2 = 1, 'ai', 'x') AS description_raw")
    profiles.write.parquet(f"{tmp_path}/p")
    texts.write.parquet(f"{tmp_path}/d")
    resumes = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/d")
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        measure = ws.resume_measure(*resumes, ["ai"], as_of=2003)
        found = measure.collect()
        assert "skew=true" in plan(measure)
        merged = ws.merge_profiles(*resumes)
        assert len(merged.collect()) == n and "skew=true" in plan(merged)
    finally:
        for key in small:
            spark.conf.unset(key)
    assert len(found) == n and sum(r["employees"] for r in found) == n
    assert sum(r["ai_employees"] for r in found) == sum(1 for i in range(n) if (7 if i % 3 == 0 else i) % 2)


def test_positions_and_their_keys_move_rows_by_ranges_only(spark, tmp_path):
    from driver_queries.queries import _ordered

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).selectExpr("id % 7 AS k", "id", "repeat('text', 5) AS text")
        ws.write_table(ws.order_output(df, "k", "id"), str(tmp_path / "t"))
        text = plan(ws.with_position(spark.read.parquet(str(tmp_path / "t"))))
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        ordered = _ordered(df, ("k", "-id"))
        text = plan(ordered)
        assert "rangepartitioning(k" in text and "hashpartitioning(k" not in text
        assert len(rows(ordered)) == 100
        first = {r["k"]: r["p"] for r in _ordered(df, ("k",)).groupBy("k").agg(F.count_distinct("position").alias("n"), F.min("position").alias("p")).where("n = 1").collect()}
        assert first == {k: 1 + sum(i % 7 < k for i in range(100)) for k in range(7)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_skills_of_repeated_ids_are_made_distinct_in_tasks_of_a_bounded_size(spark):
    values = [(i // 2, 2010, "1", "F", "ai|x", "t") for i in range(20)]
    jobs = spark.createDataFrame(values, POSTING)
    text = plan(ws.job_scores(jobs, spark.createDataFrame([("ai", 1.0)], "skill string, ai_score double")))
    before = text[text.index("REBALANCE_PARTITIONS_BY_NONE" if "REBALANCE_PARTITIONS_BY_NONE" in text else "REBALANCE_PARTITIONS") :]
    assert "Generate explode" in before
    kept = [line for line in text.split("\n") if "HashAggregate" in line and "functions=[]" in line]
    assert len(kept) >= 2


def test_ordered_spell_years_send_a_text_once_a_spell(spark, monkeypatch):
    from driver_queries import queries

    written, write = [], ws.write_table

    def seen(df, path, *more, **options):
        written.append((path, plan(df)))
        write(df, path, *more, **options)

    monkeypatch.setattr(ws, "write_table", seen)
    monkeypatch.setattr(queries, "_keywords", lambda spark, sf: spark.createDataFrame([("machine learning",)], "skill string"))
    placed = queries.q_ordered_spell_years(spark, "/root/testdata/sf0.001")
    sorted_write = next(text for path, text in written if "/ordered-" in path)
    # The only ranges are those of spells, below the step that makes years of them; nothing meets again after that.
    assert sorted_write.count("rangepartitioning(") == 1 and sorted_write.index("Generate explode") < sorted_write.index("Exchange")
    assert "rangepartitioning(" not in plan(placed) and "hashpartitioning(id" not in plan(placed)


def test_first_places_of_ranged_rows_are_those_of_all_their_key(spark):
    from driver_queries.queries import _ordered, _ordered_in_ranges

    values = [(None if i % 5 == 0 else f"p{i % 4}", None if i % 3 == 0 else f"t{i % 2}", 2000 + i % 2, f"x{i % 20}") for i in range(200)]
    df = spark.createDataFrame(values, "id string, title_name string, year int, text string")
    ranged = df.repartitionByRange(3, F.col("id").asc_nulls_last(), F.col("title_name").asc_nulls_last())
    order = ("id", "title_name", "year")
    got = _ordered_in_ranges(ranged, order)
    assert got.columns == [*df.columns, "position"] and got.schema == _ordered(df, order).schema
    places = sorted((r is None, r or "", t is None, t or "", y) for r, t, y, _ in values)
    expected = sorted(((*v, 1 + places.index((v[0] is None, v[0] or "", v[1] is None, v[1] or "", v[2]))) for v in values), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected == sorted((tuple(r) for r in _ordered(df, order).collect()), key=str)
