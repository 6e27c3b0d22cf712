import random

import pytest
from conftest import rows

import workforce_signals as ws
from workforce_signals.plans import stored

POSTING = "id bigint, year int, company string, company_name string, skills_name string"
COLUMNS = ["year", "job_id", "company", "company_name", "job_ai_score", "n_skills", "n_matched_skills", "ai_job"]


def postings(spark, *values):
    return spark.createDataFrame([(*v[:1], 2010, *v[1:]) for v in values], POSTING)


def scores(spark, **values):
    return spark.createDataFrame(list(values.items()), "skill string, ai_score double")


def test_worked_example(spark):
    found = ws.job_scores(postings(spark, (1, "1", "F", "A|B|C")), scores(spark, a=0.5, b=0.7, c=0.3))
    assert found.columns == COLUMNS
    assert rows(found) == [(2010, "1", "1", "F", 0.5, 3, 3, 1)]


def test_job_without_scored_skill(spark):
    jobs = ws.job_scores(postings(spark, (1, "1", "F", "z"), (2, "1", "F", None)), scores(spark, a=0.5))
    assert rows(jobs) == [(2010, "1", "1", "F", None, 1, 0, 0)]
    assert rows(ws.company_share(jobs)) == [(2010, "1", "F", 1, 0, 0.0)]


def test_mean_of_exactly_the_threshold_is_not_flagged(spark):
    table = scores(spark, a=0.1, b=0.10000001)
    found = ws.job_scores(postings(spark, (1, "1", "F", "a"), (2, "1", "F", "b")), table)
    assert [r[-1] for r in rows(found)] == [0, 1]


def test_options(spark):
    posting, table = postings(spark, (1, "1", "F", "a|a|b|z")), scores(spark, a=0.2, b=0.8)

    def result(**options):
        return rows(ws.job_scores(posting, table, **options), "job_ai_score", "n_skills", "n_matched_skills")

    assert result() == [(0.5, 3, 2)]
    assert result(dedup=False) == [(pytest.approx(0.4), 4, 3)]
    assert result(unmatched_as_zero=True) == [(pytest.approx(1 / 3), 3, 2)]
    assert result(require_match=True) == [(0.5, 3, 2)]
    assert rows(ws.job_scores(postings(spark, (1, "1", "F", "z")), table, require_match=True)) == []
    assert rows(ws.job_scores(posting, table, threshold=0.6), "ai_job") == [(0,)]


REPEATED = [
    (1, "1", "F", "a|b"),
    (1, "1", "F", "b|c|z"),
    (1, "2", "F", "a"),
    (None, "1", None, "a"),
    (None, "1", None, "a|b"),
    (3, None, None, "c|c"),
    (4, "1", "F", "z|y"),
]


@pytest.mark.parametrize("limit", [stored.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("zero", [False, True])
def test_rows_of_one_job_are_pooled(spark, monkeypatch, limit, zero):
    monkeypatch.setattr(stored, "BROADCAST_BYTES", limit)
    found = ws.job_scores(postings(spark, *REPEATED), scores(spark, a=0.1, b=0.2, c=0.6), unmatched_as_zero=zero)
    assert rows(found, "job_id", "company", "company_name", "job_ai_score", "n_skills", "n_matched_skills") == [
        (None, "1", None, pytest.approx(0.15), 2, 2),
        ("1", "1", "F", pytest.approx(0.225 if zero else 0.3), 4, 3),
        ("1", "2", "F", pytest.approx(0.1), 1, 1),
        ("3", None, None, pytest.approx(0.6), 1, 1),
        ("4", "1", "F", 0.0 if zero else None, 2, 0),
    ]


def brute_force(values, table):
    jobs = {}
    for job_id, company, name, text in values:
        found = {t.strip(" ").lower() for t in (text or "").split("|") if t}
        if found:
            jobs.setdefault((job_id and str(job_id), company, name), set()).update(found)
    result = {}
    for job, skills in jobs.items():
        scored = [table[s] for s in skills if s in table]
        result[job] = (round(sum(scored) / len(scored), 9) if scored else None, len(skills), len(scored))
    return result


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_brute_force(spark, partitions):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    table = {w: rng.random() for w in words[:8]}
    values = [
        (
            # A third of the rows share one id.
            None if rng.random() < 0.1 else 1 if rng.random() < 0.33 else rng.randint(2, 400),
            rng.choice(["1", "2", None]),
            rng.choice(["F", None]),
            rng.choice(["|", " | "]).join(rng.choices(words, k=rng.randint(0, 6))),
        )
        for _ in range(600)
    ]
    jobs = ws.job_scores(postings(spark, *values).repartition(partitions), scores(spark, **table))
    found = {
        (r["job_id"], r["company"], r["company_name"]): (
            None if r["job_ai_score"] is None else round(r["job_ai_score"], 9),
            r["n_skills"],
            r["n_matched_skills"],
        )
        for r in jobs.collect()
    }
    assert found == brute_force(values, table)


def test_unique_ids_gives_the_same(spark):
    posting, table = postings(spark, (1, "1", "F", "a|b|a"), (2, "1", "F", "b")), scores(spark, a=0.1, b=0.3)
    assert rows(ws.job_scores(posting, table, unique_ids=True)) == rows(ws.job_scores(posting, table))


def test_company_share_groups_by_id_and_name_with_nulls(spark):
    jobs = spark.createDataFrame(
        [(2010, None, None, 1), (2010, None, None, 0), (2010, "1", "F", 1), (2010, "1", "G", 0), (2011, "1", "F", 0)],
        "year int, company string, company_name string, ai_job int",
    )
    assert rows(ws.company_share(jobs)) == [
        (2010, None, None, 2, 1, 0.5),
        (2010, "1", "F", 1, 1, 1.0),
        (2010, "1", "G", 1, 0, 0.0),
        (2011, "1", "F", 1, 0, 0.0),
    ]
    assert rows(ws.yearly_share(jobs)) == [(2010, 0.5), (2011, 0.0)]
    assert rows(ws.yearly_share(jobs, (2011, 2024))) == [(2011, 0.0)]
    assert ws.company_share(jobs.drop("year")).columns[0] == "company"


def test_posting_measure_properties(spark):
    rng = random.Random(5)
    values = [
        (i, str(i % 5), f"F{i % 5}", "|".join(rng.sample(["ai", "ml", "x", "y", "z"], rng.randint(0, 4))))
        for i in range(200)
    ]
    posting = postings(spark, *values)
    counted = ws.skill_year_counts(posting).collect()
    assert all(0 <= r["co_jobs_with_ai"] <= r["cnt"] for r in counted)
    share = ws.posting_measure(posting, min_jobs=1).collect()
    assert sum(r["n_postings"] for r in share) == sum(1 for v in values if v[3])
    assert all(0 <= r["ai_job_share"] <= 1 for r in share)
    again = ws.posting_measure(posting.repartition(5), min_jobs=1, unique_ids=True).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, share))


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    table = scores(spark, **{w: rng.random() / 5 for w in words})
    values = [(i % 40, "1", "F", "|".join(rng.choices(words, k=30))) for i in range(800)]
    found = {
        tuple(rows(ws.job_scores(postings(spark, *values).repartition(n), table, dedup=dedup)))
        for n in (1, 7, 50)
        for dedup in (True,)
    }
    assert len(found) == 1
