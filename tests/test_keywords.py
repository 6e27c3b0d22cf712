import random

import pytest
from conftest import plan, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import workforce_signals as ws
from workforce_signals.functions import patterns
from workforce_signals.operators import gram_search, keywords
from workforce_signals.operators.spells import PROFILE_NAMES
from workforce_signals.plans import stored

SPELL = "id string, title_name string, description_raw string"


def earliest(text, words):
    found = [(text.find(w), w) for w in words if w in text]
    return min(found)[1] if found else None


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "skill string")


def hits(spark, values, words):
    df = spark.createDataFrame([(str(i), *v) for i, v in enumerate(values)], SPELL)
    found = ws.first_keyword_hit(df, table(spark, words)).collect()
    return [r["first_hit_skill"] for r in sorted(found, key=lambda r: int(r["id"]))]


def test_keyword_list(spark):
    found = ws.keyword_list(table(spark, [" AI ", "ai", "", "  ", None, "NLP"]))
    assert rows(found) == [("ai",), ("nlp",)]


def test_first_hit_edges(spark):
    values = [
        (None, None),
        ("Maintain", None),
        (None, "Machine Learning"),
        ("deep", "learning"),
        ("x", "nlp then ai"),
        ("", "c++ (a.b)"),
    ]
    words = ["ai", "machine", "machine learning", "deep learning", "nlp", "c++", "a.b", "axb"]
    assert hits(spark, values, words) == [None, "ai", "machine", "deep learning", "nlp", "c++"]


def test_flag(spark):
    df = spark.createDataFrame([("ai",), (None,)], "first_hit_skill string")
    assert rows(ws.flag_keyword(df)) == [(None, 0), ("ai", 1)]


def test_no_keywords(spark):
    assert hits(spark, [("ai", "ai")], []) == [None]


@pytest.fixture
def grams(monkeypatch):
    """Every list counts as a long one."""
    monkeypatch.setattr(keywords, "PATTERN_KEYWORDS", 0)


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(stored, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("path", ["pattern", "several patterns", "grams", "shuffled grams", "pieces"])
def test_all_paths_against_brute_force(spark, monkeypatch, request, path):
    rng = random.Random(11)
    alphabet = "abé .c+"
    words = {"".join(rng.choices(alphabet, k=rng.randint(1, 5))).strip() for _ in range(60)} - {""}
    values = [
        ("".join(rng.choices(alphabet + "xyz", k=rng.randint(0, 12))), "".join(rng.choices("xyz" * 8 + alphabet, k=40)))
        for _ in range(200)
    ]
    if path == "several patterns":
        monkeypatch.setattr(patterns, "PATTERN_KEYWORDS", 7)
    if path in ("grams", "shuffled grams", "pieces"):
        request.getfixturevalue("grams")
        words |= {"".join(rng.choices(alphabet, k=rng.randint(9, 14))).strip() for _ in range(60)}
        long = sorted(w for w in words if len(w) > 8)
        values += [(rng.choice(long)[:5], "xyz" * rng.randint(0, 3) + rng.choice(long) + "x") for _ in range(100)]
    if path == "shuffled grams":
        request.getfixturevalue("no_broadcast")
    if path == "pieces":
        monkeypatch.setattr(gram_search, "PIECE", 7)
    expected = [earliest(f"{a} {b}", words) for a, b in values]
    assert hits(spark, values, words) == expected
    assert None not in hits(spark, [(w, "") for w in words], words)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.sets(st.text(st.sampled_from("ab .+é𝒜"), min_size=1, max_size=5), min_size=1, max_size=12),
    st.lists(st.text(st.sampled_from("ab .+é𝒜x"), max_size=30), min_size=1, max_size=8),
)
def test_pattern_is_earliest_then_shortest(spark, words, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    hit = patterns.first_match(F.col("t"), patterns.keyword_patterns(words))
    found = [r["h"] for r in df.select("i", hit.alias("h")).orderBy("i").collect()]
    assert found == [earliest(t, words) for t in texts]


def test_long_lists_by_every_way_to_use_them(spark, grams):
    """Before the join, after it and for the measure; keywords across the space between title and text included."""
    rng = random.Random(5)
    words = ["deep learning", "learning to rank", "ai", "b c d", "deep learning to rank", "ünï 漢字漢字漢字", "x"]
    parts = ["deep", "learning", "to rank", "b", "c d", "ünï", "漢字漢字漢字", "Deep", "", "  "]
    values = [(" ".join(rng.choices(parts, k=rng.randint(0, 2))), " ".join(rng.choices(parts, k=rng.randint(0, 3)))) for _ in range(80)]
    values += [(None, "ai"), ("ai", "x"), ("", ""), ("deep learning", "to rank"), ("a", "a" * 70_000 + "learning to rank")]
    profiles = spark.createDataFrame([(i, "1", "F", a, "2000-01", None) for i, (a, _) in enumerate(values)], PROFILE)
    texts = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(values)], "id bigint, description_raw string")
    expected = [earliest(f"{a or ''} {b}".lower(), words) for a, b in values]
    found = ws.merge_with_hits(profiles, texts, table(spark, words))
    assert found.columns == [*ws.merge_profiles(profiles, texts).columns, "first_hit_skill"]
    assert [r["first_hit_skill"] for r in found.orderBy("id").collect()] == expected
    after = ws.first_keyword_hit(ws.merge_profiles(profiles, texts), words, "title_raw")
    assert [r["first_hit_skill"] for r in after.orderBy("id").collect()] == expected
    measure = ws.resume_measure(profiles, texts, table(spark, words), as_of=2000).collect()
    assert [(r["employees"], r["ai_employees"]) for r in measure] == [(len(values), sum(e is not None for e in expected))]
    both = profiles.join(texts, "id").select("*", *(F.lit(None).cast("string").alias(c) for c in ("is_current",)))
    alone = ws.resume_measure(both, None, table(spark, words), as_of=2000).collect()
    assert [(r["employees"], r["ai_employees"]) for r in alone] == [(len(values), sum(e is not None for e in expected))]


def test_long_lists_that_hold_nothing(spark, grams):
    index = gram_search.gram_index(table(spark, ["", None]))
    df = spark.createDataFrame([("1", "a", "b")], SPELL)
    assert rows(gram_search.with_first_hit(df, F.col("title_name"), index, "hit")) == [("1", "a", "b", None)]
    assert hits(spark, [("ab", "c"), (None, None)], ["ab c"]) == ["ab c", None]


def test_a_keyword_is_found_by_the_run_that_fewest_share(spark):
    words = [f"machine learning {i}" for i in range(300)] + ["machine learning"]
    index = gram_search.gram_index(table(spark, words))
    most = index.table.df.groupBy("gram").count().agg(F.max("count")).first()[0]
    assert index.table.rows == 301 and most <= 30  # a run of the first eight letters would be shared by all


def test_a_frequent_run_is_split_and_no_text_crosses_the_network(spark, grams, no_broadcast):
    """A third of the texts hold the same run; only windows around possible keywords meet the index."""
    values = [(str(i), "boss", ("x" * 40 + "machine learning" if i % 3 == 0 else f"t{i}") + "y" * 500) for i in range(3000)]
    df = spark.createDataFrame(values, SPELL).repartition(8)
    index = keywords.literal_keywords(table(spark, ["machine learning", "boss x"]))
    for name, value in (("skewedPartitionThresholdInBytes", "1k"), ("skewedPartitionFactor", "1.1")):
        spark.conf.set(f"spark.sql.adaptive.skewJoin.{name}", value)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        found = gram_search.first_hits(df, F.col("description_raw"), index)
        assert [(r["hit_start"], r["hit_bytes"]) for r in found.collect()] == [(40, 16)]  # one distinct text
        assert "skew=true" in plan(found) or "isSkewJoin=true" in plan(found)
    finally:
        for name in ("skewJoin.skewedPartitionThresholdInBytes", "skewJoin.skewedPartitionFactor", "advisoryPartitionSizeInBytes"):
            spark.conf.unset(f"spark.sql.adaptive.{name}")


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbB \u3000"), max_size=5)), max_size=8),
    st.lists(st.tuples(st.text(st.sampled_from("ab xé𝒜"), max_size=5), st.text(st.sampled_from("abx "), max_size=6)), min_size=1, max_size=10),
)
def test_one_meaning_of_keywords(spark, words, values):
    """Lists and tables, searched before or after the join or for the measure: blanks around keywords and capitals do not count."""
    normal = {w.strip(" \u3000").lower() for w in words if w} - {""}
    expected = [earliest(f"{a} {b}".lower(), normal) for a, b in values]
    profiles = spark.createDataFrame([(i, "1", "F", a, "2000-01", None) for i, (a, _) in enumerate(values)], PROFILE)
    texts = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(values)], "id bigint, description_raw string")
    for given_words in (words, table(spark, words)):
        found = ws.merge_with_hits(profiles, texts, given_words).orderBy("id").collect()
        assert [r["first_hit_skill"] for r in found] == expected
        found = ws.first_keyword_hit(ws.merge_profiles(profiles, texts), given_words, "title_raw").orderBy("id").collect()
        assert [r["first_hit_skill"] for r in found] == expected
        measure = ws.resume_measure(profiles, texts, given_words, as_of=2000).collect()
        assert [(r["employees"], r["ai_employees"]) for r in measure] == [(len(values), sum(e is not None for e in expected))]


PROFILE = (
    "id bigint, company string, company_name string, title_raw string, "
    "most_recent_company_start_month string, most_recent_company_end_month string"
)


def test_resume_measure_equals_its_steps(spark):
    rng = random.Random(2)
    words = ["deep learning", "learning to rank", "ai", "b c d", "c", "deep learning to rank"]
    parts = ["deep", "learning", "to rank", "b", "c d", "x", "Deep  ", "B C", "d", ""]

    def text(k):
        return None if rng.random() < 0.1 else " ".join(rng.choices(parts, k=k))

    profiles = spark.createDataFrame(
        [
            (
                rng.choice([1, 1, rng.randint(2, 60), None]),
                "1",
                rng.choice(["F", " f", "G", None]),
                text(rng.randint(0, 2)),
                rng.choice(["2000-01", "2001-5", "bad", None, " "]),
                rng.choice(["2002-01", "1999-01", None, "n/a"]),
            )
            for _ in range(300)
        ],
        PROFILE,
    )
    texts = [(rng.choice([1, rng.randint(2, 60), None]), text(rng.randint(0, 2))) for _ in range(150)]
    descriptions = spark.createDataFrame(texts, "id bigint, description_raw string")
    spells = ws.parse_spells(ws.merge_profiles(profiles, descriptions))
    steps = ws.company_year_share(ws.flag_years(spells, words, 2003))
    columns = ("id", "company_name", "title_raw", "most_recent_company_start_month", "description_raw")
    searched = ws.first_keyword_hit(ws.merge_profiles(profiles, descriptions), words, "title_raw")
    merged = ws.merge_with_hits(profiles, descriptions, table(spark, words))
    assert rows(merged, *columns, "first_hit_skill") == rows(searched, *columns, "first_hit_skill")
    measure = ws.resume_measure(profiles, descriptions, table(spark, words), as_of=2003)
    assert rows(measure) == rows(steps)
    assert 0 < sum(r["ai_employees"] for r in measure.collect()) < sum(r["employees"] for r in measure.collect())
    link = spark.createDataFrame([(1.0, "F", "001"), (2.0, "F", "002"), (None, None, "x")], "ID double, NAME string, GVKEY string")
    linked = ws.resume_measure(
        profiles, descriptions, table(spark, words), link, as_of=2003, first_year=2001, end_year=2003
    )
    assert rows(linked) == rows(ws.link_by_name(steps, link, 2001, 2003))


def test_a_long_list_with_short_keywords_makes_no_pairs(spark):
    words = [f"{a}{b}{c}{d}" for a in "qzxv" for b in "qzxv" for c in "0123456789" for d in range(160)] + ["r", "c"]
    assert len(words) > 20_000
    df = spark.createDataFrame([("1", "clerk", "a lot of text"), ("2", "boss", "x qq0159 y"), ("3", "mmm", "")], SPELL)
    found = ws.first_keyword_hit(df, table(spark, words))
    assert [r["first_hit_skill"] for r in found.orderBy("id").collect()] == ["c", "qq01", None]
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)


def test_older_sample_end_to_end(spark):
    names = dict(zip(PROFILE_NAMES, ("ID", "T", "C", "D", "S", "E", "N"), strict=True))
    schema = ", ".join(f"{c} string" for c in names.values())
    sample = [
        ("1", "ML boss", "F", None, "2000-01", "2001-05", "0"), ("2", "clerk", "F", "does ML", "2001-01", "", "1"),
        ("3", None, "F", "ML", "2001-01", None, "0"), ("4", None, "F", None, "2000-12", "1999-01", ""),
    ]
    found = ws.resume_measure(spark.createDataFrame(sample, schema), None, [" Ml"], as_of=2002, open_end="flag", names=names)
    assert rows(found) == [("F", 2000, 2, 1, 0.5), ("F", 2001, 2, 2, 1.0), ("F", 2002, 1, 1, 1.0)]
    texts = spark.createDataFrame([("2", "does ML")], "id string, description_raw string")
    split = ws.resume_measure(spark.createDataFrame(sample, schema), texts, ["ml"], as_of=2002, open_end="flag", names=names)
    assert rows(split) == [("F", 2001, 1, 1, 1.0), ("F", 2002, 1, 1, 1.0)]


def test_filters_grow_with_the_list_and_pass_few_other_runs(spark, grams, no_broadcast):
    sizes = gram_search._filter_sizes({5: 10, 8: 20_000_000})
    assert sizes[8][1] * gram_search._PIECE_BITS >= 16 * 20_000_000
    most = gram_search._filter_sizes({7: 10**9, 8: 10**10})
    assert sum(pieces for _, pieces in most.values()) * gram_search._PIECE_BITS <= 8 * gram_search.BROADCAST_BYTES
    index = gram_search.gram_index(spark.range(200_000).select(F.concat(F.lit("keyword "), "id").alias("skill")))
    grams = index.table.df.select("gram", "gram_size").unionAll(spark.range(100_000).select(F.xxhash64("id"), F.lit(8)))
    first, pieces = index.sizes[8]
    marked = grams.withColumn("bucket", gram_search._bucket(F.col("gram"), F.lit(first), F.lit(pieces))).join(index.bloom.df, "bucket")
    mask = gram_search._mask(F.col("gram"))
    passed = marked.where(F.get("words", gram_search._word(F.col("gram"))).bitwiseAND(mask) == mask)
    assert 200_000 <= passed.count() < 203_000
