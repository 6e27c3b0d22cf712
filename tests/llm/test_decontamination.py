import itertools

from compare import difference, duck
from conftest import plan
from fixtures_llm import SF, by_id, needs_tables, no_documents, odd_documents

from workforce_signals.llm import decontamination as d
from workforce_signals.llm.queries import op3_decontamination

PASSAGE = "the quick brown fox jumps over one lazy dog while seven tired owls watch from a tall old tree"


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def found(spark, docs, items):
    return by_id(d.contaminated(*frames(spark, docs, items)), "doc_id", "item_id", "item_words", "matched_words")


def test_masks_lose_nothing():
    for n in range(d.LEAST_WORDS, d.WINDOW + 1):
        for bad in itertools.combinations(range(n), n // d.ONE_IN):
            assert any(
                all(start + m not in bad for m in mask) for mask in d.MASKS for start in range(n - mask[-1])
            ), (n, bad)


@needs_tables
def test_whole_table(spark):
    df = op3_decontamination(spark, SF)
    assert difference(df, duck(SF), d.ORACLE_SQL) == ""
    for unwanted in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan(df)


def test_replaced_words_are_tolerated(spark):
    words = PASSAGE.split()
    three, four = list(words), list(words)
    for i in (3, 8, 12):
        three[i] = "other"
    for i in (1, 4, 7, 10, 13, 16):
        four[i] = "other"
    docs = [
        (1, f"Before it: {PASSAGE.upper()}! And after."), (2, " ".join(three)), (3, " ".join(four)),
        (4, " ".join(words[:16])), (5, " ".join(words[:12])), (6, "nothing of the kind at all, only the usual words of any text here"),
    ]
    assert found(spark, docs, [(7, PASSAGE)]) == [(1, 7, 19, 16), (2, 7, 19, 13), (4, 7, 19, 16)]


def test_short_items(spark):
    short = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, short), (2, short.replace("delta", "d")), (3, short.replace("delta", "d").replace("eta", "e"))]
    items = [(1, short), (2, "one two three four five six seven"), (3, None), (4, ""), (None, short)]
    assert found(spark, [*docs, (4, "one two three four five six seven")], items) == [(1, 1, 8, 8), (2, 1, 8, 7)]


def test_repeated_rows_ties_and_passages(spark):
    docs = [(1, PASSAGE), (1, PASSAGE), (2, f"{PASSAGE} {PASSAGE}"), (None, PASSAGE), (3, None)]
    items = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)]
    assert found(spark, docs, items) == [(k, i, 19, 16) for k in (None, 1, 2) for i in (1, 2)]


def test_odd_tables(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    assert d.contaminated(odd_documents(spark), items).count() == 0
    assert d.contaminated(no_documents(spark), items).count() == 0
    assert d.contaminated(odd_documents(spark), items.limit(0)).count() == 0


def test_drop(spark):
    docs, items = frames(spark, [(1, PASSAGE), (2, "clean"), (None, PASSAGE), (3, None)], [(1, PASSAGE)])
    assert [r[0] for r in by_id(d.drop_contaminated(docs, items), "doc_id")] == [2, 3]


def test_drop_judges_every_row_by_its_own_text(spark):
    rows = [(1, PASSAGE), (1, "clean"), (1, None), (2, "clean"), (None, f"So: {PASSAGE}"), (None, "clean too"), (None, None), (3, PASSAGE), (3, PASSAGE)]
    docs, items = frames(spark, rows, [(1, PASSAGE)])
    kept = [(None, None), (None, "clean too"), (1, None), (1, "clean"), (2, "clean")]
    assert by_id(d.drop_contaminated(docs, items), "doc_id", "text") == kept
    assert d.drop_contaminated(odd_documents(spark), items).count() == odd_documents(spark).count()


def test_drop_from_a_table_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, PASSAGE, 5, "x", 6), (None, "clean", 7, "y", 8)], "doc_id bigint, text string, _first int, _Second string, __first int")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(None, "clean", 7, "y", 8)]
