import numpy as np
import pytest
from fixtures_llm import SF, needs_tables

from workforce_signals.llm import nearest as nn
from workforce_signals.llm.queries import op9_nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, leaf int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0, 0) for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_odd_vectors(spark):
    rows = [
        (0, [1, 0]), (1, [2, 0]), (2, [0, 1]), (3, [0, 0]), (4, None), (5, [1, None]), (6, [1, float("nan")]), (7, [1, float("inf")]),
        (8, [1, 2, 3]), (None, [1, 0]), (9, [3, 0]), (1, [0, 5]), (50, []),
    ]
    got = found(nn.nearest(table(spark, rows)))
    assert list(got) == [0]
    assert [(r, i) for r, i, _ in got[0]] == [(1, 1), (2, 9), (3, 2)]
    assert [s for *_, s in got[0]] == pytest.approx([1, 1, 0])
    assert nn.nearest(table(spark, rows).limit(0)).count() == 0
    assert nn.nearest(table(spark, [(0, [1, 0])])).count() == 0


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1, 1]) for i in range(300)] + [(300 + i, [1, -1]) for i in range(200)]
    got = found(nn.nearest(table(spark, rows)))
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for _, i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [i for _, i, _ in got[350]] == [300, 301, 302, 303, 304]


def test_blocks_agree_with_brute_force():
    dice = np.random.default_rng(1)
    ids, vectors = np.arange(200), dice.normal(size=(200, 8))
    norms = np.linalg.norm(vectors, axis=1)
    for query in (0, 50, 100):
        near, scores = nn.best_of(vectors[query], query, ids, vectors, norms)
        exact = [float((vectors[i] * vectors[query]).sum() / (norms[i] * norms[query])) for i in range(200)]
        order = sorted((i for i in range(200) if i != query), key=lambda i: (-exact[i], i))[:5]
        assert near[:5].tolist() == order and scores[:5].tolist() == pytest.approx([exact[i] for i in order])


def test_repeated_rows_of_an_id_take_one_place(spark):
    few = [(0, [1, 0]), *[(1, [1, 0.01])] * 30, *[(2, [1, 0.02 + k / 1e4]) for k in range(30)], (3, [0, 1]), (4, [-1, 0]), (5, [1, 1])]
    got = found(nn.nearest(table(spark, few)))
    assert [i for _, i, _ in got[0]] == [1, 2, 5, 3, 4]
    assert nn.brute_force(np.array([i for i, _ in few]), np.array([v for _, v in few], float)) == {0: [1, 2, 5, 3, 4]}


def test_a_hot_id_that_fills_leaves_hides_no_neighbour(spark):
    dice = np.random.default_rng(4)
    base = dice.normal(size=16)
    rows = [(0, base), *((1, base + 0.01 * dice.normal(size=16)) for _ in range(3000)), *((i, dice.normal(size=16)) for i in range(2, 400))]
    got = found(nn.nearest(table(spark, rows)))
    assert got[0][0][1] == 1 and all(len(near) == 5 for near in got.values()) and len(got) == 8


def test_tree_places_every_vector_and_visits_every_leaf_once():
    dice = np.random.default_rng(2)
    x = nn.unit(dice.normal(size=(1500, 16)))
    tree = nn.Tree(x)
    assert set(tree.assign(x)) == set(range(tree.leaves)) and tree.leaves > 20
    for q in x[:5]:
        order = list(tree.visit(q))
        assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.assign(q[None])[0]


def test_calibration_opens_few_leaves_where_data_come_in_clusters():
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(40, 16)) * 5
    x = nn.unit(np.repeat(centres, 60, axis=0) + dice.normal(size=(2400, 16)) * 0.3)
    tree = nn.Tree(x)
    assert nn.calibrated(tree, x) < tree.leaves / 4


@needs_tables
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    true = nn.brute_force(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float))
    got = found(op9_nearest(spark, sf))
    assert set(got) == set(true)
    hits = sum(len({i for _, i, _ in got[q]} & set(near)) for q, near in true.items())
    assert hits / sum(map(len, true.values())) >= 0.9


def test_a_hot_id_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(nn, "SAMPLE_ROWS", 1000)
    dice = np.random.default_rng(7)
    rows = [(0, dice.normal(size=8)) for _ in range(4000)] + [(i, dice.normal(size=8)) for i in range(1, 2500)]
    seen, calibrated = [], nn.calibrated
    monkeypatch.setattr(nn, "calibrated", lambda tree, sample: seen.append(len(sample)) or calibrated(tree, sample))
    got = found(nn.nearest(table(spark, rows)))
    assert seen == [1000]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    true = nn.brute_force(ids, vectors)
    hits = sum(len({i for _, i, _ in got[q]} & set(near)) for q, near in true.items())
    assert hits / sum(map(len, true.values())) >= 0.9
