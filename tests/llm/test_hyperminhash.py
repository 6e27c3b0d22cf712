import random
import re

import numpy as np
import pytest
from compare import difference, duck
from fixtures_llm import ODD, SF, by_id, needs_tables, no_documents, odd_documents

from workforce_signals.llm import components, connect
from workforce_signals.llm import hyperminhash as h
from workforce_signals.llm.queries import op13_hyperminhash

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")
DOCS = "doc_id bigint, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 2:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words[:-1], words[1:], strict=True))


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * (len(a) + len(b) - both)


def brute_force(texts):
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(texts):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    out = [(key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(texts, sets, strict=True))]
    return sorted(((*r, r[0] == r[2]) for r in out), key=lambda r: tuple((v is not None, v) for v in r))


def got(spark, texts):
    return by_id(h.near_duplicates(spark.createDataFrame(texts, DOCS)), *COLUMNS)


def near_copies(seed, groups=12, copies=14, sizes=(1, 2, 3, 4, 5, 6, 8, 20, 40, 120, 600)):
    """Groups whose members differ by chains of small changes, many of them close to the threshold."""
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(groups):
        words = [dice.choice(vocabulary) for _ in range(dice.choice(sizes))]
        for _ in range(copies):
            if dice.random() < 0.7:
                for _ in range(max(1, len(words) * dice.choice([0, 2, 4, 6]) // 100)):
                    at = dice.randrange(len(words))
                    words[at : at + dice.choice([0, 1, 1])] = [dice.choice(vocabulary).upper()]
            texts.append(dice.choice([" ", "\n", " \t"]).join(words))
    dice.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = near_copies(seed, groups=30)
    assert got(spark, texts) == brute_force(texts)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(connect, "BLOCK", 3)
    texts = near_copies(3, groups=8, copies=40, sizes=(6, 20, 60))
    assert got(spark, texts) == brute_force(texts)


def test_large_sets_make_more_tiles(spark, monkeypatch):
    monkeypatch.setattr(connect, "BLOCK_SHINGLES", 100)
    texts = near_copies(4, groups=4, copies=25, sizes=(60, 120))
    assert got(spark, texts) == brute_force(texts)


def test_many_copies_of_which_a_third_are_equal(spark):
    dice = random.Random(8)
    base = [f"v{dice.randrange(5000)}" for _ in range(90)]
    texts = [" ".join(base)] * 300
    for _ in range(300):
        words = list(base)
        for at in dice.sample(range(90), 4):
            words[at] = f"u{dice.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"t{dice.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    texts = list(enumerate(texts))
    assert got(spark, texts) == brute_force(texts)


def test_similarity_of_exactly_the_threshold(spark):
    for shared in (79, 80):  # of 100 shingles in both
        a = [f"v{i}" for i in range(91)]
        b = a[: shared + 1] + [f"u{i}" for i in range(100 - 90)]
        sets = shingles(" ".join(a)), shingles(" ".join(b))
        texts = [(1, " ".join(a)), (2, " ".join(b))]
        assert len(sets[0] | sets[1]) == 100 and got(spark, texts) == brute_force(texts)
    texts = [(1, "a b c d e"), (2, "a b c d e f"), (3, "a b c d"), (4, "x y z"), (5, "x y z w")]  # 4 of 5 shingles, 3 of 4, 2 of 3
    assert got(spark, texts) == brute_force(texts)


def test_registers_are_leading_zeros_and_mantissa():
    dice = np.random.default_rng(2)
    hashes = np.concatenate((dice.integers(0, 1 << 64, 500, dtype=np.uint64), dice.integers(0, 1 << 40, 500, dtype=np.uint64) | np.uint64(1 << 20)))
    for value, register in zip(hashes.tolist(), h.compressed(hashes).tolist(), strict=True):
        bits = f"{value:064b}"
        zeros = bits.index("1")
        assert register == zeros << h.MANTISSA | int((bits + "0" * 64)[zeros + 1 : zeros + 1 + h.MANTISSA], 2)
    order = np.sort(dice.integers(0, 1 << 64, 500, dtype=np.uint64))
    for row in (order, order[:7], order[:1]):
        found = h.registers([row])[0]
        for bucket in range(len(found)):
            mine = [v for v in row.tolist() if v % len(found) == bucket]
            if mine:
                assert found[bucket] == h.compressed(np.array([min(mine)], np.uint64))[0]
        assert set(found.tolist()) <= set(h.compressed(row).tolist())


def random_sets(dice, n, similarity):
    both = round(n * similarity)
    values = dice.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
    return np.sort(values[:n]), np.sort(values[n - both :])


@pytest.mark.parametrize("n", [5, 20, 200, 5000])
def test_estimates_and_bands(n):
    dice = np.random.default_rng(n)
    for jaccard in (0.0, 0.8):
        found, missed = [], 0
        for _ in range(150):
            a, b = random_sets(dice, n, 2 * jaccard / (1 + jaccard))
            ra, rb = h.registers([a, b])
            found.append(h.estimates(ra, len(a), rb[None], np.array([len(b)]))[0])
            bands = (ra[: h.BANDS * h.BAND] == rb[: h.BANDS * h.BAND]).reshape(h.BANDS, h.BAND).all(axis=1)
            missed += not bands.any()
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(found) - truth) < 0.03
        assert jaccard == 0 or (missed == 0 and min(found) >= h.PASSED)


def test_collisions_are_those_that_happen(monkeypatch):
    dice = np.random.default_rng(9)
    equal = [0, 0]
    for _ in range(300):
        a, b = random_sets(dice, 2000, 0.0)
        ra, rb = h.registers([a, b])
        equal[0] += int((ra >> 6 == rb >> 6).sum())  # with 4 mantissa bits, so that there is something to count
    h._collision.cache_clear()
    monkeypatch.setattr(h, "MANTISSA", 4)
    expected = 300 * 256 * h._collision(44, 44)
    h._collision.cache_clear()
    assert 0.85 < equal[0] / expected < 1.15


def test_odd_rows(spark):
    assert by_id(h.near_duplicates(odd_documents(spark)), *COLUMNS) == brute_force(ODD)
    assert h.near_duplicates(no_documents(spark)).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 2, "x", 3)], "doc_id bigint, text string, size int, packed string, hub int")
    assert by_id(h.near_duplicates(clash), *COLUMNS) == [(1, 2, 1, True)]


def test_long_words_that_a_polynomial_modulo_a_power_of_two_mixes_up(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    assert got(spark, [(1, word), (2, other)]) == brute_force([(1, word), (2, other)])


def test_a_hot_id_and_rows_without_one(spark):
    texts = [(None if i % 3 else 7 if i % 2 else i, t) for i, t in near_copies(5, groups=10)]
    assert got(spark, texts) == brute_force(texts)


@needs_tables
def test_whole_table(spark):
    assert difference(op13_hyperminhash(spark, SF), duck(SF), h.ORACLE_SQL) == ""
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(op13_hyperminhash(spark, SF), *COLUMNS) == brute_force(texts)


def test_components_stop_at_stars(spark, monkeypatch):
    stored, real = [], components.store
    monkeypatch.setattr(components, "store", lambda df, name: stored.append(name) or real(df, name))
    stars = spark.createDataFrame([(5, 1), (7, 1), (1, 9), (4, 2), (3, 3)], "a bigint, b bigint")
    assert sorted(map(tuple, components.components(stars).collect())) == [(4, 2), (5, 1), (7, 1), (9, 1)]
    assert stored == ["links-0"]
    stored.clear()
    path = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (5, 4)], "a bigint, b bigint")
    assert sorted(map(tuple, components.components(path).collect())) == [(2, 1), (3, 1), (4, 1), (5, 1)]
    assert components._are_stars(components.components(path).withColumnsRenamed({"node": "a", "root": "b"}))
