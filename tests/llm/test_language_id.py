import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import ODD, SF, by_id, needs_tables, no_documents, odd_documents

from workforce_signals.llm import language_id as li
from workforce_signals.llm.queries import op6_language_id, vocabulary

PIECES = ["▁", "▁the", "the", "th", "e", "t", "h", "▁l", "le", "l", "▁un", "u", "n"]


@pytest.fixture(scope="module")
def model():
    counts = {"en": Counter({"the": 50, "then": 10, "hen": 5}), "fr": Counter({"le": 50, "un": 20, "lune": 5})}
    return li.fit(counts, sorted(PIECES))


def by_all_segmentations(model, word):
    """Sum over every way to cut the word, by recursion."""
    probability = {p: model.probability[i] for i, p in enumerate(model.pieces)}
    text = "▁" + word

    def rest(i):
        if i == len(text):
            return np.ones(len(model.languages))
        total = np.zeros(len(model.languages))
        for j in range(i + 1, len(text) + 1):
            p = probability.get(text[i:j])
            if p is None and j == i + 1:
                p = model.probability[-1]
            if p is not None:
                total = total + p * rest(j)
        return total

    return np.log(rest(0)) + np.log(12.0) * len(text)


def test_forward_pass_sums_all_segmentations(model):
    words = ["the", "le", "lethe", "x", "unthen", "漢", "hehehe"]
    assert np.allclose(model.log_words(words), [by_all_segmentations(model, w) for w in words])


def test_probabilities_sum_to_one(model):
    assert np.allclose(model.probability.sum(axis=0), 1)


def test_lattice_finds_every_piece():
    pieces = li.vocabulary_pieces(vocabulary("piece_bpe_32k.model"))
    lattice = li.Lattice(pieces)
    hashes = np.array([lattice._hash(p) for p in pieces])
    assert lattice.find(hashes).tolist() == list(range(len(pieces)))
    assert (lattice.find(hashes + np.uint64(1)) == len(pieces)).all()


def test_scores(model):
    names, share = li.Scorer(model).texts(["the hen", "le lune", "", "12 34!", "½ ²", "THE Then", "zzz"])
    assert names == ["en", "fr", "und", "und", "und", "en", names[-1]]
    assert ((share >= 0) & (share <= 1)).all() and share[2] == share[3] == share[4] == 0


def test_equal_scores_go_to_the_first_language():
    model = li.fit({"b": Counter({"the": 2}), "a": Counter({"the": 2})}, sorted(PIECES))
    assert li.Scorer(model).texts(["the"])[0] == ["a"]


def test_long_runs_of_letters(model):
    names, share = li.Scorer(model).texts(["the" * 20_000, "x" * 100_000])
    assert names[0] == "en" and np.isfinite(share).all()


def test_odd_rows(spark):
    docs, path = odd_documents(spark), vocabulary("piece_bpe_32k.model")
    model = li.train(docs, path)
    assert model.languages == ["en"]
    got = by_id(li.predict(docs, model), "doc_id", "lang_pred")
    expected = [(k, "en" if any(c.isalpha() for c in t or "") else "und") for k, t in ODD]
    assert got == sorted(expected, key=lambda r: tuple((v is not None, v) for v in r))
    nothing = li.train(no_documents(spark), path)
    assert {r["lang_pred"] for r in li.predict(docs, nothing).collect()} == {"und"}
    assert li.predict(no_documents(spark), model).count() == 0


@needs_tables
def test_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op6_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97


def test_a_hot_id_teaches_one_text(spark):
    path = vocabulary("piece_bpe_32k.model")
    texts = {"en": "the hen is there and then", "fr": "la lune est belle et haute", "de": "der mond ist schön und rund"}
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"{texts[name]} {i}", name) for i in ids for name in [sorted(texts)[i % 3]]]
    hot = next(r for r in rows if r[2] == "en")
    schema = "doc_id bigint, text string, lang string"
    more = [(hot[0], f"{texts['fr']} {k}", "en") for k in range(3000)]  # wrong ones, all of one id
    model = li.train(spark.createDataFrame(rows + more, schema), path)
    got = li.predict(spark.createDataFrame(rows, schema), model)
    wrong = got.join(spark.createDataFrame(rows, schema).select("doc_id", "lang"), "doc_id").where("lang <> lang_pred")
    assert model.languages == ["de", "en", "fr"] and wrong.count() == 0


def test_rare_languages_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(li, "MOST_LANGUAGES", 2)
    rows = [(i, "the hen", name) for i, name in enumerate(["a"] * 40 + ["b"] * 30 + [f"x{k}" for k in range(60)])]
    model = li.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), vocabulary("piece_bpe_32k.model"))
    assert model.languages == ["a", "b"]


def test_scores_do_not_depend_on_neighbours(model):
    texts = ["the hen there", "le lune", "", "then hen the the hen", "12"] * 3
    alone = [li.Scorer(model).texts([t]) for t in texts]
    names, share = li.Scorer(model).texts(texts)
    assert names == [n[0] for n, _ in alone] and share.tolist() == [s[0] for _, s in alone]
