import re
import zlib

import numpy as np
import pytest
from fixtures_llm import CLASHING, ODD, SF, by_id, needs_tables, no_documents, odd_documents

from workforce_signals.llm import quality
from workforce_signals.llm.queries import op4_quality_rules
from workforce_signals.llm.statistics import STATISTICS, text_statistics


def statistics(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return text_statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)


def by_hand(text):
    """Some of the statistics, the plain way."""
    raw = text.encode()
    words = re.findall(rb"[^ \t\n\v\f\r]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    kinds = {"upper": rb"[A-Z]", "lower": rb"[a-z]", "digits": rb"[0-9]", "spaces": rb"[ \t\n\v\f\r]", "stops": rb"[.!?]"}
    out = {"n_bytes": len(raw), "n_words": len(words), "n_lines": len(lines)}
    out |= {k: len(re.findall(p, raw)) / len(raw) if raw else 0 for k, p in kinds.items()}
    if words:
        low = [w.lower() for w in words]
        out["word_length"] = sum(map(len, words)) / len(words)
        out["distinct_words"] = len(set(low)) / len(words)
        out["top_word"] = max(map(low.count, low)) / len(words)
        out["shouted_words"] = sum(bool(re.search(rb"[A-Z].*[A-Z]", w)) and not re.search(rb"[a-z]", w) for w in words) / len(words)
        out["words_without_letters"] = sum(not re.search(rb"[A-Za-z\x80-\xff]", w) for w in words) / len(words)
        out["long_words"] = sum(len(w) > 20 for w in words) / len(words)
    if lines:
        out["distinct_lines"] = len({b" ".join(re.findall(rb"[^ \t\n\v\f\r]+", x.lower())) for x in lines}) / len(lines)
        out["lines_ending_in_stops"] = sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
    return out


def test_statistics_against_the_plain_way():
    texts = ["", "a", "Hello, World! 12\nhello, world! 12\nTHE END.", "x" * 50 + " !!! $$$", " \n\n ", "ÄÖ ä 漢\n.", "a b a B", "\n.\n"]
    for row, text in zip(statistics(texts), texts, strict=True):
        for name, value in by_hand(text).items():
            assert row[STATISTICS.index(name)] == pytest.approx(value), (text, name)


def made_up(n=600):
    dice = np.random.default_rng(0)
    x = dice.random((n, len(STATISTICS)))
    y = (x[:, 3] > 0.4) & (x[:, 5] < 0.7) | (x[:, 8] > 0.9)
    return x, y.astype(float)


def test_rules_learn_conjunctions():
    x, y = made_up()
    model = quality.fit_rules(x[:400], y[:400])
    assert 0 < len(model.rules) < 80
    raw = model.bias + sum(w * quality._holds(x[400:], rule) for w, rule in model.rules)
    assert ((raw > 0) == y[400:]).mean() > 0.9


def test_column_equals_the_rules(spark):
    x, y = made_up(200)
    model = quality.fit_rules(x, y)
    raw = model.bias + sum(w * quality._holds(x, rule) for w, rule in model.rules)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ", ".join(["i int", *(f"{s} double" for s in STATISTICS)]))
    got = {r["i"]: r["s"] for r in df.select("i", model.column().alias("s")).collect()}
    assert [got[i] for i in range(200)] == pytest.approx((1 / (1 + np.exp(-raw))).tolist())


@pytest.mark.parametrize("labels", [[], [1, 1, 1], [0, 0]])
def test_without_both_labels_the_score_is_the_share(labels):
    model = quality.fit_rules(np.zeros((len(labels), len(STATISTICS))), np.array(labels, float))
    assert model.rules == () and 1 / (1 + np.exp(-model.bias)) == pytest.approx((sum(labels) + 1) / (len(labels) + 2))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    got = by_id(quality.score(docs, model), "doc_id", "score", "predicted")
    assert [r[0] for r in got] == sorted([k for k, _ in ODD], key=lambda k: (k is not None, k))
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in got)
    assert quality.score(no_documents(spark), model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and set(CLASHING) <= set(kept.columns)
    assert kept.count() == sum(p for *_, p in got)
    assert quality.train(no_documents(spark), labels).rules == ()


@needs_tables
def test_held_out_rows_are_scored_right(spark):
    tables = SF.replace("0.001", "0.01")
    got = op4_quality_rules(spark, tables).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95


@needs_tables
def test_held_out_labels_are_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert quality.train(docs, labels) == quality.train(docs, turned)


def test_a_hot_id_teaches_one_text(spark, monkeypatch):
    """Rows of one id must not fill the sample: with and without 5,000 more of them the model is the same."""
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 300)
    good = "The river, wide and slow, passed the old town in the calm of the evening. " * 3
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5]
    hot = ids[0]
    rows = [(i, f"{good}{i}" if i % 2 else "BUY NOW!!! $$$ 1234 %%% " * 6 + str(i)) for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    schema = "doc_id bigint, text string"
    hashes = spark.createDataFrame([(f"x {k}",) for k in range(20_000)], "t string").selectExpr("t", f"xxhash64(t) > (SELECT xxhash64(text) FROM VALUES ('{dict(rows)[hot]}') AS v(text)) AS more")
    more = [(hot, r["t"]) for r in hashes.where("more").limit(5000).collect()]
    plain, crowded = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + more, schema)
    model = quality.train(crowded, labels)
    assert model == quality.train(plain, labels) and model.rules
    scores = [r["predicted"] == r["doc_id"] % 2 for r in quality.score(plain, model).collect()]
    assert np.mean(scores) > 0.95
