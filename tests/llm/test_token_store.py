import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures_llm import LONG, ODD, SF, needs_tables, no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from workforce_signals.llm import token_store as ts
from workforce_signals.llm.queries import op7_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
with open(PATH, "rb") as _file:
    WORDS = ts.Words(_file.read())


def expected(rows):
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


_signs = st.text(alphabet=st.sampled_from("aB s'td\n\t 1½.,!é漢😀 　é́ΣΑσ "), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(_signs, st.text(max_size=20)), max_size=6))
def test_words_make_the_ids_of_the_whole_text(texts):
    ids, offsets = WORDS.encode(texts, 1)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_every_letter_before_a_sign():
    words = [w.format(chr(c)) for c in range(0x20, 0x3000) for w in ("{}", "a{}", "A{}b", "x{}.", "{}!,", "e{}\u0301")]
    ids, offsets = WORDS.encode(words, 1)
    whole = WHOLE.encode_batch_fast(words, add_special_tokens=False)
    assert [ids[a : b - 1].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [w.ids for w in whole]


_spelled = st.lists(st.one_of(_signs, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|EndOfText|>", "<|", "|>"])), max_size=6).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(_spelled, max_size=6))
def test_special_tokens_are_those_of_the_library(texts):
    """The library at its defaults, with special tokens inside words, at line ends, in other capitals and cut short."""
    texts = [*texts, "a <|endoftext|> b", "x<|endoftext|>\ny", "<|startoftext|><|endoftext|>", "é<|startoftext|>\u0301"]
    ids, offsets = WORDS.encode(texts, 1)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_special_tokens_in_files(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "plain"), (3, "<|startoftext|>"), (4, None)]
    ts.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, str(tmp_path / "store"))
    assert [tuple(r) for r in ts.token_digests(spark, str(tmp_path / "store")).orderBy("doc_id").collect()] == expected(rows)


def test_dictionary_is_not_filled_by_a_hot_id(spark, tmp_path, monkeypatch):
    rows = [(0, f"hot {i} text") for i in range(5000)] + [(i, f"document {i} " + "of many words " * 20) for i in range(1, 40)]
    seen = []
    monkeypatch.setattr(ts, "train_dictionary", lambda samples: seen.append(samples) or b"".join(samples)[:2000])
    for k in range(2):
        ts.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3 + k), PATH, str(tmp_path / f"{k}"))
    assert len(seen[0]) == 40 and seen[0] == seen[1]


def test_long_text():
    ids, offsets = WORDS.encode([LONG, ""], 1)
    assert ids[: offsets[1]].tolist() == [*WHOLE.encode(LONG, add_special_tokens=False).ids, 1] and ids[offsets[1] :].tolist() == [1]


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    ts.write_tokens(odd_documents(spark), PATH, path)
    got = sorted((tuple(r) for r in ts.token_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    with_id = {k: t for k, t in ODD if k is not None}
    for key, _, n, crc in got:
        if key is not None:
            assert (n, crc) == expected([(key, with_id[key])])[0][2:]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "store")
    ts.write_tokens(no_documents(spark), PATH, path)
    assert ts.read_tokens(spark, path).count() == 0
    assert ts.read_documents(spark, path, [1]).count() == 0


def test_few_documents_are_read_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, f"document number {i} " * (i % 7)) for i in range(300)]
    ts.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, path)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in ts.read_documents(spark, path, [3, 250, 999]).collect()}
    assert found == {r[0]: r[1:] for r in expected(rows) if r[0] in (3, 250)}
    assert ts.read_documents(spark, path, []).count() == 0


def test_another_dictionary_is_refused():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"dictionary": "other", "doc_ids": [1], "counts": [1], "offsets": [0, 1], "frames": b"x", "base": 0}])
    with pytest.raises(ValueError, match="needs the dictionary other"):
        list(ts._unpack(b"some", 2)(iter([batch])))


@needs_tables
def test_whole_table(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(tuple(r) for r in op7_token_files(spark, SF).collect()) == expected(rows)
