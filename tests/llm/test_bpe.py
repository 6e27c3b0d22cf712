import base64
import hashlib

import public_tokenizers
import tiktoken
from fixtures_llm import LONG, ODD, SF, by_id, needs_tables, no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from workforce_signals.llm import bpe
from workforce_signals.llm.queries import op2_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as _file:
    RAW = _file.read()
RANKS = bpe.Ranks(RAW).prepare()
THEIRS = tiktoken.Encoding(
    "own",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())},
    special_tokens={},
)


def digests(text):
    ids = THEIRS.encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def check(texts):
    ids, offsets = RANKS.encode(texts)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == THEIRS.encode_ordinary(text), text
        assert RANKS.bytes_of(ids[a:b]).tobytes() == text.encode()


_signs = st.text(alphabet=st.sampled_from("a s'tmdrevl\n\t 1½.,!é漢😀 　\x1c\x00"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(_signs, st.text(max_size=30)), max_size=8))
def test_ids_are_those_of_the_library(texts):
    check(texts)


def test_hard_texts():
    check(["x" * 4000, "", "'", "'s", " 's", "!'s", "'s's", "''s", "'re're", "ab'" * 200, "1" * 2000, " " * 999, "\n \n a", LONG])


def test_scan_composes_functions():
    own, _, compose, state, _ = bpe._automaton()
    size = int(len(compose) ** 0.5)
    codes = own[[(i * i + i // 3) % 7 for i in range(3000)]]
    now, expected = codes[0], []
    for i, code in enumerate(codes):
        now = code if i == 0 else compose[int(now) * size + int(code)]
        expected.append(int(now))
    assert bpe._scan(codes, compose).tolist() == expected


def test_odd_rows(spark):
    got = by_id(bpe.token_digests(odd_documents(spark), PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = [(key, *digests(text or "")) for key, text in ODD]
    assert got == sorted(expected, key=lambda r: tuple((v is not None, v) for v in r))
    assert bpe.token_digests(no_documents(spark), PATH).count() == 0


def test_offsets_cut_the_text(spark):
    text = "don't stop, naïve 😀 reader"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), PATH).first()
    cuts, raw = [0, *row["ends"]], text.encode()
    assert [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [RANKS.token[i] for i in row["ids"]]


def test_decoding_keeps_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, [5, 6], "k", "old"), (2, None, "l", "old")], "doc_id bigint, ids array<int>, k string, decoded string")
    found = {r["doc_id"]: r for r in bpe.decode(rows, PATH, keep_ids=True).collect()}
    assert bytes(found[1]["decoded"]) == RANKS.token[5] + RANKS.token[6] and found[1]["k"] == "k"
    assert found[2]["decoded"] is None and found[2]["ids"] is None


@needs_tables
def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op2_byte_bpe(spark, SF).collect()}
    assert got == {key: digests(text) for key, text in texts.items()}
