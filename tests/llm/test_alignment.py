import hashlib
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures_llm import ODD, SF, by_id, needs_tables, no_documents, odd_documents

from workforce_signals.llm import alignment as a
from workforce_signals.llm.queries import op11_token_alignment, vocabulary

FIRST, SECOND = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(FIRST)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    letters = a._byte_of_letter()
    names = {i: n for n, i in one.get_vocab().items()}

    def first(text):
        ids = one.encode(f" {text}", add_special_tokens=False).ids
        return ids, [bytes(letters[c] for c in names[i]) for i in ids]

    def second(text):
        pieces = two.encode(text, out_type=str)
        return two.encode(text), [bytes([int(p[3:5], 16)]) if two.is_byte(two.piece_to_id(p)) else p.replace("▁", " ").encode() for p in pieces]

    return first, second


def groups_of(first, second, text):
    """Groups ([ids of A], [ids of B]) by walking over both lists."""
    if not text:
        return []
    (x, xs), (y, ys) = first(text), second(text)
    if not b"".join(xs) == b"".join(ys) == f" {text}".encode():
        return []
    ends = [{sum(map(len, s[: i + 1])) for i in range(len(s))} if len(s) < 400 else set(np.cumsum([len(t) for t in s]).tolist()) for s in (xs, ys)]
    both, out = sorted(ends[0] & ends[1]), []
    for ids, parts, side in ((x, xs, 0), (y, ys, 1)):
        at, g = 0, 0
        for i, part in zip(ids, parts, strict=True):
            if side == 0 and len(out) == g:
                out.append(([], []))
            out[g][side].append(i)
            at += len(part)
            g += at == both[g]
    return out


def brute_force(libraries, texts):
    found = [(key, groups_of(*libraries, text)) for key, text in texts]
    links = [Counter((x, y) for one, two in groups for x in one for y in two) for _, groups in found]
    count, best = Counter(), defaultdict(int)
    for pairs in links:
        count.update(pairs.keys())
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (key, groups), pairs in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(n for p, n in pairs.items() if count[p] == best[p[0]])
        numbers = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(pairs.values())
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((key, *numbers, n_best, sum(n * count[p] for p, n in pairs.items()), digest))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def got(spark, texts):
    return by_id(a.align(spark.createDataFrame(texts, "doc_id bigint, text string"), FIRST, SECOND), *COLUMNS)


STRANGE = ["<|endoftext|>", "<s> </s> <unk>", "a  b   c", " lead", "trail ", "\n\n\t x", "▁ ▁", "\x00", "naïve Ünïcode", "漢字かな", "😀👩‍👩‍👧", "é", "ﬁ ① ™", " x　y", "<0x41>", "don't we'll I'm", "1234567 12.5", "a\r\nb", "﻿x", "aaaa" * 30]


def test_odd_texts(spark, libraries):
    texts = [*ODD, *((100 + i, t) for i, t in enumerate(STRANGE)), (7, "x" * 9000 + " " * 5000 + "y" * 3000), (8, "0" * 3000)]
    assert got(spark, texts) == brute_force(libraries, texts)
    clash = by_id(a.align(odd_documents(spark).withColumnRenamed("spans", "pair").withColumnRenamed("leaf", "row"), FIRST, SECOND), *COLUMNS)
    assert clash == brute_force(libraries, ODD)
    assert a.align(no_documents(spark), FIRST, SECOND).count() == 0


def random_texts(seed, n):
    dice = random.Random(seed)
    words = ["the", "The", "Straße", "12", "x1", "don't", "漢字", "..", "--", "\n", "  ", "é", "co-op", "https://a.b/c?d=1", "😀"]
    return [(i, "".join(dice.choice(words) + dice.choice(["", " ", " "]) for _ in range(dice.randrange(40)))) for i in range(n)]


def test_against_brute_force(spark, libraries):
    texts = random_texts(1, 300) + [(None, "the same"), (5, "the same"), (5, "the same")]
    assert got(spark, texts) == brute_force(libraries, texts)


@pytest.mark.parametrize("frequent", [0, 40, 200])
def test_pairs_beyond_those_known_to_all_tasks_are_joined(spark, libraries, monkeypatch, frequent):
    monkeypatch.setattr(a, "FREQUENT", frequent)
    texts = random_texts(2, 200)
    assert got(spark, texts) == brute_force(libraries, texts)


def test_small_steps_change_nothing(libraries, monkeypatch):
    texts = [t for _, t in random_texts(3, 60) if t]
    first, second = a.ByteLevel(open(FIRST, encoding="utf-8").read()), a.Pieces(open(SECOND, "rb").read())
    (x, x_at), (y, y_at) = first.encode([f" {t}" for t in texts]), second.encode(texts)
    told = a._same_bytes(texts, y, y_at, second.bytes)
    (x, x_at), (y, y_at) = a._of_rows(x, x_at, told), a._of_rows(y, y_at, told)
    groups = a.Groups(first.bytes.length[x], second.bytes.length[y])
    doc = a._doc_of(groups, x_at)
    whole = groups.pairs(x, y, doc)
    for links in (1, 7, 100):
        monkeypatch.setattr(a, "LINKS", links)
        again = groups.pairs(x, y, doc)
        assert all(np.array_equal(u, v) for u, v in zip(whole, again, strict=True))


def test_pointers_end_at_the_last_token_of_a_group():
    dice = np.random.default_rng(4)
    for _ in range(200):
        n = int(dice.integers(1, 60))
        cuts = [np.unique(np.append(dice.integers(1, n + 1, dice.integers(0, 30)), n)) for _ in range(2)]
        last = a.terminals(*cuts)
        both = np.intersect1d(*cuts)
        expected = np.concatenate([np.searchsorted(cuts[1], both[np.searchsorted(both, c)]) for c in cuts])
        assert np.array_equal(last, expected)
    chain = a.terminals(np.arange(1, 2001, 2).clip(max=1999), np.append(np.arange(2, 1999, 2), 1999))  # one group of 2,000 tokens
    assert set(chain.tolist()) == {999}


def test_every_code_point_as_the_library(libraries):
    first = a.ByteLevel(open(FIRST, encoding="utf-8").read())
    assert first.fast is not None
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = [" " + "".join(f"a{c}b {c}1{c}{c}'{c}  {c}" for c in points[i : i + 60]) for i in range(0, len(points), 60)]
    ids, offsets = first.encode(texts)
    slow = first.slow.encode_batch(texts, add_special_tokens=False)
    different = [t for t, s, x, y in zip(texts, slow, offsets[:-1], offsets[1:], strict=True) if s.ids != ids[x:y].tolist()]
    assert different == []


@needs_tables
def test_whole_table(spark, libraries):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(op11_token_alignment(spark, SF), *COLUMNS) == brute_force(libraries, texts)
