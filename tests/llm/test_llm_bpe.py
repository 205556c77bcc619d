import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import documents

from grouptrace.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(ranks):
    return byte_bpe.Coder(ranks, public_tokenizers.PATTERN)


def samples():
    r = random.Random(3)
    anything = [chr(c) for c in (*range(32, 0x250), *range(0x4E00, 0x4E40), 0x1F600, 0x1C, 0x85, 0x2028, 0x3000)]
    out = ["", "a", " ", "\n\n", "I'll we've 123 4567", "<|endoftext|>", "a" * 3000, " " * 500 + "x", "ab" * 700, "é" * 300]
    out += ["".join(r.choice("abcdefgh") for _ in range(1500)), "\u4e00" * 100 + "!?" * 90]
    out += ["".join(r.choice(anything) for _ in range(r.randrange(1, 400))) for _ in range(40)]
    out += [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 14))) for _ in range(200)) for _ in range(5)]
    return out


def test_ids_are_those_of_the_public_library(coder, reference):
    texts = samples()
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == reference.encode_ordinary(text)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "0123456789", "acgt", "a", "=-", "äöüé漢"])
def test_long_unbroken_pieces(coder, reference, letters):
    r = random.Random(letters)
    text = "".join(r.choice(letters) for _ in range(100_000 if len(letters) > 5 else 20_000))
    started = time.perf_counter()
    ids = coder.encode([text])[0]
    assert time.perf_counter() - started < 20
    assert ids.tolist() == reference.encode_ordinary(text)


def test_lengths_around_the_windows(coder, reference):
    r = random.Random(8)
    texts = ["".join(r.choice("abcde") for _ in range(n)) for n in (1, 2, 31, 32, 33, 63, 64, 65, 95, 96, 97, 127, 128, 129, 257)]
    assert [x.tolist() for x in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_windows_without_a_common_token_grow(coder, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SHORT", 4)
    coder._forget()
    texts = ["internationalization" * 3, "x" * 90, "aquickbrownfoxjumpsoverthelazydog" * 4]
    assert [x.tolist() for x in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    coder._forget()


def test_decoding_gives_the_bytes_back(coder):
    texts = samples()
    assert coder.decode(coder.encode(texts)) == [t.encode() for t in texts]


def test_both_recursions_agree(coder, monkeypatch, reference):
    texts = samples()[:14]
    monkeypatch.setattr(byte_bpe, "SHORT", 0)
    coder._forget()
    assert [x.tolist() for x in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    coder._forget()


def test_pieces_are_forgotten_and_learnt_again(coder, monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 3)
    for text in ("one two three four five", "six one seven", "two two two"):
        assert [x.tolist() for x in coder.encode([text])] == [reference.encode_ordinary(text)]


def test_a_worker_holds_few_pieces_and_no_database_between_tasks(ranks, monkeypatch, reference):
    coder = byte_bpe.Coder(ranks, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 40)
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 10)
    often = " common often again"
    for i in range(30):
        text = often + "".join(f" zq{i}x{k}" for k in range(5))
        assert [x.tolist() for x in coder.encode([text])] == [reference.encode_ordinary(text)]
        assert len(coder.codes) == len(coder.lengths) == len(coder.uses) and coder.lengths.sum() == len(coder.ids)
    # The most used outlast the bound; the rest doesn't pile up.
    assert {" common", " often", " again"} <= set(coder.codes) and len(coder.codes) < 80
    coder.rest()
    assert coder._db is None and len(coder.codes) <= 40
    assert coder.decode(coder.encode([often])) == [often.encode()]


def test_small_vocabulary_contracts_the_leftmost_least_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 301, b"abc": 256, b"cc": 302}
    coder = byte_bpe.Coder(ranks, r"\S+|\s+")
    # abc is a token of its own; in xabcc, ab goes first, then its merge with c, which ranks lower than all
    assert [x.tolist() for x in coder.encode(["abc", "xabcc", "bcc", "ccc"])] == [
        [256], [120, 256, 99], [301, 99], [302, 99]]


def test_tables(spark, reference):
    texts = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "x" * 20000)]
    rows = byte_bpe.coded(documents(spark, texts, {"tokens": "t", "row": 1, "decoded": 2}), PATH, public_tokenizers.PATTERN)
    got = [(r["row"]["doc_id"], np.frombuffer(r.tokens, "<u4").tolist(), r.decoded.decode(), r["row"]["tokens"])
           for r in rows.collect()]
    want = [(d, reference.encode_ordinary(t or ""), t or "", "t") for d, t in texts]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert byte_bpe.coded(documents(spark, []), PATH, public_tokenizers.PATTERN).collect() == []
