import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from grouptrace.llm import queries, token_counts, words
from tests.llm.brute import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in found.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.Vocabulary(PATH))


def counts(counter, texts, size=token_counts.SLICE_BYTES):
    out = []
    for _, data, bounds in words.chunks(pa.array(texts, pa.string()), size):
        out += counter.count(data, bounds).tolist()
    return out


PARTS = [
    "'s", "'re", "'ll", "'l", "'r", "'v", "'ve", "'", "''", "  ", " ", "\n", "\t", "\n\n", "abc", "Ab", "1", "23", "!", "?!", "é",
    "漢字", " ", "　", "<|endoftext|>", "<|endof", " the", "don't", "\r\n", "😀", "²", "ⅷ", "́", "a", "r", "e", "l",
]


def test_mixed_texts_count_as_in_the_library(counter, library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(8000)]
    assert counts(counter, texts) == library(texts)


def test_single_characters_and_classes(counter, library):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in range(1, 0x3100)] + [chr(c) for c in range(0x1F000, 0x1F700)]
    assert counts(counter, texts) == library(texts)


def test_unbroken_pieces_of_many_lanes(counter, library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(alphabet) for _ in range(n)) for alphabet in ("ab", "acgt", "abcdefghijklmnopqrstuvwxyz", "0123456789")
             for n in (1, 255, 256, 257, 511, 3000)]
    texts += [c * n for c in "a -=x" for n in (1, 63, 64, 65, 257, 1000)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "x" * 200_000]
    assert counts(counter, texts) == library(texts)


def test_slices_and_forgotten_states_change_nothing(counter, library, monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(50)) + "".join(rnd.choice("abcdef") for _ in range(600)) for _ in range(60)]
    monkeypatch.setattr(token_counts, "STATES", 100)
    monkeypatch.setattr(token_counts, "LANES", 50)
    assert counts(counter, texts, 1000) == library(texts)


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_composed_maps_equal_a_walk(chunk):
    rnd = random.Random(4)
    kinds = [rnd.randrange(11) for _ in range(500)] + [token_counts.END]
    import numpy as np

    state, starts = token_counts.START, [False] * len(kinds)
    for i, kind in enumerate(kinds):
        state, marks = token_counts._step(state, kind)
        starts[i] |= bool(marks & token_counts.BEFORE)
        if marks & token_counts.BEFORE_LAST:
            starts[i - 1] = True
    assert token_counts.piece_marks(np.array(kinds, dtype=np.uint8), chunk).tolist() == starts


def test_tables(spark, library, rows):
    texts = [(1, "Hello world, it's 12 o'clock"), (2, None), (3, ""), (3, "x  y\n"), (None, "a<|endoftext|>b"), (5, "word " * 30_000)]
    found = token_counts.counted(documents(spark, texts, {"row": "r", "n_tokens": 7}), PATH)
    expected = [(d, len((t or "").encode()), n) for (d, t), n in zip(texts, library([t or "" for _, t in texts]))]
    assert rows(found, "row.doc_id", "n_bytes", "n_tokens") == sorted(expected, key=repr)
    assert rows(found, "row.row", "row.n_tokens") == [("r", 7)] * len(texts)
    assert token_counts.counted(documents(spark, []), PATH).count() == 0


def test_query(spark, library, rows):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    n = library([r.text or "" for r in table])
    expected = [(r.doc_id, len((r.text or "").encode()), k, k > 1024) for r, k in zip(table, n)]
    assert rows(queries.op11_token_counts(spark, "/root/testdata/sf0.001")) == sorted(expected, key=repr)
