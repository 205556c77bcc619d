import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from grouptrace.llm import words

texts = st.lists(st.one_of(st.none(), st.text("ab \t\n\x0b\x0c\r\x1c é.A", max_size=40)), max_size=12)


def bound(texts):
    found = []
    for row, data, bounds in words.chunks(pa.array(texts, pa.string())):
        found.append((row, words.Words(data, bounds)))
    return found


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_runs_without_ascii_white_space(values):
    got = [w.joined(i) for _, w in bound(values) for i in range(w.n_texts)]
    assert got == [b" ".join((t or "").encode().split()) for t in values]


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 4))
def test_windows_are_equal_as_their_words_are(values, n):
    seen = {}
    for _, w in bound(values):
        start, key = w.windows(n)
        own = [(int(w.text[i]), tuple(w.data[w.start[j]:w.end[j]].tobytes() for j in range(i, i + n))) for i in start]
        assert [t for t, _ in own] == [int(w.text[i + n - 1]) for i in start]
        for (_, window), k in zip(own, key):
            assert seen.setdefault(window, k) == k
    assert len(set(seen.values())) == len(seen)


def test_case_folds_only_ascii():
    (_, w), = bound(["ABC abc Éa éa"])
    data = w.data
    folded = words.Words(data, np.array([0, len(data)]), fold_case=True).hash
    assert folded[0] == folded[1] and folded[2] != folded[3]


def test_chunks_never_cut_a_text(monkeypatch):
    monkeypatch.setattr(words, "CHUNK_BYTES", 10)
    values = ["a" * 50, "b", "c", "", None, "d" * 9, "e" * 30]
    pieces = [(row + i, data[a:b].tobytes().decode()) for row, data, bounds in words.chunks(pa.array(values))
              for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    assert pieces == [(i, t or "") for i, t in enumerate(values)]


def test_sliced_columns():
    column = pa.array(["x", "a b", None, "c"], pa.string()).slice(1, 2)
    assert [w.joined(i) for _, w in ((r, words.Words(d, b)) for r, d, b in words.chunks(column))
            for i in range(w.n_texts)] == [b"a b", b""]


def test_packing_round_trip(spark):
    rows = spark.createDataFrame([("é b",), (None,), ("",)], "text string")
    packed = rows.select(words.packed(rows.text).alias("p")).toArrow()["p"].combine_chunks()
    assert [x if x is None else x.decode() for x in words.unpacked(packed).to_pylist()] == ["é b", None, ""]
