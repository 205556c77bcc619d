import hashlib
import random
import zlib

import numpy as np
import pytest

from grouptrace.llm import periodic_runs, queries, words
from tests.llm.brute import documents


def plain_runs(x, min_length=0, min_exponent=2):
    """(start, length, period) of maximal stretches, each with its smallest period only."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(min_length, min_exponent * q))


def collapsed(x, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(x) if i not in dropped)


def planted(doc_id, x):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and x:
        a = g % len(x)
        p = 1 + (len(x) - a) // (3 + g % 8)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(len(x))]
    return x


def of_sequences(docs):
    symbols = np.array([d << 20 | x for d, xs in enumerate(docs) for x in xs], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
    sizes = np.diff(bounds)
    start, end, period = periodic_runs.runs(symbols, np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes))
    return sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())), bounds


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_sequences(letters):
    rnd = random.Random(letters)
    for _ in range(400):
        docs = [[rnd.randrange(letters) for _ in range(rnd.randint(0, 40))] for _ in range(rnd.randint(1, 4))]
        found, bounds = of_sequences(docs)
        assert found == sorted((int(b) + s, n, q) for b, x in zip(bounds, docs) for s, n, q in plain_runs(x))


def test_nested_and_long_periods():
    inner = [1, 2] * 5 + [3]
    assert of_sequences([inner * 4])[0] == plain_runs(inner * 4)
    assert of_sequences([[7] * 100_000])[0] == [(0, 100_000, 1)]
    assert of_sequences([list(range(5000)) * 3 + [0, 1]])[0] == [(0, 15_002, 5000)]
    assert of_sequences([[1, 2, 3], [1, 2, 3], [1, 2, 3]])[0] == []


def test_tables(spark, rows):
    texts = [
        (1, "a a a a a a"), (2, "a a a a a"), (3, None), (4, ""), (5, " \n"), (6, "x y x y x y x y z"), (6, "x y x y x y x y z"), (None, "q " * 50),
        (7, "word" + " und noch" * 40_000), (8, "A a A a A a A a"), (9, "é ü é ü é ü é ü"),
    ]
    found = periodic_runs.found(documents(spark, texts, {"row": "r", "runs": "x"}))
    expected = []
    for d, t in texts:
        x = (t or "").encode().split()
        runs = plain_runs(x, 6, 4) if len(x) < 1000 else [(1, 80_000, 2)]
        expected.append((d, len(x), [tuple(r) for r in runs], collapsed(x, runs)))
    got = [(r.row.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert rows(found, "row.row", "row.runs") == [("r", "x")] * len(texts)
    assert periodic_runs.found(documents(spark, [])).count() == 0


def test_slices_change_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    monkeypatch.setattr(words, "CHUNK_BYTES", 100)
    got = {r.row.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.found(documents(spark, texts)).collect()}
    assert got == {d: plain_runs(t.split(), 6, 4) for d, t in texts}


def test_query(spark, rows):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for doc_id, text in table:
        x = planted(doc_id, (text or "").encode().split())
        runs = plain_runs(x, 6, 4)
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        told = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        expected.append((
            doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(told.encode()).hexdigest(),
            hashlib.sha256(collapsed(x, runs)).hexdigest(),
        ))
    found = queries.op12_periodic_runs(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows(found) == sorted(expected, key=repr)
    assert any(r[1] for r in expected)


def test_planted_runs_of_odd_rows(spark):
    texts = [(i, t) for i in range(60) for t in (None, "", " ", "one", "one two", "a b c d e f g")]
    got = sorted((r.doc_id, (r.text or "").split()) for r in queries.planted_runs(documents(spark, texts)).collect())
    assert got == sorted((d, planted(d, (t or "").split())) for d, t in texts)
