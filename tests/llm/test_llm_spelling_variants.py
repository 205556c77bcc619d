import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from grouptrace.llm import queries, spelling_variants as sv
from tests.llm.brute import documents

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def plain_counts(texts):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{low}".encode())
            if doc_id is not None and h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_near(vocabulary):
    """word -> near words, by deletion neighbourhoods."""
    holes = defaultdict(set)
    for w in vocabulary:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in vocabulary:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in vocabulary:
                near[w].add(short)
                near[short].add(w)
    return near


def plain(texts):
    counts = plain_counts(texts)
    near = plain_near(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def variants(rnd, n, letters=LETTERS):
    """Words with planted single edits at all places."""
    words = set()
    while len(words) < n:
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(6, 14)))
        words.add(w)
        for _ in range(3):
            i = rnd.randrange(len(w) + 1)
            kind = rnd.randrange(3)
            w = w[:i] + (rnd.choice(letters) if kind < 2 else "") + w[i + (kind > 0):]
            if len(w) >= 6:
                words.add(w)
    return words


@pytest.mark.parametrize("letters,rare", [("ab", 1), ("ab", 20), ("abc", 3), ("abcdefgh", 2), (LETTERS, 1)])
def test_near_words(spark, monkeypatch, letters, rare):
    monkeypatch.setattr(sv, "RARE", rare)
    rnd = random.Random(f"{letters}{rare}")
    words = variants(rnd, 1500, letters) | {"aaaaaa" * k for k in range(1, 30)} | {"a" * k for k in range(6, 40)}
    found = sv.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    pairs = [(r.a, r.b) for r in found.collect()]
    near = plain_near(words)
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in near for b in near[a] if a < b}


@pytest.mark.parametrize("letters", ["ab", "abcd"])
def test_bound_holds_for_every_edit(letters):
    rnd = random.Random(letters)
    words = [x for x in variants(rnd, 400, letters)]
    counts = Counter(w[i:i + q] for w in words for q in (2, 3, 4) for i in range(len(w) - q + 1))
    grams = sv.Grams({g: n for g, n in counts.items() if n > 60})
    for word in words[:150]:
        for longest in range(2, min(5, len(word) // 2) + 1):
            own = grams.decomposed(word, longest)
            for inserting in (False, True):
                bound = grams.most_affected(word, own, longest, inserting)
                assert bound < len(own)
                for i in range(len(word) + inserting):
                    for c in ([""] if not inserting else []) + list(letters):
                        other = word[:i] + c + word[i + (not inserting):]
                        theirs = {(a, other[a:b]) for a, b in grams.decomposed(other, longest)}
                        shift = len(other) - len(word)
                        kept = sum((a, word[a:b]) in theirs or (a + shift, word[a:b]) in theirs for a, b in own)
                        assert kept >= len(own) - bound, (word, other, longest)


def test_checksums_and_runs():
    texts = ["Das Mädchen×läuft  don't", "", "ÀÿA", "x" * 300, "漢字abcdef_ghi"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    start, end, text = sv.letter_runs(data, bounds)
    found = [(t, data[a:b].tobytes().decode()) for a, b, t in zip(start, end, text)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in re.findall("[A-Za-zÀ-ÿ]+", t)]
    prefix = np.array([zlib.crc32(b"%d:" % i) for i in range(len(texts))], dtype=np.uint32)
    own = np.array([zlib.crc32(w.encode()) for _, w in found], dtype=np.uint32)
    assert sv.checksums(prefix, text, end - start, own).tolist() == [zlib.crc32(f"{i}:{w}".encode()) for i, w in found]


def test_tables(spark, rows):
    rnd = random.Random(7)
    words = sorted(variants(rnd, 60, "abcdeé"))
    texts = [(rnd.randrange(40), " ".join(rnd.choice(words[: rnd.choice((3, 10, 100))]) for _ in range(30))) for _ in range(150)]
    texts += [(None, "several several Several sevéral"), (1, None), (2, ""), (3, "several " * 9), (3, "several " * 9), (4, "z" * 20_000 + " ")] * 5
    texts += [(5, "Formen " * 130 + "Former " * 26 + "Fermer " * 5)]
    found = sv.grouped(documents(spark, texts, {"word": "r", "n": 1}))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(found) == sorted(plain(texts), key=repr)
    assert any(r[1] and r[2] != r[1] for r in plain(texts))
    assert sv.grouped(documents(spark, [])).count() == 0


def test_query(spark, rows):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op13_spelling_variants(spark, "/root/testdata/sf0.01")) == sorted(plain(table), key=repr)
