import hashlib
import random

import pytest
from brute import documents, removed

from grouptrace.llm import substring_dedup, suffix_dedup

CLASHES = {"key": "k", "keys": 1, "row": "r", "packed": "p", "end": 2, "n_words": 3, "kept": "x"}


def corpus(seed, n=60, vocabulary=40, passage=30):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    shared = [[word() for _ in range(passage)] for _ in range(4)]
    out = []
    for d in range(n):
        w = [word() for _ in range(r.randrange(0, 60))]
        if r.random() < 0.6:
            at, p = r.randrange(len(w) + 1), r.choice(shared)
            w[at:at] = p[r.randrange(3):len(p) - r.randrange(3)]
        out.append((d * 3, "  " + " \n".join(w) + " "))
    out += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, out[5][1]), (1004, out[5][1]), (1005, "a " * 300)]
    out += [(1006, " ".join(f"w{i % 7}" for i in range(5000))), (1007, " ".join(f"w{i % 7}" for i in range(40)))]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_parse_removes_what_a_smaller_document_has(spark, seed):
    texts = corpus(seed)
    got = {r["row"]["doc_id"]: r for r in substring_dedup.parsed(documents(spark, texts, CLASHES)).collect()}
    want = removed(texts, 13)
    assert len(got) == len(texts)
    for d, (n, cut, kept) in want.items():
        assert (got[d].n_words, got[d].n_removed, bytes(got[d].kept)) == (n, cut, kept)
        assert sum(f["words"] for f in got[d].factors) == cut
        assert got[d]["row"]["keys"] == 1 and got[d]["row"]["packed"] == "p"


def test_windows_are_found_in_every_length_and_spread(spark):
    texts = corpus(3, n=40, vocabulary=6)
    for length, spread in ((4, 2), (9, 5), (20, 10)):
        got = substring_dedup.parsed(documents(spark, texts), length, spread).collect()
        want = removed(texts, length)
        assert all((r.n_words, r.n_removed, bytes(r.kept)) == want[r["row"]["doc_id"]] for r in got)


def test_repeated_passages_are_cut_from_the_later_document(spark):
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(55))
    own = lambda d: " ".join(f"d{d}x{r.randrange(1000)}" for _ in range(80))
    texts = [(d, f"{own(d)}\n\n{passage}\n\n{own(d)}\n") for d in (7, 3, 9)] + [(1, own(1)), (2, None), (4, "")]
    got = {x["row"]["doc_id"]: x for x in suffix_dedup.without_repeats(documents(spark, texts, CLASHES)).collect()}
    whole = dict(texts)
    for d in (1, 2, 3, 4):
        assert got[d].kept_text == whole[d] and got[d].n_removed == 0 and got[d].spans == []
    for d in (7, 9):
        assert got[d].kept_text == whole[d].replace(passage + "\n\n", "")
        assert [(s["first"], s["words"]) for s in got[d].spans] == [(80, 55)]


def test_shorter_repeats_stay(spark):
    passage = " ".join(f"p{i}" for i in range(49))
    texts = [(1, f"a {passage} b"), (2, f"c {passage} d")]
    assert {r.n_removed for r in suffix_dedup.without_repeats(documents(spark, texts)).collect()} == {0}


def test_counts_agree_with_brute_force(spark):
    texts = corpus(11, n=50, passage=60)
    got = suffix_dedup.without_repeats(documents(spark, texts)).collect()
    want = removed(texts, 50)
    assert all((r.n_words, r.n_removed) == want[r["row"]["doc_id"]][:2] for r in got)
    assert all(b" ".join((r.kept_text or "").encode().split()) == want[r["row"]["doc_id"]][2] for r in got)


def test_hot_passage_over_many_partitions(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [(d, f"{passage} d{d}") for d in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = substring_dedup.parsed(documents(spark, texts).repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r["row"]["doc_id"], r.n_removed) for r in got) == [(d, 20 if d else 0) for d in range(400)]


def test_repeated_rows_and_null_ids_keep_their_words(spark):
    text = " ".join(f"p{i}" for i in range(60))
    texts = [(5, text), (5, text), (None, text), (None, None)]
    for r in substring_dedup.parsed(documents(spark, texts)).collect():
        assert r.n_removed == 0
    assert {r.n_removed for r in suffix_dedup.without_repeats(documents(spark, texts)).collect()} == {0}


def test_empty_table(spark):
    empty = documents(spark, [])
    assert substring_dedup.parsed(empty).collect() == []
    assert suffix_dedup.without_repeats(empty).collect() == []
    assert hashlib.sha256(b"").hexdigest()
