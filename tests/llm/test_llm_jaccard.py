import random

import pytest
from brute import components, documents

from grouptrace.llm import jaccard_join
from grouptrace.llm.components import components as reachable


def corpus(seed, groups=6, members=12, size=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(25)]
    out, d = [], 0
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(8, size))] + passage
        for _ in range(r.randrange(1, members)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = word()
            out.append((d, " ".join(w)))
            d += 1
    out += [(d, None), (d + 1, ""), (d + 2, " \n"), (d + 3, "A b"), (d + 4, "a B"), (d + 5, "a b c"), (d + 6, out[0][1].upper())]
    r.shuffle(out)
    return out


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_agree_with_brute_force(spark, seed):
    texts = corpus(seed)
    clashes = {"vertex": 1, "n": 2, "key": "k", "root": 3, "place": 4}
    assert got(jaccard_join.joined(documents(spark, texts, clashes))) == components(texts)


def test_groups_larger_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    texts = corpus(7, groups=2, members=30)
    assert got(jaccard_join.joined(documents(spark, texts))) == components(texts)


def test_other_thresholds_of_the_method(spark):
    texts = corpus(9, groups=4)
    assert got(jaccard_join.joined(documents(spark, texts), 60)) == components(texts, 60)


def test_a_link_at_the_threshold(spark):
    base = [f"w{i}" for i in range(14)]  # ten shingles; eight and ten of them make 8 / 10
    texts = [(1, " ".join(base)), (2, " ".join(base[:12])), (3, " ".join(base[:11]))]
    assert got(jaccard_join.joined(documents(spark, texts))) == components(texts) == {1: (10, 1), 2: (8, 1), 3: (7, 1)}


def test_many_copies_and_repeated_rows(spark):
    texts = [(d, "one two three four five six") for d in range(300)] + [(0, "one two three four five six")]
    rows = jaccard_join.joined(documents(spark, texts)).collect()
    assert len(rows) == 301 and {(r.n_shingles, r.component_id) for r in rows} == {(2, 0)}


def test_empty_table_and_null_ids(spark):
    assert jaccard_join.joined(documents(spark, [])).collect() == []
    rows = jaccard_join.joined(documents(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, None)])).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in rows))) == sorted(
        map(str, [(None, 2, 4), (4, 2, 4), (None, 0, None)]))


def test_rows_without_id_link_like_others(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["x"] + base[31:]
    texts = [(1, " ".join(base)), (None, " ".join(near)), (None, "q r s t u v w"), (None, "q r s t u v w")]
    found = sorted(str((r.doc_id, r.component_id)) for r in jaccard_join.joined(documents(spark, texts), 80).collect())
    assert found == sorted(map(str, [(1, 1), (None, 1), (None, None), (None, None)]))


def test_a_row_without_id_is_a_bridge(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; neighbours share 88, the outer ones 76
    texts = [(2, " ".join(words)), (None, " ".join(words[12:] + [f"x{i}" for i in range(12)])),
             (1, " ".join(words[24:] + [f"x{i}" for i in range(12)] + [f"y{i}" for i in range(12)]))]
    linked = components([(i, t) for i, (_, t) in enumerate(texts)], 75)
    apart = components([t for t in texts if t[0]], 75)
    assert {c for _, c in linked.values()} == {0} and apart[1][1] == 1 and apart[2][1] == 2
    assert {r.component_id for r in jaccard_join.joined(documents(spark, texts), 75).collect()} == {1}


def test_rows_of_one_document_are_linked(spark):
    texts = [(5, "a b c d e f"), (5, "p q r s t u"), (3, "a b c d e f"), (7, "p q r s t u"), (5, None), (9, "k l m n o p")]
    rows = jaccard_join.joined(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [
        (3, 2, 3), (5, 0, 5), (5, 2, 3), (5, 2, 3), (7, 2, 3), (9, 2, 9)]


def test_fragments_are_not_moved_by_joins(spark):
    order = jaccard_join.Order(__import__("numpy").ones(1 << 20))
    table = documents(spark, [(i, " ".join(f"w{i}" for i in range(i, i + 20))) for i in range(6)])
    rows = jaccard_join.described(table).where("slice IS NULL").select("vertex", "row_key")
    parts = jaccard_join.fragments(table, rows, rows.select("vertex"), order)
    assert parts.count() == 6 and parts.columns == ["vertex", "keys0", "keys1", "keys2", "keys3"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = spark.range(3).selectExpr("id as a", "id as b", "id as na", "id as nb")
        text = jaccard_join._partial(pairs, parts, [0])._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 2  # the pairs by either side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_chains_are_one_component(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    rows = reachable(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.vertex: r.root for r in rows} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
