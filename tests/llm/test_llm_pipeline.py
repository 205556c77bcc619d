"""The pipeline and the registered queries on the smallest tables."""

import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import components, removed

import corpus_pipeline
from benchset.check import compare, connect
from grouptrace.llm import byte_bpe, toxicity
from grouptrace.llm.queries import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    good, message = compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLE[name])
    assert good, message


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_byte_bpe_query(spark, texts):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in texts:
        ids = np.array(own.encode_ordinary(t or ""), dtype="<u4")
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op1_byte_bpe"](spark, SF_DIR).collect()} == want


def test_substring_query(spark, texts):
    want = {d: (n, cut, hashlib.sha256(kept).hexdigest()) for d, (n, cut, kept) in removed(texts, 13).items()}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_substring_dedup"](spark, SF_DIR).collect()} == want


def test_suffix_query(spark, texts):
    want = {d: (n, cut) for d, (n, cut, _) in removed(texts, 50).items()}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in QUERIES["op4_suffix_dedup"](spark, SF_DIR).collect()} == want


def test_jaccard_query(spark, texts):
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_jaccard_join"](spark, SF_DIR).collect()} == components(texts)


def test_toxicity_query(spark, texts):
    rows = QUERIES["op10_toxicity"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in texts]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD) for r in rows)


def contaminated(texts, n=10):
    grams = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall():
        w = (t or "").split()
        grams.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return {d for d, t in texts if any(tuple(t.split()[i:i + n]) in grams for i in range(len(t.split()) - n + 1))}


def test_decontamination_query(spark, texts):
    assert {r.doc_id for r in QUERIES["op2_decontamination"](spark, SF_DIR).collect()} == contaminated(texts)


def test_stages_follow_each_other(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, now = docs.columns, {d: t or "" for d, t in texts}
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), name)
        results.append({r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic, copies, passages, clean, tokens = results
    scored = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, SF_DIR).collect()}
    assert set(toxic) == {d for d in now if not scored[d]}
    now = {d: now[d] for d in toxic}
    linked = components(list(now.items()))
    assert set(copies) == {d for d in now if linked[d][1] == d}
    now = {d: now[d] for d in copies}
    cut = removed(list(now.items()), 50)
    assert {d: b" ".join(r.text.encode().split()) for d, r in passages.items()} == {
        d: kept for d, (n, gone, kept) in cut.items() if not n or gone < n}
    assert all(r.n_chars == (len(r.text) if cut[d][1] else copies[d].n_chars) for d, r in passages.items())
    now = {d: r.text for d, r in passages.items()}
    assert set(clean) == set(now) - contaminated(list(now.items()))
    assert {d: r.decoded_sha256 for d, r in tokens.items()} == {
        d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in clean.items()}


def test_run_returns_the_last_stage(spark, tmp_path):
    few = spark.createDataFrame(
        [(1, "the same text in five words or more", "en", "s", 3, "x"), (2, "The same text in five words or more", "en", "s", 3, "y"),
         (3, None, "en", None, None, None), (None, "no id", None, None, None, None), (4, "", "en", "s", 0, "z"),
         (1, "the same text in five words or more", "en", "s", 3, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, key string")
    few.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == [(1, 8), (3, 0), (4, 0), (None, 2)]


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
