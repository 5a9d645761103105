"""The stages of the pipeline, one by one, against plain versions of what they promise."""

import os
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from ambry.llm import secrets
from ambry.llm.decontamination import budget, normalised
from ambry.llm.tokens import WordEncoder, vocabulary
from ambry.session import scratch_path
from tests.llm.test_decontamination import nearest
from tests.llm.test_minhash import by_hand

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, held[-1], SF_DIR).write.parquet(path)
        held.append(spark.read.parquet(path))
    return held


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    for frame in stages[1:-1]:
        assert frame.dtypes == stages[0].dtypes


def test_language_stage_keeps_texts_with_letters(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {r.doc_id for r in stages[0].collect() if any(c.isalpha() for c in r.text or "")}


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = by_hand(rows, 5, Fraction(4, 5))
    assert {r.doc_id for r in stages[2].collect()} == {d for d, (_, root) in want.items() if root == d}


def test_decontamination_stage(spark, stages):
    items = [normalised(r.text)[0] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in stages[3].collect()}
    flat = [i.tobytes() for i in items]
    for text in kept.values():
        codes = normalised(text)[0].tobytes()
        assert not any(i in codes for i in flat)
    for r in stages[2].collect():
        if r.doc_id not in kept:
            codes = normalised(r.text)[0].tolist()
            assert any(nearest(i.tolist(), codes) <= budget(i.size) for i in items if set(i.tolist()) <= set(codes))


def test_secret_stage(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for doc_id, text in before.items():
        row = after[doc_id]
        assert row.n_chars == len(row.text) and not secrets.base_spans(row.text)
        assert (row.text == text) or secrets.base_spans(text)


def test_packing_stage(spark, stages):
    encode = WordEncoder(vocabulary()).tokenizer.encode
    want = {r.doc_id: len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    rows = sorted(stages[5].collect(), key=lambda r: (r.sequence_id, r.offset))
    held, at = {}, {}
    for r in rows:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert held == want and max(at.values()) <= 2048
    assert len(at) <= np.ceil(1.03 * sum(want.values()) / 2048) + 1


def test_run_gives_the_rows_of_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))


def test_odd_rows_pass_through_all_stages(spark, odd, none):
    for docs in (odd, none):
        empty = docs is none
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, SF_DIR)
            if name != "best_fit_packing":
                assert docs.columns == before.columns
        assert (docs.count() == 0) == empty
