"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from glyphmine.llm import common, langid, packing, vocabulary

from ..compare import SF
from . import cases
from .test_decontaminate import brute as leaks
from .test_ngram_join import brute as similar
from .test_packing import check


@pytest.fixture(scope="module")
def kept(spark):
    """The input of each stage of run() and its result."""
    out, stages = [], corpus_pipeline.STAGES

    def watched(stage):
        def call(spark_, docs, sf_dir):
            out.append(docs)
            return stage(spark_, docs, sf_dir)

        return call

    corpus_pipeline.STAGES = [(name, watched(stage)) for name, stage in stages]
    try:
        last = corpus_pipeline.run(spark, SF)
    finally:
        corpus_pipeline.STAGES = stages
    return [*out, last]


def ids(df) -> set:
    return {r.doc_id for r in df.select("doc_id").collect()}


def texts(df) -> dict:
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_are_named_and_columns_stay(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    for df in kept[1:-1]:
        assert df.schema.names == kept[0].schema.names


def test_language(kept):
    verdict = {r.doc_id: r.accepted for r in langid.identify(kept[0]).collect()}
    assert ids(kept[1]) == {i for i, ok in verdict.items() if ok}


def test_copies(kept):
    least = {}
    for i, t in texts(kept[1]).items():
        least[t] = min(i, least.get(t, i))
    assert ids(kept[2]) == set(least.values())


def test_near_copies(kept):
    body = texts(kept[2])
    root = {i: i for i in body}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in similar(list(body.items())):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert ids(kept[3]) == {i for i in body if find(i) == i}


def test_leaks(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    body = texts(kept[3])
    assert ids(kept[4]) == body.keys() - {i for i, _ in leaks(list(body.items()), items)}


def test_packing(kept):
    bpe = vocabulary.byte_bpe()
    check(Counter((i, len(bpe.encode_ordinary(t))) for i, t in texts(kept[4]).items()), kept[5].collect(), packing.CAPACITY)


def test_awkward_rows_pass_every_stage(spark):
    docs = cases.awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.columns == cases.awkward(spark).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect()) == [4, 6, 7, 9]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {4, 6, 7, 9}


def test_empty_table_passes_every_stage(spark):
    docs = cases.empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0
