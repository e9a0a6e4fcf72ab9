"""The conditional random field: exact inference, held-out accuracy, code-switched text."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmine.llm import langid

from . import cases


def test_forward_backward_is_exact():
    draw = np.random.default_rng(1)
    scores, step, start = draw.normal(size=(7, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    offsets = np.array([0, 4, 4, 7])
    gamma, trans, starts, log_z = langid.forward_backward(scores, offsets, step, start, pairs=True)
    want, want_trans, want_starts, want_z = np.zeros((7, 3)), np.zeros((3, 3)), np.zeros(3), 0.0
    for a, b in ((0, 4), (4, 7)):
        weights = {p: np.exp(start[p[0]] + sum(scores[a + t, p[t]] for t in range(b - a)) + sum(step[p[t], p[t + 1]] for t in range(b - a - 1))) for p in itertools.product(range(3), repeat=b - a)}
        z = sum(weights.values())
        want_z += np.log(z)
        for p, w in weights.items():
            want_starts[p[0]] += w / z
            for t, label in enumerate(p):
                want[a + t, label] += w / z
                if t:
                    want_trans[p[t - 1], label] += w / z
    np.testing.assert_allclose(gamma, want, atol=1e-9)
    np.testing.assert_allclose(trans, want_trans, atol=1e-9)
    np.testing.assert_allclose(starts, want_starts, atol=1e-9)
    assert abs(log_z - want_z) < 1e-6


def test_held_out_accuracy(spark):
    docs = cases.documents(spark, "0.01")
    found = langid.identify(docs, per_language=60).filter("n_words >= 5")
    joined = found.join(docs.select("doc_id", "lang"), "doc_id")
    right = joined.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97


def test_code_switches_are_labelled_word_by_word(spark):
    docs = cases.documents(spark, "0.01").filter("n_chars > 400")
    model = langid.train(docs)
    by = {r.lang: r.text.split()[:12] for r in docs.dropDuplicates(["lang"]).collect()}
    a, b, *_ = sorted(by)
    line = " ".join([*by[a], *by[b]])
    language, share, n_words, n_switches, accepted = (c[0].as_py() for c in langid.label_rows(model, pa.array([line]), 0.1))
    assert n_switches >= 1 and accepted and 0.3 < share < 0.8


def test_spans_tell_where_each_language_stands(spark):
    docs = cases.documents(spark, "0.01").filter("n_chars > 400")
    by = {r.lang: r.text.split()[:12] for r in docs.dropDuplicates(["lang"]).collect()}
    a, b, *_ = sorted(by)
    mixed = cases.table(spark, [(1, " ".join([*by[a], *by[b]]), None, None, None), (2, " ".join(by[a][:6]) + "\n" + " ".join(by[a][6:]), None, None, None), (3, "!!", None, None, None)])
    rows = langid.identify(docs.select("doc_id", "text", "lang").union(mixed.select(-mixed.doc_id, "text", "lang"))).filter("doc_id < 0").collect()
    spans = {-r.doc_id: [(s.language, s.first, s.n) for s in r.spans] for r in rows}
    assert spans[3] == []
    for r in rows:
        at = [s.first for s in r.spans]
        assert at == [sum(s.n for s in r.spans[:k]) for k in range(len(at))] and sum(s.n for s in r.spans) == r.n_words
    words = {k: [x for x, _, n in found for _ in range(n)] for k, found in spans.items()}
    assert words[2].count(a) >= 0.8 * len(words[2])
    half = len(words[1]) // 2
    assert words[1][:half].count(a) >= 0.7 * half and words[1][half:].count(b) >= 0.7 * half


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == len(cases.ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for k in (1, 2, 3, 8):
        assert (by[k].language, by[k].share, by[k].n_words, by[k].accepted) == (None, None, 0, False)
    assert by[4].language == by[6].language == "en" and by[4].accepted and by[6].n_words == 120_000
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 4, 5, 5, 6, 7, 9]


def test_unknown_languages_are_rejected_however_few_are_known(spark):
    unknown = [
        "Это обычное русское предложение о погоде и о том что люди делают каждый день в городе",
        "Bu şehirde insanların her gün yaptıkları şeyler ve hava hakkında sıradan bir Türkçe cümledir",
        "Ez egy teljesen hétköznapi magyar mondat az időjárásról és az emberek mindennapjairól",
        "aGVsbG8gd29ybGQg dGhpcyBpcyBiYXNl NjQgZW5jb2RlZCB0 ZXh0IHdpdGggbm8g bGFuZ3VhZ2UgYXQg YWxs",
    ]
    docs = cases.documents(spark, "0.01").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(-1 - k, x, None) for k, x in enumerate(unknown)], "doc_id long, text string, lang string")
    for known in (["en"], ["de", "en"], ["de", "en", "es", "fr"]):
        mine = docs.filter(F.col("lang").isin(known))
        refused = langid.identify(mine.union(foreign)).filter("not accepted and n_words > 0").collect()
        assert {r.doc_id for r in refused} == {-1, -2, -3, -4}


def test_without_labels_everything_with_letters_is_accepted(spark):
    docs = cases.awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    rows = langid.identify(docs).collect()
    assert {r.language for r in rows} == {None}
    assert all(r.accepted == (r.n_words > 0) for r in rows)


def test_empty_table(spark):
    assert langid.identify(cases.empty(spark)).count() == 0
    assert langid.keep_identified(cases.empty(spark)).count() == 0
