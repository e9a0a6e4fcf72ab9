"""Lattice likelihood against the enumeration of all segmentations."""

from __future__ import annotations

import math
import struct
from functools import cache

import numpy as np

from glyphmine.llm import lm_scoring, vocabulary

from . import cases


def toy():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"\xe2\x96\x81a"]
    draw = np.random.default_rng(3)
    p = np.log(draw.dirichlet(np.ones(len(pieces) + 256)))
    return pieces, lm_scoring.Trie(pieces), p[: len(pieces)], p[len(pieces) :]


def segmentations(word: bytes, pieces: list[bytes]):
    if not word:
        yield ()
        return
    for tail in segmentations(word[1:], pieces):
        yield (word[0], *tail)
    for piece in pieces:
        if word.startswith(piece):
            for tail in segmentations(word[len(piece) :], pieces):
                yield (piece, *tail)


def test_forward_sums_all_segmentations():
    pieces, trie, p, byte_p = toy()
    words = [b"", b"a", b"abab", b"ababa", b"xyz", b"\xe2\x96\x81aba"]
    score = lambda s: sum(byte_p[x] if isinstance(x, int) else p[pieces.index(x)] for x in s)
    want = [math.log(sum(math.exp(score(s)) for s in segmentations(w, pieces))) for w in words]
    got = lm_scoring.word_scores(trie, trie.spread(p)[None], byte_p[None], words)[0]
    np.testing.assert_allclose(got, want, atol=1e-9)


def model_file(path, pieces: list[tuple[str, float, int]], kind: int) -> str:
    """A model of given pieces (piece, score, type), none of it trained."""

    def field(number: int, value: int | float | bytes) -> bytes:
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        if isinstance(value, int):
            return bytes([number << 3, value])
        return bytes([number << 3 | 2, len(value)]) + value

    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    path.write_bytes(body + field(2, field(3, kind)) + field(3, field(1, b"identity")))
    return str(path)


def test_unigram_scores_are_log_probabilities(spark, tmp_path):
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.5, 1), ("a", -2.5, 1), ("b", -3.0, 1), ("ab", -2.0, 1), ("▁", -3.5, 1)]
    path = model_file(tmp_path / "unigram.model", pieces, 1)
    _, p, byte_p = lm_scoring.load(path)
    np.testing.assert_allclose(p, [s for _, s, _ in pieces[1:]])
    assert (byte_p == -13.5).all()
    (row,) = lm_scoring.score(cases.table(spark, [(1, "ab", None, None, None)]), path=path).collect()
    spelt = math.exp(-1.5 - 3.0) + math.exp(-3.5 - 2.0) + math.exp(-3.5 - 2.5 - 3.0)
    assert abs(row.log_prob - math.log(spelt)) < 1e-4
    ranked = model_file(tmp_path / "merges.model", [(x, float(-k), t) for k, (x, _, t) in enumerate(pieces)], 2)
    assert abs(np.exp(np.concatenate(lm_scoring.load(ranked)[1:])).sum() - 1) < 1e-9
    assert not lm_scoring.is_unigram(lm_scoring.sentencepiece.SentencePieceProcessor(model_file=vocabulary.PIECES))


def test_expected_counts():
    pieces, trie, p, byte_p = toy()
    words, counts = [b"ababa", b"ba", b"xa"], np.array([3.0, 1.0, 2.0])
    by_node, by_byte = lm_scoring.expected_pieces(trie, trie.spread(p), byte_p, words, counts)
    want, want_bytes = np.zeros(len(pieces)), np.zeros(256)
    for w, n in zip(words, counts, strict=True):
        each = [(s, math.exp(sum(byte_p[x] if isinstance(x, int) else p[pieces.index(x)] for x in s))) for s in segmentations(w, pieces)]
        z = sum(x for _, x in each)
        for s, x in each:
            for part in s:
                if isinstance(part, int):
                    want_bytes[part] += n * x / z
                else:
                    want[pieces.index(part)] += n * x / z
    np.testing.assert_allclose(by_node[trie.piece_node], want, atol=1e-9)
    np.testing.assert_allclose(by_byte, want_bytes, atol=1e-9)


def brute_scores(path: str):
    """log probability of a word by a memoised recursion of its own over the vocabulary's pieces."""
    trie, p, byte_p = lm_scoring.load(path)
    of = dict(zip(trie.piece_node.tolist(), p.tolist(), strict=True))

    def word(w: bytes) -> float:
        @cache
        def tail(at: int) -> float:
            if at == len(w):
                return 0.0
            parts, node = [byte_p[w[at]] + tail(at + 1)], 1
            for end in range(at, len(w)):
                node = int(trie.step[trie.row[node], w[end]])
                if not node:
                    break
                if node in of:
                    parts.append(of[node] + tail(end + 1))
            top = max(parts)
            return top + math.log(sum(math.exp(x - top) for x in parts))

        return tail(0)

    return word


def test_documents(spark):
    docs = cases.documents(spark).filter("length(text) < 3000")
    word = cache(brute_scores(vocabulary.PIECES))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = lm_scoring.score(docs).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        words = texts[r.doc_id].split()
        want = sum(word(("▁" + w).encode()) for w in words)
        assert r.n_words == len(words) and math.isclose(r.log_prob, want, rel_tol=1e-9, abs_tol=1e-9)
        assert r.n_bytes == len(texts[r.doc_id].encode())
    assert sum(r.corpus_log_prob for r in rows) > sum(r.log_prob for r in rows)


def test_probabilities_sum_to_one():
    _, p, byte_p = lm_scoring.load(vocabulary.PIECES)
    assert math.isclose(np.exp(p).sum() + np.exp(byte_p).sum(), 1.0)


def test_word_table_holds_every_word(spark):
    docs = cases.awkward(spark)
    found = {r.word: r.n for r in lm_scoring.word_table(docs).collect()}
    want: dict[str, int] = {}
    for _, t, *_ in cases.ROWS:
        for w in (t or "").split():
            want[w] = want.get(w, 0) + 1
    assert found == want


def test_awkward_rows(spark):
    rows = lm_scoring.score(cases.awkward(spark)).collect()
    assert len(rows) == len(cases.ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].log_prob, by[1].corpus_log_prob, by[1].bits_per_byte, by[1].n_words) == (None, None, None, 0)
    assert (by[2].log_prob, by[2].bits_per_byte) == (0.0, None)
    assert by[3].log_prob == 0.0 and by[6].n_words == 120_000 and by[6].log_prob < 0
    assert by[4].log_prob == by[5].log_prob


def test_a_very_long_word(spark):
    (row,) = lm_scoring.score(cases.table(spark, [(1, "x" * 5000)], "doc_id long, text string")).collect()
    assert math.isfinite(row.log_prob) and row.n_words == 1


def test_empty_table(spark):
    assert lm_scoring.score(cases.empty(spark)).count() == 0
