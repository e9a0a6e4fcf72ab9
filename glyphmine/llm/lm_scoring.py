"""Marginal document probability under a subword lattice.

A word (a run of non-white-space, with the vocabulary's space mark before it) is the sum over all its segmentations of the product of the pieces'
probabilities, by forward recursion in log space over a byte trie of the vocabulary; a document's log probability is
the sum over its words. The vocabulary is a public one and is not trained. A unigram model's stored scores are log probabilities and taken as
they are; a byte counts as a piece UNKNOWN below the least one, as its encoder scores the unknown. A merge model stores merge ranks, which are read as
log probabilities by Zipf's law, p ~ 1 / (rank + ZIPF), bytes last. So every text has a positive probability.

All documents' words are counted into a table of distinct words, and each is scored once, forward and backward, which gives
the expected count of every piece over the whole corpus. corpus_log_prob uses piece probabilities
re-estimated from those counts, shrunk to the vocabulary's by PRIOR counts. The word table grows with the corpus and
is only ever shuffled; the driver sees one number for each piece. In the final pass over the documents each task scores the distinct
words of its own rows, so no (document, word) pair is shuffled.

Defined results: a null text has null log_prob and no words; an empty text has probability 1; rows with null id and repeated rows
are scored like others, and repeated rows count as often as they occur; columns other than id and text are ignored whatever their names. Ids must be whole numbers; other text raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text, vocabulary

ZIPF, PRIOR, UNKNOWN = 2.7, 1000.0, 10.0
_AT_ONCE = 4096


class Trie:
    """Byte trie of a vocabulary as a dense table of its inner nodes; node 0 is dead, node 1 the root."""

    def __init__(self, pieces: list[bytes]):
        nodes: list[dict[int, int]] = [{}, {}]
        self.piece_node = np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            at = 1
            for b in piece:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                at = nodes[at][b]
            self.piece_node[k] = at
        inner = [k for k, n in enumerate(nodes) if n]
        self.row = np.zeros(len(nodes), np.int64)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.step = np.zeros((len(inner) + 1, 256), np.int32)
        for k in inner:
            for b, to in nodes[k].items():
                self.step[self.row[k], b] = to
        self.size = len(nodes)

    def spread(self, scores: np.ndarray) -> np.ndarray:
        """Scores by node from scores by piece; nodes that end no piece have -inf."""
        out = np.full((*scores.shape[:-1], self.size), -np.inf)
        out[..., self.piece_node] = scores
        return out


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def is_unigram(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether the model's scores are log probabilities: the kind in its training record, which stands for unigram where it is left out."""
    return dict(_fields(dict(_fields(model.serialized_model_proto())).get(2, b""))).get(3, 1) == 1


@cache
def load(path: str, zipf: float = ZIPF) -> tuple[Trie, np.ndarray, np.ndarray]:
    """(trie, log probability of each piece, of a byte): pieces that are neither control, unknown nor white space alone."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept, scores = [], []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k) or not piece.strip("▁") and piece != "▁" or model.get_score(k) < -1e8:
            continue
        kept.append(piece.encode())
        scores.append(model.get_score(k))
    if is_unigram(model):
        return Trie(kept), np.array(scores), np.full(256, min(scores) - UNKNOWN)
    ranks = [1 - x for x in scores]
    weight = 1 / (np.array([*ranks, *(max(ranks) + 1 + np.arange(256))]) + zipf)
    p = np.log(weight / weight.sum())
    return Trie(kept), p[: len(kept)], p[len(kept) :]


def _bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    table = np.zeros((len(words), int(lengths.max(initial=0))), np.uint8)
    table[np.arange(table.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return table, lengths


def _arcs(trie: Trie, table: np.ndarray, lengths: np.ndarray, begin: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, end, nodes) of the trie paths that start at begin, one length after the other."""
    rows = np.flatnonzero(lengths > begin)
    node = np.ones(len(rows), np.int64)
    for at in range(begin, table.shape[1]):
        node = trie.step[trie.row[node], table[rows, at]]
        alive = (node > 0) & (lengths[rows] > at)
        rows, node = rows[alive], node[alive].astype(np.int64)
        if not len(rows):
            return
        yield rows, at + 1, node


def forward(trie: Trie, scores: np.ndarray, byte_scores: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log sums of all segmentations of each prefix: (score sets, words, length + 1)."""
    sets, n = len(scores), len(table)
    alpha = np.full((sets, n, table.shape[1] + 1), -np.inf)
    alpha[:, :, 0] = 0
    for i in range(table.shape[1]):
        here = np.flatnonzero(lengths > i)
        alpha[:, here, i + 1] = np.logaddexp(alpha[:, here, i + 1], alpha[:, here, i] + byte_scores[:, table[here, i]])
        for rows, end, node in _arcs(trie, table, lengths, i):
            s = scores[:, node]
            ends = np.flatnonzero(s[0] > -np.inf)
            if len(ends):
                rows, s = rows[ends], s[:, ends]
                alpha[:, rows, end] = np.logaddexp(alpha[:, rows, end], alpha[:, rows, i] + s)
    return alpha


def word_scores(trie: Trie, scores: np.ndarray, byte_scores: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log probabilities, (score sets, words)."""
    out = np.zeros((len(scores), len(words)))
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):
        some = order[at : at + max(1, min(_AT_ONCE, (1 << 19) // max(1, len(words[order[min(at + _AT_ONCE, len(order)) - 1]]))))]
        table, lengths = _bytes([words[k] for k in some])
        out[:, some] = forward(trie, scores, byte_scores, table, lengths)[:, np.arange(len(some)), lengths]
        at += len(some)
    return out


def expected_pieces(trie: Trie, scores: np.ndarray, byte_scores: np.ndarray, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior counts (by node, by byte) of all words, each weighed by its count."""
    by_node, by_byte = np.zeros(trie.size), np.zeros(256)
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):
        some = order[at : at + max(1, min(_AT_ONCE, (1 << 19) // max(1, len(words[order[min(at + _AT_ONCE, len(order)) - 1]]))))]
        table, lengths = _bytes([words[k] for k in some])
        alpha = forward(trie, scores[None], byte_scores[None], table, lengths)[0]
        total = alpha[np.arange(len(some)), lengths]
        n = counts[some]
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(len(some)), lengths] = 0
        for i in range(table.shape[1] - 1, -1, -1):
            here = np.flatnonzero(lengths > i)
            b = byte_scores[table[here, i]] + beta[here, i + 1]
            by_byte += np.bincount(table[here, i], n[here] * np.exp(alpha[here, i] + b - total[here]), 256)
            beta[here, i] = b
            for rows, end, node in _arcs(trie, table, lengths, i):
                s = scores[node]
                ends = np.flatnonzero(s > -np.inf)
                if len(ends):
                    rows, s, node = rows[ends], s[ends] + beta[rows[ends], end], node[ends]
                    np.add.at(by_node, node, n[rows] * np.exp(alpha[rows, i] + s - total[rows]))
                    beta[rows, i] = np.logaddexp(beta[rows, i], s)
        at += len(some)
    return by_node, by_byte


def _words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words as dictionary indices, where each row begins among the non-empty ones, which are non-empty)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(column, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return coded, np.concatenate([[0], np.cumsum(real)])[offsets], real


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pc.value_counts(pc.utf8_split_whitespace(batch[0]).flatten())
        keep = pc.not_equal(found.field("values"), "")
        yield pa.record_batch([found.field("values").filter(keep), found.field("counts").filter(keep)], names=["word", "n"])


def _expect(path: str, zipf: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, p, byte_p = load(path, zipf)
        scores = trie.spread(p)
        by_node, by_byte = np.zeros(trie.size), np.zeros(256)
        for batch in batches:
            words = [b"\xe2\x96\x81" + w.encode() for w in batch[0].to_pylist()]
            some = expected_pieces(trie, scores, byte_p, words, batch[1].to_numpy().astype(float))
            by_node += some[0]
            by_byte += some[1]
        counts = np.concatenate([by_node[trie.piece_node], by_byte])
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts[at])], names=["piece", "n"])

    return run


def word_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): every distinct word of the corpus and how often it occurs, as a table in the shared folder."""
    source = common.tuned(docs).select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return common.materialize(source.mapInArrow(common.lean(_count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def corpus_scores(words: DataFrame, path: str, zipf: float = ZIPF, prior: float = PRIOR) -> np.ndarray:
    """Log probabilities of pieces, then bytes, from their expected counts over the corpus."""
    _, p, byte_p = load(path, zipf)
    base = np.exp(np.concatenate([p, byte_p]))
    counts = np.zeros(len(base))
    for r in words.mapInArrow(common.lean(_expect(path, zipf)), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[r["piece"]] = r["n"]
    return np.log((counts + prior * base) / (counts.sum() + prior))


_SCORED = "doc_id long, n_words long, n_bytes long, log_prob double, corpus_log_prob double, bits_per_byte double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = vocabulary.PIECES, zipf: float = ZIPF, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_words, n_bytes, log_prob, corpus_log_prob, bits_per_byte) of every row; natural logarithms, bits_per_byte from log_prob."""
    held = docs.sparkSession.sparkContext.broadcast(corpus_scores(word_table(docs, text_col), path, zipf, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, p, byte_p = load(path, zipf)
        corpus = held.value
        scores, byte_scores = trie.spread(np.stack([p, corpus[: len(p)]])), np.stack([byte_p, corpus[len(p) :]])
        for batch in text.slices(batches, 4000):
            coded, offsets, real = _words(batch[1])
            words = [b"\xe2\x96\x81" + w.encode() for w in coded.dictionary.to_pylist()]
            each = word_scores(trie, scores, byte_scores, words)
            ids = coded.indices.to_numpy(zero_copy_only=False)[real]
            n_bytes = pc.binary_length(pc.fill_null(batch[1], "")).to_numpy(zero_copy_only=False)
            total = np.concatenate([np.zeros((2, 1)), np.cumsum(each[:, ids], axis=1)], axis=1)
            sums = total[:, offsets[1:]] - total[:, offsets[:-1]]
            missing = batch[1].is_null().to_numpy(zero_copy_only=False)
            none = missing | (n_bytes == 0)
            bits = -sums[0] / np.log(2) / np.maximum(n_bytes, 1)
            yield pa.record_batch(
                [batch[0], pa.array(np.diff(offsets)), pa.array(n_bytes.astype(np.int64)), pa.array(sums[0], mask=missing), pa.array(sums[1], mask=missing), pa.array(bits, mask=none)],
                names=["doc_id", "n_words", "n_bytes", "log_prob", "corpus_log_prob", "bits_per_byte"],
            )

    source = common.tuned(docs).select(common.whole(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(common.lean(run), _SCORED)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
