"""Language identification with a linear-chain conditional random field over words.

Labels are the languages of the training rows. A word's features are hashed: whole word, prefixes and suffixes of 1 to 3
characters, character 2- and 3-grams with word ends, and for each language whether its lexicon (frequent
words of the training sample) holds the word. Transitions are learned, from whole lines and from lines spliced from
several languages. Forward-backward gives each word's label marginals, so code-switched text is labelled word by word;
a document takes the language with the largest mean marginal.

Marginals only weigh the known languages against each other, so text in no known language may still favour one. A document must
therefore also look like its labels: a word's likeness is the mean log frequency of its features in the training words of its
label, above that of a random feature, and the mean over the words must reach a share of the median that training documents
have when their own words are held out, or their least one where that is lower. This limit doesn't depend on the number
of labels; it is lower by 1 / sqrt(words), as one odd token weighs much in a short text.

The model is fitted on train_per_language rows of each language, those with the least hash of id: a documented bound, the
same at every size. Everything else covers all rows and whole texts.

Defined results: a null text, or one without letters, has n_words 0, null language and share, no spans, and is rejected; rows with null
id are labelled like others; rows with a null label are not trained on; without any labelled row nothing can be
labelled and every row with letters is accepted, with null language and spans; other columns pass through keep_identified untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, text

TRAIN_PER_LANGUAGE, LEXICON, BUCKETS, MIN_SHARE = 120, 200, 1 << 15, 0.35
LIKENESS, FOLDS = 0.175, 4


def _features(words: pa.Array, lexicons: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, where each word's features begin); features of a word are contiguous.

    lexicons: sorted word hashes of each language's lexicon, one row for each language, padded with 0.
    """
    listed = words.to_pylist()
    n = len(listed)
    joined = "\x02\x02\x02".join(["", *(f"\x01{w}\x01" for w in listed), ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == 1)
    starts, stops = ends[0::2], ends[1::2]
    owner = np.cumsum(codes == 2) // 3 - 1

    def hashed(seed: int, *parts: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.full(len(parts[0]), seed * 7919 + 1, np.uint64)
            for p in parts:
                total = (total + p) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
        return (total % np.uint64(buckets)).astype(np.int32)

    found, who = [], []
    inside = codes != 2
    for k in (2, 3):
        at = np.flatnonzero(np.logical_and.reduce([inside[j : len(codes) - k + 1 + j] for j in range(k)]))
        found.append(hashed(k, *(codes[at + j] for j in range(k))))
        who.append(owner[at])
    lengths = stops - starts - 1
    for k in (1, 2, 3):
        long = np.flatnonzero(lengths >= k)
        found += [hashed(10 + k, *(codes[starts[long] + 1 + j] for j in range(k))), hashed(20 + k, *(codes[stops[long] - 1 - j] for j in range(k)))]
        who += [long, long]
    whole = text.word_hashes(words)
    found.append(hashed(30, whole))
    who.append(np.arange(n))
    for label, lexicon in enumerate(lexicons):
        held = np.flatnonzero(np.isin(whole, lexicon))
        found.append(hashed(40 + label, np.zeros(len(held), np.uint64)))
        who.append(held)
    bucket, of = np.concatenate(found), np.concatenate(who)
    order = np.argsort(of, kind="stable")
    return bucket[order], np.searchsorted(of[order], np.arange(n))


@dataclass
class Crf:
    """Weights of a fitted model; start and step are in log space."""

    labels: list[str]
    lexicons: np.ndarray
    weight: np.ndarray
    step: np.ndarray
    start: np.ndarray
    typical: np.ndarray
    least: float = -np.inf

    def evidence(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log potentials of each dictionary word, and its likeness to each label."""
        if not len(words):
            none = np.zeros((0, len(self.labels)), np.float32)
            return none, none
        bucket, first = _features(words, self.lexicons, len(self.weight))
        return np.add.reduceat(self.weight[bucket], first, axis=0), _likeness(self.typical, bucket, first)

    def marginals(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Label marginals of each word of the sequences that offsets cut scores into, by forward-backward."""
        return forward_backward(scores, offsets, self.step, self.start)[0]


def _likeness(typical: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(typical[bucket], first, axis=0) / np.diff([*first, len(bucket)])[:, None].astype(typical.dtype)


def _typical(bucket: np.ndarray, of: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Log frequency of each feature among the words (n_words, n_labels) of each label, above that of a random feature."""
    n = np.stack([np.bincount(bucket, counts[of, k], buckets) for k in range(counts.shape[1])], axis=1) + 0.5
    return np.log(n / n.sum(axis=0) * buckets)


def forward_backward(scores: np.ndarray, offsets: np.ndarray, step: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(marginals, expected transitions, expected starts, log partition); all sequences advance together, each step rescaled."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin, length = offsets[:-1][order], lengths[order]
    n_labels = scores.shape[1]
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores
    e = np.exp(scores - top)
    move, first = np.exp(step).astype(e.dtype), np.exp(start).astype(e.dtype)
    alpha, scale = np.zeros_like(e), np.ones(len(e), e.dtype)
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")
    now = None
    for t in range(longest):
        k = active[t]
        at = begin[:k] + t
        now = (first if t == 0 else now[:k] @ move) * e[at]
        total = now.sum(axis=1)
        now = now / total[:, None]
        alpha[at], scale[at] = now, total
    gamma, trans = alpha.copy(), np.zeros((n_labels, n_labels))
    beta = None
    for t in range(longest - 1, 0, -1):
        k = active[t]
        at = begin[:k] + t
        later = np.ones((k, n_labels), e.dtype)
        if beta is not None:
            later[: len(beta)] = beta
        carried = later * e[at] / scale[at][:, None]
        if pairs:
            trans += (alpha[at - 1].T @ carried) * move
        beta = carried @ move.T
        gamma[at - 1] *= beta
    starts = gamma[begin].sum(axis=0) if len(begin) else np.zeros(n_labels)
    return gamma, trans, starts, float(np.log(scale).sum() + top.sum())


def fit(texts: list[str], languages: list[str], lexicon: int = LEXICON, buckets: int = BUCKETS, epochs: int = 12, rate: float = 0.3, decay: float = 1e-6) -> Crf:
    """Maximum likelihood by AdaGrad on whole batches; every third line gains a stretch of a line of another text, so switches are seen."""
    labels = sorted(set(languages))
    column = pa.array([x for x in texts], pa.string())
    ids, offsets, words = text.word_ids(column, letters_only=True)
    fold = np.repeat(np.arange(len(texts)) % FOLDS, np.diff(offsets))
    gold = np.repeat([labels.index(x) for x in languages], np.diff(offsets))
    whole = text.word_hashes(words)
    lexicons = np.zeros((len(labels), lexicon), np.uint64)
    counts = np.stack([np.bincount(ids[gold == k], minlength=len(words)) for k in range(len(labels))]).astype(float)
    held = [counts.T - np.stack([np.bincount(ids[(gold == k) & (fold == f)], minlength=len(words)) for k in range(len(labels))], axis=1) for f in range(FOLDS)]
    share = counts / np.maximum(counts.sum(axis=0), 1)
    for k in range(len(labels)):
        rank = np.argsort(-counts[k] * (share[k] > 0.6), kind="stable")[:lexicon]
        rank = rank[(counts[k] * (share[k] > 0.6))[rank] > 0]
        lexicons[k, : len(rank)] = whole[rank]
    spans = [(a, b) for o, p in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for a in range(o, p, 40) for b in (min(a + 40, p),)]
    draw = np.random.default_rng(7)
    lines, tags = [], []
    for k, (a, b) in enumerate(spans):
        line, tag = ids[a:b], gold[a:b]
        if k % 3 == 0:
            c, d = spans[int(draw.integers(len(spans)))]
            cut = int(draw.integers(1, max(2, len(line))))
            line, tag = np.concatenate([line[:cut], ids[c:d], line[cut:]]), np.concatenate([tag[:cut], gold[c:d], tag[cut:]])
        lines.append(line)
        tags.append(tag)
    seq = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    ids, gold = np.concatenate(lines), np.concatenate(tags)
    n_labels = len(labels)
    bucket, first = _features(words, lexicons, buckets)
    of = np.repeat(np.arange(len(words)), np.diff([*first, len(bucket)]))
    weight, step, start = np.zeros((buckets, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    seen = [np.full_like(weight, 1e-2), np.full_like(step, 1e-2), np.full_like(start, 1e-2)]
    truth = np.stack([np.bincount(ids[gold == k], minlength=len(words)) for k in range(n_labels)], axis=1)
    inner = np.ones(len(ids), bool)
    inner[seq[:-1]] = False
    follows = np.flatnonzero(inner)
    moved, begun = np.zeros_like(step), np.bincount(gold[seq[:-1]], minlength=n_labels)
    np.add.at(moved, (gold[follows - 1], gold[follows]), 1)
    for _ in range(epochs):
        scores = np.add.reduceat(weight[bucket], first, axis=0)[ids]
        gamma, trans, starts, _ = forward_backward(scores, seq, step, start, pairs=True)
        by_word = truth - np.stack([np.bincount(ids, gamma[:, k], len(words)) for k in range(n_labels)], axis=1)
        up = [np.stack([np.bincount(bucket, by_word[of, k], buckets) for k in range(n_labels)], axis=1) / len(ids) - decay * weight, (moved - trans) / len(ids), (begun - starts) / len(seq)]
        for w, g, s in zip((weight, step, start), up, seen, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s) * (10 if w is weight else 3)
    model = Crf(labels, lexicons, weight.astype(np.float32), step.astype(np.float32), start.astype(np.float32), _typical(bucket, of, counts.T, buckets).astype(np.float32))
    least = []
    for f in range(FOLDS):
        without = replace(model, typical=_typical(bucket, of, held[f], buckets).astype(np.float32))
        ids, offsets, words, rows = _lines(column.take(pa.array(np.arange(f, len(texts), FOLDS))))
        like = _marginals(without, ids, offsets, words, offsets[rows])[-1]
        least.append(like[~np.isnan(like)])
    like = np.concatenate(least)
    model.least = float(min(LIKENESS * np.median(like), like.min())) if len(like) else -np.inf
    return model


def _marginals(model: Crf, ids: np.ndarray, offsets: np.ndarray, words: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals and label of each word, mean likeness of each row's words to their labels, NaN for rows without words)."""
    scores, alike = model.evidence(words)
    gamma = model.marginals(scores[ids], offsets)
    label = gamma.argmax(axis=1)
    total = np.concatenate([[0], np.cumsum(alike[ids, label], dtype=np.float64)])
    with np.errstate(invalid="ignore"):
        return gamma, label, (total[first[1:]] - total[first[:-1]]) / np.diff(first)


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(ids, line offsets, dictionary, first line of each row): sequences are the lines of a text."""
    lists = pc.split_pattern(pc.fill_null(column, ""), "\n")
    ids, offsets, words = text.word_ids(lists.flatten(), letters_only=True)
    return ids, offsets, words, lists.offsets.to_numpy()


_RESULT = [("language", pa.string()), ("share", pa.float64()), ("n_words", pa.int64()), ("n_switches", pa.int64()), ("accepted", pa.bool_())]


_SPAN = pa.struct([("language", pa.string()), ("first", pa.int64()), ("n", pa.int64())])


def label_rows(model: Crf | None, column: pa.Array, min_share: float) -> list[pa.Array]:
    """Result columns for a column of texts, without spans."""
    return _labelled(model, column, min_share)[0]


def _spans(label: np.ndarray, first: np.ndarray, labels: list[str]) -> pa.Array:
    """Runs of words with one label in each row that first cuts the words into, counted from 0 in their row."""
    new = np.ones(len(label), bool)
    new[1:] = label[1:] != label[:-1]
    new[first[:-1][first[:-1] < len(label)]] = True
    starts = np.flatnonzero(new)
    row = np.searchsorted(first, starts, side="right") - 1
    values = [pa.array(np.array(labels, object)[label[starts]], pa.string()), pa.array(starts - first[row]), pa.array(np.diff([*starts, len(label)]))]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, first), pa.int32()), pa.StructArray.from_arrays(values, fields=list(_SPAN)))


def _labelled(model: Crf | None, column: pa.Array, min_share: float, spans: bool = False) -> tuple[list[pa.Array], pa.Array | None]:
    """Result columns for a column of texts, and the spans if asked for."""
    ids, offsets, words, rows = _lines(column)
    first = offsets[rows]
    n_words = np.diff(first)
    if model is None:
        none = pa.nulls(len(n_words))
        return [none.cast(pa.string()), none.cast(pa.float64()), pa.array(n_words), pa.array(np.zeros(len(n_words), np.int64)), pa.array(n_words > 0)], none.cast(pa.list_(_SPAN))
    gamma, label, like = _marginals(model, ids, offsets, words, first)
    total = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0, dtype=np.float64)])
    mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n_words, 1)[:, None]
    best, share = mean.argmax(axis=1), mean.max(axis=1)
    inner = np.ones(len(ids), bool)
    inner[offsets[:-1][offsets[:-1] < len(ids)]] = False
    change = np.zeros(len(ids) + 1, np.int64)
    if len(ids):
        change[1:] = np.cumsum(inner & (np.concatenate([label[:1], label[:-1]]) != label))
    empty = n_words == 0
    columns = [
        pa.array(np.array(model.labels, object)[best], pa.string(), mask=empty), pa.array(share, pa.float64(), mask=empty), pa.array(n_words),
        pa.array(change[first[1:]] - change[first[:-1]]), pa.array(~empty & (share >= min_share) & (like + 1 / np.sqrt(np.maximum(n_words, 1)) >= model.least)),
    ]
    return columns, _spans(label, first, model.labels) if spans else None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Crf | None:
    """A model from per_language rows of each language; None where no row is labelled."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).filter("label is not null and text is not null")
    keys = rows.select("label", F.xxhash64("id").alias("h"), "id")
    chosen = keys.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))).filter(F.col("nth") <= per_language).select("id", "label").distinct()
    sample = rows.join(F.broadcast(chosen), ["id", "label"], "left_semi").select("id", "text", "label").orderBy("label", "id", "text").toPandas()
    if not len(sample):
        return None
    return fit(sample["text"].tolist(), sample["label"].tolist())


_FIELDS = "language string, share double, n_words long, n_switches long, accepted boolean, spans array<struct<language:string,first:long,n:long>>"


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, language, share, n_words, n_switches, accepted, spans) of every row.

    share is the mean marginal of the language over the words; n_switches counts neighbours in a line with different labels;
    accepted: there are words, share reaches min_share and the words look like their labels (least likeness of the model); spans: the runs of words with one label, (language, first word
    counted from 0, number of words), that cover the words with letters in their order.
    """
    model = train(docs, id_col, text_col, label_col, per_language)
    source = common.tuned(docs).select(common.whole(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, 600):
            columns, spans = _labelled(held.value, batch[1], min_share, spans=True)
            yield pa.record_batch([batch[0], *columns, spans], names=["doc_id", *(n for n, _ in _RESULT), "spans"])

    held = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(common.lean(run), f"doc_id long, {_FIELDS}")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, min_share: float = MIN_SHARE) -> DataFrame:
    """docs without the rows whose language is not identified; all columns as they were, even if named alike."""
    model = train(docs, id_col, text_col, label_col, per_language)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = common.tuned(docs).columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, 600):
            yield batch.filter(label_rows(held.value, batch[at], min_share)[-1])

    return docs.mapInArrow(common.lean(run), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
