"""Benchmark decontamination with a distributed positional inverted index.

The training documents are split into segments; every segment stores postings of all its terms: the sorted hashes of the terms, how many
places each has, and the places, sorted for each term and written as differences (documents lie a gap apart, so no phrase crosses two). The
index is built once, whatever the benchmark: build_index() gives a table that probe() searches for any benchmark, without the texts. Term frequencies
over the whole corpus are summed from the segments, and give each benchmark window the order in which its lists are intersected: from the
rarest term, with offset-adjusted places. Windows with the same two rarest terms share their first intersection, and only windows whose
terms all occur in a segment are looked for there.

A window is a run of n tokens of an item (all of an item with fewer). A phrase match is a place where a window occurs word for
word; a proximity match is a place where all distinct terms of a window, at least `near_terms` of them, lie within
n + slop tokens. Both are counted for each (document, item).

Defined results: an item or text that is null or has no words matches nothing; rows with null id can't be reported and are left
out of the matches (keep_clean keeps them); repeated document rows are merged, as are repeated item rows; columns other than id
and text are ignored whatever their names. An empty benchmark or corpus gives no matches. Ids must be whole numbers; other text raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

N, SLOP, NEAR_TERMS = 13, 4, 8
#: Benchmark bytes that every task holds at once (about 15 bytes of windows for each); a larger benchmark is probed in parts, each of which reads the index, not the texts.
BENCHMARK_BYTES = 4 << 20
#: Tokens of a segment, and places between two documents in it.
_SEGMENT_TOKENS, _GAP = 1 << 19, 1 << 10
_AT_ONCE = 1 << 19

_SEGMENT = pa.schema([("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
_SEGMENT_TYPE = "terms binary, counts binary, places binary, docs binary, starts binary"


def encode(term: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Terms, counts and differences of places; the places of a term ascend."""
    order = np.argsort(term, kind="stable")
    term, place = term[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(term)))
    wide = "<i4" if not len(place) or place.max() < 1 << 31 else "<i8"
    steps = np.diff(place, prepend=0).astype(wide)
    return term[first].astype("<i8").tobytes(), counts.astype("<i4").tobytes(), wide.encode() + steps.tobytes()


def decode(terms: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, ends, places): the places of terms[k] end at ends[k]."""
    return np.frombuffer(terms, "<i8"), np.cumsum(np.frombuffer(counts, "<i4"), dtype=np.int64), np.cumsum(np.frombuffer(places, places[:3].decode(), offset=3), dtype=np.int64)


def _index(gap: int):
    """Segments of a task's documents (id, text)."""

    def flush(docs: list, starts: list, terms: list, places: list) -> pa.RecordBatch:
        row = (*encode(np.concatenate(terms), np.concatenate(places)), np.array(docs, "<i8").tobytes(), np.array(starts, "<i8").tobytes())
        return pa.record_batch([pa.array([x], pa.binary()) for x in row], schema=_SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, starts, terms, places, at, held = [], [], [], [], 0, 0
        for batch in text.slices(batches):
            ids, offsets, words = text.word_ids(batch[1])
            length = np.diff(offsets)
            begin = at + np.concatenate([[0], np.cumsum(length + gap)[:-1]]).astype(np.int64)
            terms.append(text.word_hashes(words).astype(np.int64)[ids])
            places.append(np.arange(len(ids)) + np.repeat(begin - offsets[:-1], length))
            docs += batch[0].to_pylist()
            starts += begin.tolist()
            at = int(begin[-1] + length[-1] + gap)
            held += len(ids)
            if held > _SEGMENT_TOKENS:
                yield flush(docs, starts, terms, places)
                docs, starts, terms, places, at, held = [], [], [], [], 0, 0
        if docs:
            yield flush(docs, starts, terms, places)

    return run


@dataclass
class Windows:
    """Windows of a part of the benchmark, as runs of a stream of term numbers; plan() adds their orders."""

    items: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    stream: np.ndarray
    terms: np.ndarray
    orders: np.ndarray | None = None
    distinct: np.ndarray | None = None
    n_distinct: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple[int, str]], n: int) -> Windows:
        """Those of items (id, text); repeated items with one text count once."""
        rows = sorted(set(rows))
        ids, offsets, words = text.word_ids(pa.array([body for _, body in rows], pa.string()))
        hashes = text.word_hashes(words).astype(np.int64)[ids]
        terms, stream = np.unique(hashes, return_inverse=True)
        items, begins, lengths = [], [], []
        for (item, _), a, b in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            count = max(1, b - a - n + 1) if b > a else 0
            items += [item] * count
            begins += range(a, a + count)
            lengths += [min(n, b - a)] * count
        return Windows(np.array(items, np.int64), np.array(begins, np.int64), np.array(lengths, np.int64), stream.astype(np.int64), terms)

    def plan(self, frequency: np.ndarray) -> None:
        """For each window its offsets and its distinct terms, from the rarest by the frequencies of terms over the corpus; rows are padded."""
        most = int(self.lengths.max()) if len(self.lengths) else 0
        within = np.arange(most) < self.lengths[:, None]
        here = self.stream[np.minimum(self.begins[:, None] + np.arange(most), max(0, len(self.stream) - 1))]
        order = np.argsort(np.where(within, frequency[here], np.iinfo(np.int64).max), axis=1, kind="stable")
        ranked = np.take_along_axis(here, order, 1)
        again = ~within
        for k in range(1, most):
            again[:, k] |= (ranked[:, :k] == ranked[:, k : k + 1]).any(axis=1)
        self.orders, self.n_distinct = order.astype(np.int32), (~again).sum(axis=1)
        self.distinct = np.take_along_axis(ranked, np.argsort(again, axis=1, kind="stable"), 1).astype(np.int32)


class Segment:
    """Postings of one segment, restricted to given sorted terms, as one sorted array of (term number, place)."""

    def __init__(self, row: tuple[bytes, ...], terms: np.ndarray):
        mine, ends, places = decode(*row[:3])
        self.docs, self.starts = np.frombuffer(row[3], "<i8"), np.frombuffer(row[4], "<i8")
        at = np.minimum(np.searchsorted(mine, terms), max(0, len(mine) - 1))
        self.present = mine[at] == terms if len(mine) else np.zeros(len(terms), bool)
        self.counts = np.zeros(len(terms), np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        self.counts[self.present] = (ends - begins)[at[self.present]]
        self.firsts = np.cumsum(self.counts) - self.counts
        take = np.repeat(np.where(self.present, begins[at] if len(mine) else 0, 0) - self.firsts, self.counts) + np.arange(int(self.counts.sum()))
        self.bits = int(places.max()).bit_length() + 1 if len(places) else 1
        self.keys = (np.repeat(np.arange(len(terms)), self.counts) << self.bits) | places[take]
        self.last = (1 << self.bits) - 1

    def places(self, term: int) -> np.ndarray:
        return self.keys[self.firsts[term] : self.firsts[term] + self.counts[term]] & self.last

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of each term at or after a place, a far one where there is none."""
        at = np.searchsorted(self.keys, (term << self.bits) | np.maximum(place, 0))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (found >> self.bits == term), found & self.last, 1 << 62)


def _phrases(segment: Segment, windows: Windows, w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows w and places p of their rarest terms, those where the window occurs word for word: lists are intersected in the window's order."""
    first = p - windows.orders[w, 0]
    for step in range(1, windows.orders.shape[1]):
        more = np.flatnonzero(windows.lengths[w] > step)
        offset = windows.orders[w[more], step]
        place = first[more] + offset
        ok = np.ones(len(w), bool)
        ok[more] = (place >= 0) & (segment.next(windows.stream[windows.begins[w[more]] + offset], place) == place)
        w, first = w[ok], first[ok]
    ok = first >= 0
    return w[ok], first[ok]


def _nearby(segment: Segment, windows: Windows, w: np.ndarray, p: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows w and places p of their rarest terms, those with all other terms in some stretch of the window's length and slop."""
    for step in range(1, windows.distinct.shape[1]):
        more = np.flatnonzero(windows.n_distinct[w] > step)
        reach = windows.lengths[w[more]] + slop
        ok = np.ones(len(w), bool)
        ok[more] = segment.next(windows.distinct[w[more], step].astype(np.int64), p[more] - reach + 1) < p[more] + reach
        w, p = w[ok], p[ok]
    kept = []
    for k, (window, place) in enumerate(zip(w.tolist(), p.tolist(), strict=True)):
        reach, around = int(windows.lengths[window]) + slop, []
        for d in windows.distinct[window, : windows.n_distinct[window]].tolist():
            list_ = segment.places(d)
            around.append(list_[np.searchsorted(list_, place - reach + 1) : np.searchsorted(list_, place + reach)])
        begins = np.unique(np.concatenate(around))
        if any(all(((x >= s) & (x < s + reach)).any() for x in around) for s in begins[(begins <= place) & (begins > place - reach)].tolist()):
            kept.append(k)
    return w[kept], p[kept]


def match_segment(segment: Segment, windows: Windows, slop: int, near_terms: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc, item, phrase places, proximity places) of one segment, for each of its document rows."""
    counts: dict[tuple[int, int], list[int]] = {}

    def count(which: int, w: np.ndarray, p: np.ndarray) -> None:
        for d, item in zip((np.searchsorted(segment.starts, p, side="right") - 1).tolist(), windows.items[w].tolist(), strict=True):
            counts.setdefault((d, item), [0, 0])[which] += 1

    absent = np.concatenate([[0], np.cumsum(~segment.present[windows.stream])])
    asked = np.flatnonzero(absent[windows.begins + windows.lengths] == absent[windows.begins])
    if not len(asked) or not len(segment.keys):
        return
    # windows with the same two rarest terms share the intersection of these
    one = windows.distinct[asked, 0].astype(np.int64)
    two = np.where(windows.n_distinct[asked] > 1, windows.distinct[asked, min(1, windows.distinct.shape[1] - 1)], one)
    reach = windows.lengths[asked] + slop
    order = np.lexsort((reach, two, one))
    asked, one, two, reach = asked[order], one[order], two[order], reach[order]
    begins = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (reach[1:] != reach[:-1])]))
    ends = np.append(begins[1:], len(asked))
    many = segment.counts[one[begins]]
    cuts = np.searchsorted(np.cumsum(many), np.arange(_AT_ONCE, int(many.sum()), _AT_ONCE)).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(begins)], strict=True):
        if lo == hi:
            continue
        b = begins[lo:hi]
        group = np.repeat(np.arange(lo, hi), many[lo:hi])
        at = np.arange(len(group)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi] - segment.firsts[one[b]], many[lo:hi])
        p = segment.keys[at] & segment.last
        r = reach[begins[group]]
        ok = segment.next(two[begins[group]], p - r + 1) < p + r
        group, p = group[ok], p[ok]
        size = (ends - begins)[group]
        for a in range(0, len(group), _AT_ONCE // 64):
            g, q, s = group[a : a + _AT_ONCE // 64], p[a : a + _AT_ONCE // 64], size[a : a + _AT_ONCE // 64]
            w = asked[np.repeat(begins[g] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))]
            q = np.repeat(q, s)
            count(0, *_phrases(segment, windows, w, q))
            wide = windows.n_distinct[w] >= near_terms
            count(1, *_nearby(segment, windows, w[wide], q[wide], slop))
    for (d, item), (phrases, near) in counts.items():
        yield int(segment.docs[d]), item, phrases, near


_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_phrase", pa.int64()), ("n_near", pa.int64())])


def _match(held, slop: int, near_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                rows = list(match_segment(Segment(tuple(x.as_py() for x in row), held.value.terms), held.value, slop, near_terms))
                if rows:
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _MATCH, strict=True)], schema=_MATCH)

    return run


def _frequencies(held):
    """Of the given terms, how often each occurs in a task's segments: rows (term number, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for mine, counts in zip(batch[0], batch[1], strict=True):
                mine, counts = np.frombuffer(mine.as_py(), "<i8"), np.frombuffer(counts.as_py(), "<i4")
                if len(mine):
                    at = np.minimum(np.searchsorted(mine, terms), len(mine) - 1)
                    total += np.where(mine[at] == terms, counts[at], 0)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["term", "n"])

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = _GAP) -> DataFrame:
    """Postings of all terms of docs, a row for each segment, as a table in the shared folder; windows and slop up to half the gap can be searched."""
    source = common.tuned(docs).select(common.whole(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    return common.materialize(source.mapInArrow(common.lean(_index(gap)), _SEGMENT_TYPE), "postings")


def probe(index: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", n: int = N, slop: int = SLOP, near_terms: int = NEAR_TERMS, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_phrase, n_near) for every document of the index and item with a match."""
    spark = index.sparkSession
    items = benchmark.select(common.whole(benchmark, item_col).alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    parts = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // benchmark_bytes)
    schema = "doc_id long, item_id long, n_phrase long, n_near long"
    found = spark.createDataFrame([], schema)
    for part in range(parts):
        share = items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        windows = Windows.of([tuple(r) for r in share.collect()], n)
        if not len(windows.items):
            continue
        terms = spark.sparkContext.broadcast(windows.terms)
        frequency = np.zeros(len(windows.terms), np.int64)
        for r in index.select("terms", "counts").mapInArrow(common.lean(_frequencies(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            frequency[r.term] = r.n
        windows.plan(frequency)
        found = found.unionByName(index.mapInArrow(common.lean(_match(spark.sparkContext.broadcast(windows), slop, near_terms)), schema))
    # a repeated document row lies in several segments or places; the most matches of one row count
    return found.groupBy("doc_id", "item_id").agg(F.max("n_phrase").alias("n_phrase"), F.max("n_near").alias("n_near"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = N, slop: int = SLOP, near_terms: int = NEAR_TERMS, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """probe() of an index of docs built for it."""
    return probe(build_index(docs, id_col, text_col, max(_GAP, 2 * (n + slop))), benchmark, text_col, item_col, n, slop, near_terms, benchmark_bytes)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that hold a benchmark window word for word or in proximity; rows with null id stay."""
    leaks = common.materialize(find_leaks(docs, benchmark, id_col, text_col, **how).select(F.col("doc_id").alias("__leaks")).distinct(), "leaks")
    small = F.broadcast(leaks) if common.small_enough(leaks, 8) else leaks
    return docs.join(small, common.whole(docs, id_col) == small["__leaks"], "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all documents with the whole benchmark."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH dw AS (SELECT DISTINCT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\pL\pM\pN_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dt AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM dw),
bw AS (SELECT DISTINCT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\pL\pM\pN_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT item_id, k, list_slice(w, k, k + 12) AS terms FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM bw WHERE len(w) > 0)),
wt AS (SELECT item_id, k, unnest(terms) AS term, generate_subscripts(terms, 1) AS j FROM win),
freq AS (SELECT term, count(*) AS n FROM dt WHERE term IN (SELECT term FROM wt) GROUP BY term),
anchor AS (SELECT item_id, k, term, j FROM (SELECT wt.*, row_number() OVER (PARTITION BY item_id, k ORDER BY coalesce(n, 0), j) AS nth FROM wt LEFT JOIN freq USING (term)) WHERE nth = 1),
spots AS (SELECT item_id, k, doc_id, pos, pos - j + 1 AS first_pos, terms, len(list_distinct(terms)) AS distinct_terms, len(terms) + 4 AS reach FROM anchor JOIN win USING (item_id, k) JOIN dt USING (term)),
phrase AS (SELECT doc_id, item_id, count(*) AS n FROM spots JOIN dw USING (doc_id) WHERE first_pos >= 1 AND list_slice(w, first_pos, first_pos + len(terms) - 1) = terms GROUP BY ALL),
around AS (SELECT spots.item_id, spots.k, spots.doc_id, spots.pos, spots.reach, spots.distinct_terms, dt.pos AS p, dt.term FROM spots JOIN dt ON dt.doc_id = spots.doc_id AND dt.pos > spots.pos - spots.reach AND dt.pos < spots.pos + spots.reach AND list_contains(spots.terms, dt.term) WHERE spots.distinct_terms >= 8),
stretch AS (SELECT a.item_id, a.k, a.doc_id, a.pos, b.p, count(DISTINCT a.term) AS held, any_value(a.distinct_terms) AS wanted FROM around a JOIN (SELECT DISTINCT item_id, k, doc_id, pos, p FROM around WHERE p <= pos) b ON a.item_id = b.item_id AND a.k = b.k AND a.doc_id = b.doc_id AND a.pos = b.pos AND a.p >= b.p AND a.p < b.p + a.reach GROUP BY 1, 2, 3, 4, 5),
near AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT DISTINCT item_id, k, doc_id, pos FROM stretch WHERE held = wanted) GROUP BY ALL)
SELECT doc_id, item_id, coalesce(phrase.n, 0) AS n_phrase, coalesce(near.n, 0) AS n_near FROM phrase FULL JOIN near USING (doc_id, item_id)
"""
