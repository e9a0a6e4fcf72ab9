"""N-gram Jaccard join with count-vector R-trees.

Every text becomes its set of hashed word n-grams; texts with equal sets are one class, known by a 64-bit sum of the set and its size.
The n-grams of a class are hashed into at least half as many groups, and its group counts are a point; points of unlike numbers of groups are compared in the lesser one. One tree over all points can't be searched in less
than all pairs: points of unrelated texts lie equally far apart, so the maxima of a node of 16 of them bound the overlap with anything by nearly its
size. So trees are built in cells, and a class goes to the cells of its n - ceil(t n) + m rarest n-grams: two sets that reach the threshold t share m of
these, whichever order is used (prefix filter), so no link is lost. m is 2 where t is above 0.5, as different sets with one n-gram in common are half alike at most, and else 1:
unrelated texts meet by chance once, and a pair must meet m times. The order is by counts of all n-grams of all rows in a table of fixed size.

In a cell, pairs whose sizes or places in the order rule out the threshold are dropped, and so are those that share both n-grams
before: they have met twice already. Each remaining pair is taken in one cell. There an R-tree over the points, whose nodes store coordinate maxima and
size ranges, prunes by the sum of coordinate minima, and the pairs that survive are verified on their full n-gram sets. Cells
are cut into blocks of bounded bytes, and a part of the postings that outgrows a task is split into pairs of blocks, so none is held whole. There is
no cap on partners, cells or candidates.

Near copies of one text meet in most of its n-grams, so their pairs would be listed a hundred times. Such kin is found by a base, the n-grams that half of
a group in a sample of rows hold; a class belongs to the base it is most like. Pairs of one kin are counted together, as products of
incidence matrices over blocks of classes, and left out of the cells. The sample decides only which way a pair is counted: every pair is of one kin or isn't.

Exact but for chance collisions: 64-bit n-gram hashes, 64 bits and the size for a class, and 32-bit tags, of which two must coincide to drop a meeting
(a pair is lost where two of a class's few hundred tags in a part do so).

Defined results: a null text, or one without words, has no n-grams and no partner; a text of fewer than n words has one
n-gram, all of it; rows with null id are left out; an id that occurs in several rows counts once in a
class and never pairs with itself; where its rows hold different texts, its links are summed over them; columns other than id and text are ignored whatever their names.
Ids must be whole numbers; other text raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

N, THRESHOLD = 3, 0.6
#: Groups of a point: half as many as the set has n-grams or more, a power of two within these.
GROUPS, MOST_GROUPS = 256, 1 << 16
#: Counters of the table that orders n-grams, and in how many chunks tasks hand on theirs.
TABLE, _CHUNKS = 1 << 21, 64
#: Postings of a part on average, and from how many on it is split; grams (and 256 for each set) of a block of a cell.
PART, PART_LIMIT, BLOCK = 1 << 19, 1 << 21, 1 << 19
_LEAF, _FULL, _WAYS = 16, 65_535, 4
#: Rows of the sample that kin is found in, of how many n-grams one is looked at, and members of the sample that make a kin.
SAMPLE, ONE_OF, LEAST_KIN = 1 << 14, 4, 4
#: Classes and n-grams of a block of kin; rows of its matrix at once, n-grams multiplied at once, and the share of classes from which on an n-gram is multiplied.
KIN, KIN_GRAMS, _ROWS, _COLUMNS, _DENSE = 1 << 12, 1 << 21, 512, 512, 0.04
_SEEN, _FLUSH, _MEETS = 1 << 20, 1 << 20, 1 << 20


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed n-grams of each row."""
    ids, offsets, words = text.word_ids(column)
    hashes = text.word_hashes(words)[ids]
    grams = text.gram_hashes(hashes, n)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield text.gram_hashes(hashes[a:b], b - a) if b > a else hashes[:0]


def _identity(grams: np.ndarray) -> int:
    """64 bits that, with the size, stand for a set."""
    with np.errstate(over="ignore"):
        return int(text.mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def group_counts(grams: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((grams % np.uint64(groups)).astype(np.int64), minlength=groups)


def n_groups(size: int, least: int = GROUPS, most: int = MOST_GROUPS) -> int:
    """Groups for a set of size n-grams: a power of two, at least one for two n-grams, as unrelated sets in fuller groups seem to overlap."""
    return max(least, min(most, 1 << max(0, -(-size // 2) - 1).bit_length()))


def pack_counts(counts: np.ndarray) -> bytes:
    """Four bits a group where all counts are under 16, or else 16 bits; there 65535 stands for all that is at least as large."""
    if counts.max() < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return np.minimum(counts, _FULL).astype("<u2").tobytes()


def unpack_counts(packed: bytes, groups: int, size: int) -> np.ndarray:
    """A point whose full groups take the set's size, so bounds on the overlap stay upper bounds."""
    if len(packed) * 2 == groups:
        raw = np.frombuffer(packed, np.uint8)
        return np.stack([raw & 15, raw >> 4], axis=1).ravel().astype(np.int32)
    point = np.frombuffer(packed, "<u2").astype(np.int32)
    return np.where(point == _FULL, size, point)


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    """The point of the same set in fewer groups."""
    return point.reshape(-1, groups).sum(axis=0)


def may_reach(q: np.ndarray, size: np.ndarray | int, points: np.ndarray, sizes: np.ndarray, t: float) -> np.ndarray:
    """Whether the summed coordinate minima of two points of given sizes allow Jaccard similarity t."""
    return np.minimum(q, points).sum(axis=-1) * (1 + t) >= t * (size + sizes) - 1e-6


class CountRTree:
    """Bulk-loaded R-tree over count vectors: slabs by the coordinate that spreads most, nodes of up to _LEAF entries."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = np.array(self._tile(np.arange(len(points))), np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while len(top) > _LEAF:
            cuts = np.arange(0, len(top), _LEAF)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def _tile(self, index: np.ndarray) -> list[int]:
        if len(index) <= _LEAF:
            return index.tolist()
        index = index[np.argsort(self.points[index, np.argmax(np.var(self.points[index], axis=0))], kind="stable")]
        half = (len(index) // _LEAF + 1) // 2 * _LEAF
        return self._tile(index[:half]) + self._tile(index[half:])

    @staticmethod
    def _may(q: np.ndarray, size: int, top: np.ndarray, low: np.ndarray, high: np.ndarray, t: float) -> np.ndarray:
        """Which entries may hold a partner of q: sizes within reach, and enough overlap by summed coordinate minima."""
        found = np.flatnonzero((high >= t * size - 1e-9) & (low <= size / t + 1e-9))
        return found[may_reach(q, size, top[found], np.maximum(low[found], t * size), t)]

    def partners(self, at: int, t: float) -> np.ndarray:
        """Points that may have Jaccard similarity t with point at, itself included."""
        q, size = self.points[at], int(self.sizes[at])
        entries = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.order))
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[k]
            kept = entries[self._may(q, size, top[entries], low[entries], high[entries], t)]
            entries = (kept[:, None] * _LEAF + np.arange(_LEAF)).ravel()
            entries = entries[entries < (len(self.levels[k - 1][0]) if k else len(self.order))]
        real = self.order[entries]
        return real[self._may(q, size, self.points[real], self.sizes[real], self.sizes[real], t)]


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: the higher planes are mostly zeros and compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _some(grams: np.ndarray) -> np.ndarray:
    return grams[grams % np.uint64(ONE_OF) == 0]


class Kin:
    """Bases of kin over a part of all n-grams; of() gives a class its number, 0 where it is like none."""

    def __init__(self, bases: list[np.ndarray]):
        self.sizes = np.array([0, *map(len, bases)], np.int64)
        grams = np.concatenate([np.empty(0, np.uint64), *bases])
        order = np.argsort(grams, kind="stable")
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.grams, self.first, self.held = np.unique(grams[order], return_index=True, return_counts=True)

    def of(self, grams: np.ndarray) -> int:
        mine = _some(grams)
        if not len(mine) or not len(self.grams):
            return 0
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        at = at[self.grams[at] == mine]
        if len(at) * 2 < len(mine):
            return 0
        counts = self.held[at]
        hits = np.bincount(self.owner[np.arange(counts.sum()) + np.repeat(self.first[at] - np.cumsum(counts) + counts, counts)], minlength=len(self.sizes))
        like = hits / (len(mine) + self.sizes - hits)
        best = int(np.argmax(like))
        return best if like[best] >= 0.5 else 0


def find_kin(sets: list[np.ndarray], least: int = LEAST_KIN) -> list[np.ndarray]:
    """Bases of the kin among sampled sets: groups with an equal minimum hash, largest first."""
    sets = list({s.tobytes(): s for s in sets if len(s)}.values())
    if not sets:
        return []
    grams, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts, who = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sets)), sizes)
    groups = []
    for seed in range(4):
        least_hash = np.minimum.reduceat(text.mix(grams ^ np.uint64(0x9E3779B97F4A7C15 >> seed)), starts)
        order = np.argsort(least_hash, kind="stable")
        cuts = np.flatnonzero(np.diff(least_hash[order])) + 1
        groups += [g for g in np.split(order, cuts) if len(g) >= least]
    bases, free = [], np.ones(len(sets), bool)
    for group in sorted(groups, key=len, reverse=True):
        group = group[free[group]]
        if len(group) < least:
            continue
        some = group[:64]
        found, counts = np.unique(np.concatenate([sets[k] for k in some]), return_counts=True)
        base = found[2 * counts >= len(some)]
        hits = np.bincount(who[np.isin(grams, base)], minlength=len(sets))
        near = hits >= 0.5 * (sizes + len(base) - hits)
        if len(base) and near[group].sum() >= least and not Kin(bases).of(base):
            bases.append(base)
            free &= ~near
    return bases


def _sampled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            yield pa.record_batch([pa.array([_some(g).tobytes() for g in gram_sets(batch[0], n)], pa.binary())], names=["grams"])

    return run


_SURVEY = pa.schema([("id", pa.int64()), ("x", pa.int64()), ("n", pa.int32()), ("kin", pa.int32()), ("counts", pa.binary()), ("chunk", pa.int32()), ("tally", pa.binary())])


def _survey(n: int, groups: int, table: int, kin: Broadcast):
    """Class and point of each row; after a task's rows, its tally of n-grams in the order's table, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, held, size = np.zeros(table, np.int64), [], 0

        def add() -> None:
            if held:
                np.add(tally, np.bincount((np.concatenate(held) % np.uint64(table)).astype(np.int64), minlength=table), out=tally)

        for batch in text.slices(batches):
            out = []
            for id_, grams in zip(batch[0].to_pylist(), gram_sets(batch[1], n), strict=True):
                if len(grams):
                    out.append((id_, _identity(grams), len(grams), kin.value.of(grams), pack_counts(group_counts(grams, n_groups(len(grams), groups))), None, None))
                    held.append(grams)
                    size += len(grams)
            if size > _FLUSH:
                add()
                held, size = [], 0
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _SURVEY, strict=True)], schema=_SURVEY)
        add()
        if tally.any():
            parts = np.array_split(tally, min(_CHUNKS, table))
            out = [(None, None, None, None, None, k, _planes(p)) for k, p in enumerate(parts)]
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _SURVEY, strict=True)], schema=_SURVEY)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of tallies (chunk, tally), which come sorted by chunk."""
    now, total = None, None
    schema = pa.schema([("chunk", pa.int32()), ("tally", pa.binary())])
    for batch in batches:
        for chunk, tally in zip(batch[0].to_pylist(), batch[1], strict=True):
            if chunk != now:
                if now is not None:
                    yield pa.record_batch([[now], [total.tobytes()]], schema=schema)
                now, total = chunk, np.zeros(len(tally.as_py()) // 8, np.int64)
            total += np.frombuffer(tally.as_py(), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    if now is not None:
        yield pa.record_batch([[now], [total.tobytes()]], schema=schema)


def gram_ranks(survey: DataFrame, table: int) -> np.ndarray:
    """A byte for each counter of the order's table: eight steps for each doubling of its count over all rows."""
    rows = survey.filter("chunk is not null").select("chunk", "tally").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(common.lean(_totals), "chunk int, tally binary").collect()
    total = np.concatenate([np.frombuffer(bytes(r.tally), "<i8") for r in sorted(rows)]) if rows else np.zeros(table, np.int64)
    return np.minimum(255, 8 * np.log2(total + 1)).astype(np.uint8)


_POSTINGS = pa.schema([("part", pa.int64()), ("side", pa.int32()), ("blob", pa.binary())])
#: Fields of a posting: tag of the n-gram, tags of the two before it, size of the set, place in the order, class, and its kin or 0.
_FIELDS = np.dtype([("tag", "<u4"), ("one", "<u4"), ("two", "<u4"), ("n", "<i4"), ("at", "<i4"), ("x", "<i8"), ("kin", "<i4")])
_OWN = ("tag", "one", "two", "at")


def _pack(postings: np.ndarray) -> bytes:
    """The classes of runs of postings once each, and the postings' other fields, field by field."""
    first = np.flatnonzero(np.concatenate([[True], (postings["x"][1:] != postings["x"][:-1]) | (postings["n"][1:] != postings["n"][:-1])]))
    counts = np.diff(np.append(first, len(postings))).astype("<i4")
    head = np.array([len(postings), len(first)], "<i8").tobytes() + np.ascontiguousarray(postings["x"][first]).tobytes()
    return head + _planes(postings["n"][first]) + _planes(postings["kin"][first]) + _planes(counts) + b"".join(_planes(postings[f]) if f == "at" else np.ascontiguousarray(postings[f]).tobytes() for f in _OWN)


def _count(blob: bytes) -> int:
    return int(np.frombuffer(blob, "<i8", 1)[0])


def _unpack(blobs: list[bytes]) -> np.ndarray:
    found = []
    for blob in blobs:
        size, classes = np.frombuffer(blob, "<i8", 2).tolist()
        at, out = 16, np.empty(size, _FIELDS)

        def take(n: int, kind: str, planes: bool = True, blob: bytes = blob) -> np.ndarray:
            nonlocal at
            raw = np.frombuffer(blob, np.uint8, n * np.dtype(kind).itemsize, at)
            at += len(raw)
            return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).ravel() if planes and n else raw.view(kind)

        x, n, kin, counts = take(classes, "<i8", False), take(classes, "<i4"), take(classes, "<i4"), take(classes, "<i4")
        out["x"], out["n"], out["kin"] = np.repeat(x, counts), np.repeat(n, counts), np.repeat(kin, counts)
        for f in _OWN:
            out[f] = take(size, _FIELDS[f].str, f == "at")
        found.append(out)
    return np.concatenate(found) if found else np.empty(0, _FIELDS)


def meetings(t: float) -> int:
    """In how many cells a pair must meet; different sets that share one n-gram have a similarity of at most 0.5."""
    return 2 if t > 0.5 + 1e-9 else 1


def prefix(grams: np.ndarray, x: int, kin: int, ranks: np.ndarray, t: float) -> np.ndarray:
    """Postings, with the full n-gram in a field of its own, for the rarest n-grams of a set."""
    size = len(grams)
    order = grams[np.argsort(ranks[(grams % np.uint64(len(ranks))).astype(np.int64)], kind="stable")[: size - int(np.ceil(t * size - 1e-9)) + meetings(t)]]
    out = np.empty(len(order), [("gram", "<u8"), *((f, _FIELDS[f]) for f in _FIELDS.names)])
    tags = (order >> np.uint64(32)).astype(np.uint32)
    none = np.array([x & 0xFFFFFFFF, (x >> 32) & 0xFFFFFFFF], np.uint32)
    out["gram"], out["tag"], out["n"], out["at"], out["x"], out["kin"] = order, tags, size, np.arange(len(order)), x, kin
    out["one"], out["two"] = np.concatenate([none[:1], tags])[: len(order)], np.concatenate([none, tags])[: len(order)]
    return out


def _postings(n: int, kin: Broadcast, ranks: Broadcast, parts: int, t: float):
    """Postings of every class of a task, by part; a class of many rows is given once."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(held)
        part = ((found["gram"] & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, part = found[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        rows = [(int(part[a]), 0, _pack(found[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _POSTINGS, strict=True)], schema=_POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held, size = [], 0
        for batch in text.slices(batches):
            for grams in gram_sets(batch[0], n):
                key = (_identity(grams), len(grams))
                if not len(grams) or key in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(key)
                held.append(prefix(grams, key[0], kin.value.of(grams), ranks.value, t))
                size += len(held[-1])
                if size >= _FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


_MET = pa.schema([("cell", pa.int64()), ("ax", pa.int64()), ("an", pa.int32()), ("bx", pa.int64()), ("bn", pa.int32()), *_POSTINGS])


def _scramble(*columns) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.uint64(0)
        for c in columns:
            total = text.mix((np.asarray(c).astype(np.uint64) + total) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    return total


def meets(postings: np.ndarray, side: np.ndarray, part: int, t: float, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(cell, ax, an, bx, bn) of the pairs that meet in a part, are not of one kin and may reach the threshold; sides 1 and 2 meet each other, 0 all."""
    order = np.lexsort((postings["n"], postings["x"], side, postings["tag"]))
    p, side = postings[order], side[order]
    again = np.zeros(len(p), bool)
    again[1:] = (p["tag"][1:] == p["tag"][:-1]) & (p["x"][1:] == p["x"][:-1]) & (p["n"][1:] == p["n"][:-1]) & (side[1:] == side[:-1])
    p, side = p[~again], side[~again]
    order = np.lexsort((p["kin"], p["tag"]))
    p, side = p[order], side[order]
    starts = np.flatnonzero(np.diff(p["tag"].astype(np.int64), prepend=-1))
    lengths = np.diff(np.append(starts, len(p)))
    shared = np.repeat(lengths > 1, lengths)
    p, side = p[shared], side[shared]
    lengths = lengths[lengths > 1]
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    other = np.concatenate([[True], (p["tag"][1:] != p["tag"][:-1]) | (p["kin"][1:] != p["kin"][:-1]) | (p["kin"][1:] == 0)])[: len(p)]
    before = np.maximum.accumulate(np.where(other, np.arange(len(p)), 0)) - first
    cost = np.cumsum(p["n"].astype(np.int64) + 256)
    blocks = (cost - (cost[first] if len(p) else 0)) // block
    cut = np.searchsorted(np.cumsum(before), np.arange(0, int(before.sum()) + _MEETS, _MEETS), side="left") if len(p) else []
    edges = sorted({0, len(p), *(min(int(c) + 1, len(p)) for c in cut)})
    tag, one, two, n, at, x, _ = (np.ascontiguousarray(p[f]) for f in _FIELDS.names)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        count = before[lo:hi]
        b = np.repeat(np.arange(lo, hi), count)
        a = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count) + first[b]
        k = np.minimum(n[a], n[b]) >= t * np.maximum(n[a], n[b]) - 1e-9
        k &= (np.minimum(n[a] - at[a], n[b] - at[b]) + meetings(t) - 1) * (1 + t) >= t * (n[a].astype(np.int64) + n[b]) - 1e-6
        k &= (one[a] != one[b]) | (two[a] != two[b])
        k &= (side[a] == 0) | (side[a] != side[b])
        a, b = a[k], b[k]
        same = (x[a] == x[b]) & (n[a] == n[b])
        a, b = a[~same], b[~same]
        if len(a):
            swap = (x[a] > x[b]) | ((x[a] == x[b]) & (n[a] > n[b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield _scramble(np.full(len(a), part), tag[a], np.minimum(blocks[a], blocks[b]), np.maximum(blocks[a], blocks[b])).astype(np.int64), x[a], n[a], x[b], n[b]


def split_part(part: int, side: int, postings: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(part, side, postings) of the pairs of blocks that an oversized part is split into."""
    mine = (text.mix(postings["x"].astype(np.uint64) ^ np.uint64(part & 0xFFFFFFFFFFFFFFFF)) % np.uint64(_WAYS)).astype(np.int64)
    for i in range(_WAYS):
        here = postings[mine == i]
        for j in range(_WAYS) if len(here) else ():
            low, high = (min(i, j), max(i, j)) if side == 0 else (i, j) if side == 1 else (j, i)
            name = int(_scramble([part], [low + 1], [high + 1])[0].astype(np.int64))
            yield name, side if side else 0 if i == j else 1 if i < j else 2, _pack(here)


def _meet(t: float, limit: int, block: int):
    """Pairs of each part, for rows (part, side, blob) sorted by part; or, of an oversized part, its postings in smaller parts."""

    def pairs(part: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        found = {s: _unpack(blobs) for s, blobs in held.items()}
        side = np.concatenate([np.full(len(f), s, np.int8) for s, f in found.items()])
        for columns in meets(np.concatenate(list(found.values())), side, part, t, block):
            empty = [pa.nulls(len(columns[0]), f.type) for f in _POSTINGS]
            yield pa.record_batch([*(pa.array(c, f.type) for c, f in zip(columns, _MET, strict=False)), *empty], schema=_MET)

    def spill(part: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for side, blobs in held.items():
            rows = list(split_part(part, side, _unpack(blobs)))
            if rows:
                empty = [pa.nulls(len(rows), f.type) for f in list(_MET)[:5]]
                yield pa.record_batch([*empty, *(pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _POSTINGS, strict=True))], schema=_MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, over = None, {}, 0, False
        for batch in batches:
            for part, side, blob in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
                if part != now:
                    if held:
                        yield from (spill if over else pairs)(now, held)
                    now, held, size, over = part, {}, 0, False
                held.setdefault(side, []).append(blob.as_py())
                size += _count(held[side][-1])
                if size > limit:
                    over = True
                    yield from spill(now, held)
                    held, size = {}, 0
        if held:
            yield from (spill if over else pairs)(now, held)

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, list]]:
    """(cell, its members' data by class, its pairs), for rows (cell, kind, ax, an, bx, bn, data, copies) sorted by cell and kind, members before pairs."""
    now, members, found = None, {}, []
    for batch in batches:
        cells, kinds, ax, an, bx, bn = (batch[k].to_pylist() for k in range(6))
        data, copies = batch[6], batch[7].to_pylist()
        for k, cell in enumerate(cells):
            if cell != now:
                if found:
                    yield now, members, found
                now, members, found = cell, {}, []
            if kinds[k] == 0:
                members[ax[k], an[k]] = (data[k].as_py(), copies[k])
            else:
                found.append(((ax[k], an[k]), (bx[k], bn[k])))
    if found:
        yield now, members, found


_PAIR = pa.schema([("cell", pa.int64()), ("ax", pa.int64()), ("an", pa.int32()), ("bx", pa.int64()), ("bn", pa.int32())])


def surviving(members: dict[tuple[int, int], tuple[bytes, int]], found: list, groups: int, t: float) -> list:
    """The pairs of a cell that the R-trees over its points leave: one tree for each number of groups, which is the lesser one of a pair."""
    points = {key: unpack_counts(data, n_groups(key[1], groups), key[1]) for key, (data, _) in members.items()}
    by_groups: dict[int, list] = {}
    for p, q in found:
        by_groups.setdefault(min(len(points[p]), len(points[q])), []).append((p, q))
    kept = []
    for g, pairs in by_groups.items():
        keys = sorted({k for pair in pairs for k in pair})
        place = {key: k for k, key in enumerate(keys)}
        sizes = np.array([key[1] for key in keys], np.int64)
        here = np.stack([fold(points[key], g) for key in keys])
        if len(keys) <= _LEAF:
            a, b = np.array([[place[p], place[q]] for p, q in pairs]).T
            kept += [pairs[k] for k in np.flatnonzero(may_reach(here[a], sizes[a], here[b], sizes[b], t))]
            continue
        tree, now, near = CountRTree(here, sizes), None, set()
        for p, q in sorted(pairs):
            if p != now:
                now, near = p, set(tree.partners(place[p], t).tolist())
            if place[q] in near:
                kept.append((p, q))
    return kept


def _prune(groups: int, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for cell, members, found in _cells(batches):
            out += [(cell, *p, *q) for p, q in surviving(members, found, groups, t)]
            if len(out) > 20_000:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _PAIR, strict=True)], schema=_PAIR)
                out = []
        if out:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _PAIR, strict=True)], schema=_PAIR)

    return run


_SETS = pa.schema([("x", pa.int64()), ("n", pa.int32()), ("grams", pa.binary())])


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            out = [(_identity(g), len(g), g.astype("<u8").tobytes()) for g in gram_sets(batch[0], n) if len(g)]
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _SETS, strict=True)], schema=_SETS)

    return run


def verified(members: dict[tuple[int, int], tuple[bytes, int]], found: list, t: float) -> Iterator[tuple]:
    """(a, b, shared, total) of the pairs that reach the threshold, by their full sets."""
    sets = {key: np.frombuffer(data, "<u8") for key, (data, _) in members.items()}
    partners: dict[tuple[int, int], list] = {}
    for p, q in found:
        partners.setdefault(p, []).append(q)
    for p, others in partners.items():
        a = sets[p]
        for at in range(0, len(others), 64):
            some = others[at : at + 64]
            joined = np.concatenate([sets[q] for q in some])
            hit = a[np.minimum(np.searchsorted(a, joined), len(a) - 1)] == joined
            ends = np.cumsum([q[1] for q in some])
            shared = np.diff(np.concatenate([[0], np.cumsum(hit)[ends - 1]]))
            for q, s in zip(some, shared.tolist(), strict=True):
                if s >= t * (p[1] + q[1] - s) - 1e-12:
                    yield p, q, s, p[1] + q[1] - s


_VERIFIED = "ax long, an int, bx long, bn int, shared long, total long"
_LINKS = "x long, n int, links long, rx long, rn int"


def _verify(t: float):
    """Rows (ax, an, bx, bn, shared, total): one for each verified pair."""
    schema = pa.schema([("ax", pa.int64()), ("an", pa.int32()), ("bx", pa.int64()), ("bn", pa.int32()), ("shared", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, members, found in _cells(batches):
            for p, q, shared, total in verified(members, found, t):
                out.append((*p, *q, shared, total))
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _link(t: float):
    """Rows (x, n, links, rx, rn): for each class with a verified pair in a cell, the documents it is linked to there, and the least class it is connected with."""
    schema = pa.schema([("x", pa.int64()), ("n", pa.int32()), ("links", pa.int64()), ("rx", pa.int64()), ("rn", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, members, found in _cells(batches):
            links: dict[tuple[int, int], int] = {}
            root: dict[tuple[int, int], tuple[int, int]] = {}

            def find(k, root=root):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for p, q, _, _ in verified(members, found, t):
                for one, other in ((p, q), (q, p)):
                    links[one] = links.get(one, 0) + members[other][1]
                    root.setdefault(one, one)
                a, b = sorted((find(p), find(q)))
                root[b] = a
            out += [(*k, count, *find(k)) for k, count in links.items()]
            if len(out) > 20_000:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def near(sets: list[np.ndarray], left: int, t: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, column, shared, similar) for stretches of all pairs of the first left sets with the others, or of all sets where left is their number.

    row and column are the sets of a matrix's first entry. N-grams of many sets are multiplied as matrices, those of few added pair by pair.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), sizes)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = count > max(1, _DENSE * len(sets))
    number, many = np.cumsum(dense) - 1, dense[gram]
    held = np.zeros((len(sets), int(dense.sum())), np.uint8)
    held[who[many], number[gram[many]]] = 1
    few = (~dense & (count > 1))[gram]
    keys = np.sort(gram[few].astype(np.int64) * len(sets) + who[few])
    grams, owners = np.divmod(keys, len(sets))
    for lo in range(0, left, _ROWS):
        hi, begin = min(left, lo + _ROWS), lo if left == len(sets) else left
        shared = np.zeros((hi - lo, len(sets) - begin), np.float32)
        for c in range(0, held.shape[1], _COLUMNS):
            shared += held[lo:hi, c : c + _COLUMNS].astype(np.float32) @ held[begin:, c : c + _COLUMNS].astype(np.float32).T
        mine = np.flatnonzero((owners >= lo) & (owners < hi))
        start, end = np.searchsorted(keys, grams[mine] * len(sets) + begin), np.searchsorted(keys, (grams[mine] + 1) * len(sets))
        reach = np.cumsum(end - start)
        edges = [0, *(np.searchsorted(reach, np.arange(_MEETS, int(reach[-1]), _MEETS)) + 1).tolist(), len(mine)] if len(mine) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            counts = (end - start)[a:b]
            partner = np.arange(counts.sum()) + np.repeat(start[a:b] - np.cumsum(counts) + counts, counts)
            np.add.at(shared.reshape(-1), (np.repeat(owners[mine[a:b]], counts) - lo) * shared.shape[1] + owners[partner] - begin, np.float32(1))
        whole = shared.astype(np.float64)
        similar = whole >= t * (sizes[lo:hi, None] + sizes[None, begin:] - whole) - 1e-12
        if begin == lo:
            similar &= np.arange(lo, hi)[:, None] < np.arange(begin, len(sets))[None]
        yield lo, begin, shared, similar


def kin_links(sets: list[np.ndarray], copies: np.ndarray, left: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of near() the documents it is linked to, and the least set it is connected with."""
    links, root = np.zeros(len(sets)), np.arange(len(sets))
    for lo, begin, _, similar in near(sets, left, t):
        links[lo : lo + len(similar)] += similar @ copies[begin:].astype(np.float64)
        links[begin:] += copies[lo : lo + len(similar)].astype(np.float64) @ similar
        for i, row in enumerate(similar, lo):
            reached = root[begin:][row]
            if (reached != root[i]).any():
                all_ = np.unique(np.append(reached, root[i]))
                root[np.isin(root, all_)] = all_[0]
    return links.astype(np.int64), root


def _kin_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], list[np.ndarray], np.ndarray, int]]:
    """(classes, sets, copies, left) of pairs of blocks, for rows (kin, low, high, side, x, n, copies, grams) sorted by the first three."""
    now, sides = None, ({}, {})

    def cell() -> tuple:
        found = [(k, *v) for side in sides for k, v in sorted(side.items())]
        return [f[0] for f in found], [np.frombuffer(f[2], "<u8") for f in found], np.array([f[1] for f in found], np.int64), len(sides[0])

    for batch in batches:
        kin, low, high, side, x, n, copies = (batch[k].to_pylist() for k in range(7))
        for k, key in enumerate(zip(kin, low, high, strict=True)):
            if key != now:
                if sides[0] and (sides[1] or now[1] == now[2]):
                    yield cell()
                now, sides = key, ({}, {})
            sides[side[k]][x[k], n[k]] = (copies[k], batch[7][k].as_py())
    if sides[0] and (sides[1] or now[1] == now[2]):
        yield cell()


def _kin_link(t: float):
    """Rows as those of _link, for each class that is similar to another one of a pair of blocks."""
    schema = pa.schema([("x", pa.int64()), ("n", pa.int32()), ("links", pa.int64()), ("rx", pa.int64()), ("rn", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for classes, sets, copies, left in _kin_cells(batches):
            links, root = kin_links(sets, copies, left, t)
            out = [(*classes[k], int(links[k]), *classes[root[k]]) for k in np.flatnonzero(links).tolist()]
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _kin_verify(t: float):
    """Rows as those of _verify, for each similar pair of a pair of blocks."""
    schema = pa.schema([("ax", pa.int64()), ("an", pa.int32()), ("bx", pa.int64()), ("bn", pa.int32()), ("shared", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for classes, sets, _, left in _kin_cells(batches):
            x, n = (np.array(c, np.int64) for c in zip(*classes, strict=True))
            for lo, begin, shared, similar in near(sets, left, t):
                i, j = np.nonzero(similar)
                s = shared[i, j].astype(np.int64)
                a, b = i + lo, j + begin
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip((x[a], n[a].astype(np.int32), x[b], n[b].astype(np.int32), s, n[a] + n[b] - s), schema, strict=True)], schema=schema)

    return run


def _taken(pairs: DataFrame) -> DataFrame:
    """(cell, x, n) of the classes of each cell's pairs."""
    return pairs.select("cell", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("an").alias("n")), F.struct(F.col("bx").alias("x"), F.col("bn").alias("n")))).alias("who")).select("cell", "who.x", "who.n").distinct()


def _bring(pairs: DataFrame, taken: DataFrame, data: DataFrame, name: str) -> DataFrame:
    """Rows for _cells: the members of each cell's pairs with their data (x, n, name, copies), and the pairs."""
    none = lambda kind: F.lit(None).cast(kind)
    members = common.join_checked(data, taken, ["x", "n"], "inner", 20).select("cell", F.lit(0).alias("kind"), F.col("x").alias("ax"), F.col("n").alias("an"), none("long").alias("bx"), none("int").alias("bn"), F.col(name).alias("data"), "copies")
    asked = pairs.select("cell", F.lit(1).alias("kind"), "ax", "an", "bx", "bn", none("binary").alias("data"), none("long").alias("copies"))
    return members.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "kind")


class Join:
    """The classes of docs, (x, n, kin, id, copies) with the least id of each, their rows (id, x, n), and the pairs not of one kin that survive the R-trees."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int = N, threshold: float = THRESHOLD, groups: int = GROUPS, table: int = TABLE, part: int = PART, limit: int = PART_LIMIT, block: int = BLOCK, sample: int = SAMPLE, kin: int = KIN):
        self.n, self.t, self.kin = n, threshold, kin
        self.source = common.tuned(docs).select(common.whole(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
        spark = docs.sparkSession
        share = min(1.0, sample / max(1, docs.count()))
        sampled = self.source.select("text").sample(share, 1).mapInArrow(common.lean(_sampled(n)), "grams binary").collect()
        bases = spark.sparkContext.broadcast(Kin(find_kin([np.frombuffer(bytes(r.grams), np.uint64) for r in sampled])))
        del sampled
        survey = common.materialize(self.source.mapInArrow(common.lean(_survey(n, groups, table, bases)), "id long, x long, n int, kin int, counts binary, chunk int, tally binary"), "survey")
        self.rows = survey.filter("chunk is null").select("id", "x", "n")
        self.classes = survey.filter("chunk is null").select("id", "x", "n", "kin").distinct().groupBy("x", "n", "kin").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        ranks = spark.sparkContext.broadcast(gram_ranks(survey, table))
        total = survey.agg(F.sum("n")).first()[0] or 0
        parts = max(1, -(-int(total * (1 - threshold)) // part))
        placed = self.source.select("text").mapInArrow(common.lean(_postings(n, bases, ranks, parts, threshold)), "part long, side int, blob binary")
        met_schema = "cell long, ax long, an int, bx long, bn int, part long, side int, blob binary"
        found, tables = None, []
        while True:
            met = common.materialize(placed.repartition("part").sortWithinPartitions("part").mapInArrow(common.lean(_meet(threshold, limit, block)), met_schema), "met")
            tables.append(met)
            new = met.filter("cell is not null").select("cell", "ax", "an", "bx", "bn")
            found = new if found is None else found.unionByName(new)
            placed = met.filter("part is not null").select("part", "side", "blob")
            if placed.select("part").isEmpty():
                break
        candidates = common.materialize(found.groupBy("ax", "an", "bx", "bn").agg(F.min("cell").alias("cell"), F.count("*").alias("met")).filter(F.col("met") >= meetings(threshold)).drop("met"), "candidates")
        common.discard(*tables)
        taken = common.materialize(_taken(candidates), "taken")
        asked = common.materialize(taken.select("x", "n").distinct(), "asked")
        points = common.join_checked(survey.filter("chunk is null"), asked, ["x", "n"], "left_semi", 12).groupBy("x", "n").agg(F.first("counts").alias("counts"), F.lit(1).cast("long").alias("copies"))
        self.survivors = common.materialize(_bring(candidates, taken, points, "counts").mapInArrow(common.lean(_prune(groups, threshold)), "cell long, ax long, an int, bx long, bn int"), "survivors")
        common.discard(candidates, taken, asked)

    def _sets(self) -> DataFrame:
        """Rows for _cells with the full sets of the survivors' classes, each read from one document of its class."""
        taken = common.materialize(_taken(self.survivors), "taken")
        owners = common.materialize(self.classes.join(taken.select("x", "n").distinct(), ["x", "n"]).select("x", "n", "id", "copies"), "owners")
        return _bring(self.survivors, taken, self._read(owners), "grams")

    def _read(self, owners: DataFrame) -> DataFrame:
        """owners, a written table, with the full sets of their classes."""
        readers = common.materialize(owners.select("id").distinct(), "readers")
        sets = common.join_checked(self.source, readers, ["id"], "left_semi", 8).select("text").mapInArrow(common.lean(_grams(self.n)), "x long, n int, grams binary")
        return common.join_checked(sets, owners.drop("id"), ["x", "n"], "inner", 24)

    def _kin_sets(self) -> DataFrame:
        """Rows for _kin_cells: each class of a kin, once for each pair of blocks that its own is in."""
        owners = common.materialize(self.classes.filter("kin > 0"), "kin")
        ways = owners.groupBy("kin").agg(F.greatest(F.ceil(F.count("*") / self.kin), F.ceil(F.sum("n") / KIN_GRAMS)).cast("int").alias("ways"))
        mine = self._read(owners).join(F.broadcast(ways), "kin").withColumn("mine", F.pmod(F.xxhash64("x"), "ways").cast("int"))
        spread = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
        cells = spread.select("kin", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "x", "n", "copies", "grams")
        return cells.repartition("kin", "low", "high").sortWithinPartitions("kin", "low", "high")

    def pairs(self) -> DataFrame:
        kin = common.materialize(self._kin_sets().mapInArrow(common.lean(_kin_verify(self.t)), _VERIFIED), "verified")
        return kin.unionByName(common.materialize(self._sets().mapInArrow(common.lean(_verify(self.t)), _VERIFIED), "verified"))

    def links(self) -> DataFrame:
        """(x, n, links, rx, rn), several rows for a class."""
        kin = common.materialize(self._kin_sets().mapInArrow(common.lean(_kin_link(self.t)), _LINKS), "links")
        return kin.unionByName(common.materialize(self._sets().mapInArrow(common.lean(_link(self.t)), _LINKS), "links"))

    def groups(self, links: DataFrame) -> DataFrame:
        """(x, n, rx, rn): the root of each class that is connected with another one, by links or by an id in both."""
        node = lambda x, n: F.struct(F.col(x).alias("x"), F.col(n).alias("n"))
        edges = links.select(node("x", "n").alias("a"), node("rx", "rn").alias("b"))
        held = self.rows.distinct().groupBy("id").agg(F.min(node("x", "n")).alias("b"), F.count("*").alias("all")).filter("all > 1")
        shared = self.rows.distinct().join(held.select("id", "b"), "id").select(node("x", "n").alias("a"), "b")
        roots = components(edges.unionByName(shared))
        return roots.select("node.x", "node.n", F.col("root.x").alias("rx"), F.col("root.n").alias("rn"))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id_a, doc_id_b, shared, total, jaccard) of similar classes, each named by its least id; members() tells whom it stands for."""
    join = Join(docs, id_col, text_col, **how)
    a = join.classes.select(F.col("x").alias("ax"), F.col("n").alias("an"), F.col("id").alias("a"))
    b = join.classes.select(F.col("x").alias("bx"), F.col("n").alias("bn"), F.col("id").alias("b"))
    named = join.pairs().join(a, ["ax", "an"]).join(b, ["bx", "bn"])
    return named.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"), "shared", "total", (F.col("shared") / F.col("total")).alias("jaccard"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, class_id, links) for every id of docs.

    links counts the other documents that are similar to it, copies included; class_id is the least id of all that are
    connected with it by such links, its own where there are none.
    """
    join = Join(docs, id_col, text_col, **how)
    links = join.links()
    roots = common.materialize(join.groups(links), "roots")
    counted = join.classes.select("x", "n", "copies").join(links.groupBy("x", "n").agg(F.sum("links").alias("links")), ["x", "n"], "left").join(roots, ["x", "n"], "left")
    counted = counted.select("x", "n", F.coalesce("rx", "x").alias("rx"), F.coalesce("rn", "n").alias("rn"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    placed = common.materialize(join.rows.distinct().join(counted, ["x", "n"]), "placed")
    least = placed.groupBy("rx", "rn").agg(F.min("id").alias("class_id"))
    rows = placed.groupBy("id").agg(F.min("rx").alias("rx"), F.min("rn").alias("rn"), F.sum("links").alias("links")).join(least, ["rx", "rn"])
    every = docs.select(common.whole(docs, id_col).alias("id")).filter("id is not null").distinct()
    return every.join(rows, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b), root the least node, by alternating large and small stars."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = common.materialize(edges.select("a", "b").filter("a != b").distinct(), "edges")
    seen = None
    while True:
        near = both(now)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = common.materialize(near.filter("b > a").join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        old, now = now, common.materialize(small, "small")
        common.discard(old, large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents whose group of similar ones holds a smaller id; groups are connected components.

    Rows that share an id count as one document and stay or go together, so their classes are linked; rows with null id or no words stay.
    """
    join = Join(docs, id_col, text_col, **how)
    roots = join.groups(join.links())
    rows = join.rows.distinct()
    grouped = common.materialize(rows.join(roots, ["x", "n"], "left").select("id", F.coalesce("rx", "x").alias("rx"), F.coalesce("rn", "n").alias("rn")), "grouped")
    least = grouped.groupBy("rx", "rn").agg(F.min("id").alias("kept"))
    gone = common.materialize(grouped.join(least, ["rx", "rn"]).filter("id != kept").select(F.col("id").alias("__gone")).distinct(), "gone")
    small = F.broadcast(gone) if common.small_enough(gone, 8) else gone
    return docs.join(small, common.whole(docs, id_col) == small["__gone"], "left_anti")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\pL\pM\pN_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM words WHERE len(w) > 0),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, s, list(doc_id) AS ids FROM sets GROUP BY s),
members AS (SELECT c, unnest(ids) AS doc_id, len(ids) AS copies FROM classes),
grams AS (SELECT c, len(s) AS n, unnest(s) AS gram FROM classes),
pairs AS MATERIALIZED (SELECT a, b FROM (SELECT a.c AS a, b.c AS b, count(*) AS shared, any_value(a.n + b.n) - count(*) AS total FROM grams a JOIN grams b ON a.gram = b.gram AND a.c < b.c GROUP BY a.c, b.c) WHERE shared >= 0.6 * total - 1e-12),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
steps AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT m.c, o.c FROM members m JOIN members o ON m.doc_id = o.doc_id AND m.c <> o.c),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, steps.b FROM reach JOIN steps ON reach.b = steps.a),
roots AS (SELECT a AS c, min(doc_id) AS class_id FROM reach JOIN members ON members.c = reach.b GROUP BY a),
linked AS (SELECT a AS c, sum(len(ids)) AS links FROM edges JOIN classes ON classes.c = edges.b GROUP BY a),
found AS (SELECT doc_id, min(class_id) AS class_id, sum(copies - 1 + coalesce(links, 0)) AS links FROM members JOIN roots USING (c) LEFT JOIN linked USING (c) GROUP BY doc_id)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN found USING (doc_id)
"""
