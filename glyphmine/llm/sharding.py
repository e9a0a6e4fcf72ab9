"""Byte-balanced shards by Karmarkar-Karp differencing.

Indivisible groups (here: documents with the same text, so no copy straddles two shards) are weighed in bytes. A partial
partition is a vector of one sum for each shard. The two partial partitions with the largest spread are combined, one
ordered against the other, again and again, until one is left. Groups are dealt to parts by hash, each part
is differenced by itself, and the parts' vectors are differenced in turn, `fan` at a time, level by level, so no
task or driver ever holds more than a part.

Defined results: every row gets a shard; rows with null group (null text) are one group of 0 bytes; rows with null id keep a
null doc_id; repeated rows add their bytes again and stay together; columns other than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS, PART_GROUPS, FAN = 64, 20_000, 256


def difference(vectors: np.ndarray) -> np.ndarray:
    """The final shard of each entry of each vector: (n, k) sums of partial partitions give an (n, k) matrix of shards.

    A single weight w is the vector (w, 0, ..., 0).
    """
    n, k = vectors.shape
    order = np.argsort(-vectors, axis=1, kind="stable")
    tops = list(np.take_along_axis(vectors, order, axis=1))
    heap = [(-int(t[0] - t[-1]), i) for i, t in enumerate(tops)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = tops[a] + tops[b][::-1]
        rank = np.argsort(-total, kind="stable")
        tops[a] = tops[b] = None
        tops.append(total[rank])
        spot = np.empty(k, np.int64)
        spot[rank] = np.arange(k)
        merged.append((a, b, spot))
        heapq.heappush(heap, (-int(tops[-1][0] - tops[-1][-1]), len(tops) - 1))
    final: list[np.ndarray | None] = [None] * (n + len(merged))
    if n:
        final[-1] = np.arange(k)
    for at in range(len(merged) - 1, -1, -1):
        a, b, spot = merged[at]
        here = final[n + at][spot]
        final[a], final[b] = here, here[::-1]
        final[n + at] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = final[i]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables with one value in the first column, of rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch[0].to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                if held and held[0][0][0].as_py() != values[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _weigh(shards: int) -> Callable:
    """Slots of the groups of a part: rows (part, key, bytes) to (part, key, bytes, slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            weights = np.zeros((part.num_rows, shards), np.int64)
            weights[:, 0] = part["bytes"].to_numpy()
            slot = difference(weights)[:, 0]
            yield from part.append_column("slot", pa.array(slot)).combine_chunks().to_batches()

    return run


def _merge(shards: int) -> Callable:
    """Slots of parts' slots: rows (above, part, slot, bytes) to (above, part, slot, bytes, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above in _runs(batches):
            parts, at = np.unique(above["part"].to_numpy(), return_inverse=True)
            vectors = np.zeros((len(parts), shards), np.int64)
            slots = above["slot"].to_numpy()
            vectors[at, slots] = above["bytes"].to_numpy()
            yield from above.append_column("to", pa.array(difference(vectors)[at, slots])).combine_chunks().to_batches()

    return run


def shard(docs: DataFrame, group: Column, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, part_groups: int = PART_GROUPS, fan: int = FAN) -> DataFrame:
    """(doc_id, shard, n_bytes) of every row; rows with one value of group share a shard."""
    rows = common.tuned(docs).select(common.whole(docs, id_col).alias("doc_id"), F.coalesce(group.cast("string"), F.lit("")).alias("key"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"))
    rows = common.materialize(rows, "weights")
    groups = common.materialize(rows.groupBy("key").agg(F.sum("bytes").alias("bytes")), "groups")
    parts = max(1, -(-groups.count() // part_groups))
    dealt = groups.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "key", "bytes").repartition("part").sortWithinPartitions("part", "key")
    placed = common.materialize(dealt.mapInArrow(common.lean(_weigh(shards)), "part long, key string, bytes long, slot long"), "placed")
    to = placed.select("key", "part", "slot")
    sums = placed.groupBy("part", "slot").agg(F.sum("bytes").alias("bytes"))
    while parts > 1:
        parts = -(-parts // fan)
        ordered = sums.select(F.floor(F.col("part") / fan).alias("above"), "part", "slot", "bytes").repartition("above").sortWithinPartitions("above", "part", "slot")
        moved = common.materialize(ordered.mapInArrow(common.lean(_merge(shards)), "above long, part long, slot long, bytes long, to long"), "moved")
        to = to.join(moved.select("part", "slot", "above", "to"), ["part", "slot"]).select("key", F.col("above").alias("part"), F.col("to").alias("slot"))
        sums = moved.groupBy(F.col("above").alias("part"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
    return rows.join(to.select("key", F.col("slot").cast("int").alias("shard")), "key").select("doc_id", "shard", F.col("bytes").alias("n_bytes"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents; documents with one text stay together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, F.md5(F.col("text").cast("binary")))
