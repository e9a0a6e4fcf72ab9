"""Best-fit packing by non-negative least squares over length patterns.

A document of more than capacity tokens gives full sequences and a rest; nothing is cut away. Rests and short documents are items, and
an item's length is rounded up to one of `bins` equal steps of the capacity. Patterns are the multisets of up to `depth` steps that fit the
capacity and leave at most SLACK of it, by default nothing, unused: sequences that small items could still fill are left to the residual. A non-negative least-squares fit finds how often each pattern must occur to reproduce the histogram of all items, with a row that
charges unused steps; the counts are rounded down, fitted again on what is left, and the residual histogram
is packed best fit, largest first, again as patterns with counts. The plan's size depends on bins alone, so the driver
holds only a histogram and a few hundred patterns at any input size.

Every item then finds its place by rank: items are numbered within their step, from counts of hash groups of documents
and a prefix sum over groups, so no task ever holds a whole step. Only ids and lengths are shuffled.

Defined results: a null or empty text has no tokens and takes no place; rows with null id are packed like others, with
null doc_id; repeated rows are packed as often as they occur; columns other than id and text are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text, vocabulary

CAPACITY, BINS, DEPTH = 2048, 64, 4
#: Documents of a hash group, in which ranks are counted.
GROUP_DOCS = 50_000
#: Weight of an unused step against a miscounted item, and fits before the residual is packed.
WASTE, FITS = 0.05, 4
#: Share of the capacity that a pattern may leave unused.
SLACK = 0.0


def patterns(bins: int, depth: int) -> np.ndarray:
    """One row for each multiset of up to depth steps of 1 to bins whose sum is at most bins: how many of each step it has."""
    rows = []
    for k in range(1, depth + 1):
        for steps in combinations_with_replacement(range(1, bins + 1), k):
            if sum(steps) <= bins:
                rows.append(np.bincount(steps, minlength=bins + 1)[1:])
    return np.array(rows)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 of least |a x - b|, by active sets (Lawson and Hanson)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance:
            break
        active[best] = True
        while True:
            index = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, index], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[index] = z
                break
            low = z <= 1e-12
            ratio = x[index][low] / np.maximum(x[index][low] - z[low], 1e-300)
            x[index] += ratio.min() * (z - x[index])
            gone = index[low][ratio <= ratio.min() + 1e-15]
            active[gone] = False
            x[gone] = 0
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH, waste: float = WASTE, fits: int = FITS) -> list[tuple[int, list[int]]]:
    """(repeat count, steps) of the packs that take every item of a histogram over steps 1 to len(histogram) once."""
    bins = len(histogram)
    left = np.array(histogram, np.int64)
    table = patterns(bins, depth)
    table = table[table @ np.arange(1, bins + 1) >= (1 - SLACK) * bins]
    charge = waste * (bins - table @ np.arange(1, bins + 1))
    system = np.vstack([table.T, charge[None, :]]).astype(float)
    packs: list[tuple[int, list[int]]] = []
    for _ in range(fits):
        scale = left.sum()
        if scale < 2 * bins:
            break
        found = nnls(system, np.append(left, 0.0) / scale) * scale
        for k in np.argsort(-found, kind="stable")[: np.count_nonzero(found)]:
            repeat = min(int(found[k]), int((left[table[k] > 0] // table[k][table[k] > 0]).min()))
            if repeat:
                packs.append((repeat, (np.repeat(np.arange(1, bins + 1), table[k])).tolist()))
                left -= repeat * table[k]
    while left.any():
        room, steps, taken = bins, [], np.zeros(bins, np.int64)
        while True:
            fit = np.flatnonzero((left - taken)[:room] > 0)
            if not len(fit):
                break
            largest = int(fit[-1])
            many = int(min(left[largest] - taken[largest], room // (largest + 1)))
            taken[largest] += many
            steps += [largest + 1] * many
            room -= many * (largest + 1)
        repeat = int((left[taken > 0] // taken[taken > 0]).min())
        packs.append((repeat, steps))
        left -= repeat * taken
    return packs


@cache
def _encoder(path: str) -> tiktoken.Encoding:
    return vocabulary.byte_bpe(path)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in text.slices(batches):
            counts = [len(encode(x)) if x else 0 for x in batch[1].to_pylist()]
            yield pa.record_batch([batch[0], pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = vocabulary.BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens) of every row, by a public byte-level BPE vocabulary."""
    source = common.tuned(docs).select(common.whole(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(common.lean(_counted(tokenizer)), "doc_id long, n_tokens long")


def pack(lengths: DataFrame, capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(pack_id, slot, doc_id, first_token, n_tokens) for rows (doc_id, n_tokens): what each sequence of capacity tokens holds."""
    spark = lengths.sparkSession
    step = -(-capacity // bins)
    if capacity != step * bins:
        raise ValueError("capacity must be a multiple of bins")
    counted = common.materialize(lengths.filter("n_tokens > 0").select("doc_id", "n_tokens"), "lengths")
    n_groups = max(1, -(-counted.count() // group_docs))
    keyed = counted.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(n_groups)).alias("g"), F.floor(F.col("n_tokens") / capacity).alias("full"), (F.col("n_tokens") % capacity).alias("rest"))
    keyed = keyed.withColumn("step", F.ceil(F.col("rest") / step).cast("int"))
    order = Window.partitionBy("g").orderBy("doc_id", "n_tokens")
    stepwise = Window.partitionBy("g", "step").orderBy("doc_id", "n_tokens")
    numbered = common.materialize(
        keyed.withColumn("nth", F.row_number().over(stepwise) - 1).withColumn("before", F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "numbered"
    )
    sizes = numbered.groupBy("g", "step").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("at", F.coalesce(F.sum("n").over(Window.partitionBy("step").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("g", "step", "at")
    fulls = numbered.groupBy("g").agg(F.sum("full").alias("n"))
    fulls = fulls.withColumn("full_at", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("g", "full_at")
    histogram = np.zeros(bins, np.int64)
    for r in sizes.filter("step > 0").groupBy("step").agg(F.sum("n").alias("n")).collect():
        histogram[r["step"] - 1] = r["n"]
    total_full = numbered.agg(F.sum("full")).first()[0] or 0
    used = np.zeros(bins, np.int64)
    ranges, first = [], total_full
    for repeat, steps in plan(histogram, depth):
        slot = 0
        for s in sorted(set(steps), reverse=True):
            times = steps.count(s)
            ranges.append((s, int(used[s - 1]), int(used[s - 1] + repeat * times), int(first), slot, times))
            used[s - 1] += repeat * times
            slot += times
        first += repeat
    schema = "step int, low long, high long, first long, slot int, times int"
    places = F.broadcast(spark.createDataFrame(ranges, T._parse_datatype_string(schema)))
    ranked = numbered.filter("rest > 0").join(offsets, ["g", "step"]).withColumn("rank", F.col("at") + F.col("nth"))
    placed = ranked.join(places, (ranked["step"] == places["step"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    inside = F.col("rank") - F.col("low")
    rests = placed.select(
        (F.col("first") + F.floor(inside / F.col("times"))).cast("long").alias("pack_id"), (F.col("slot") + inside % F.col("times")).cast("int").alias("slot"), "doc_id",
        (F.col("full") * capacity).cast("long").alias("first_token"), F.col("rest").cast("long").alias("n_tokens"),
    )
    whole = numbered.filter("full > 0").join(fulls, "g").select("doc_id", (F.col("full_at") + F.col("before")).alias("start"), F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("k"))
    whole = whole.select((F.col("start") + F.col("k")).cast("long").alias("pack_id"), F.lit(0).alias("slot"), "doc_id", (F.col("k") * F.lit(capacity).cast("long")).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    return rests.unionByName(whole)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = vocabulary.BYTE_BPE, **how) -> DataFrame:
    """pack() of the token counts of docs."""
    return pack(token_counts(docs, id_col, text_col, tokenizer), **how)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
