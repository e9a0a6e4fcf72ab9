"""Capture index of web pages by external merge.

Each input partition sorts its captures by URL key, timestamp and id and writes them as a run to the shared folder. The runs are cut into ranges of
that order; every range task finds the ascending runs in what it receives and merges them with a loser tree, so the
partitions together are one globally ordered index. What a task receives beyond HELD_BYTES goes, merged, to a run in the shared folder, and
these runs are merged in the end, a batch of each at a time. A capture gets its place in that order and in the history of its key; the history of a
hot key may cross many ranges, and goes on from one to the next by sums over a table with a row for each range.

The URL key has the host's labels reversed, without scheme, user, port, leading www and fragment, all in lower case, a path without
closing slashes and the query's parts sorted. The table of pages has no times: unless a column is named, a capture's
time is EPOCH plus a minute for each id, null for ids whose time lies outside the years 1 to 9999.

Defined results: rows with null url have no key and are left out; a null id gives a null time and sorts first; null html has null digest and 0
bytes; repeated rows are captures of their own, in an order that can't be told apart;
columns other than those named are ignored. Ids must be whole numbers; other text raises an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

EPOCH = 1_704_067_200
#: Ids whose minute lies in the years 1 to 9999.
_FIRST, _LAST = -(EPOCH + 62_135_596_800) // 60 + 1, (253_402_300_799 - EPOCH) // 60
#: Bytes of captures that a range task holds before it writes them as a merged run.
HELD_BYTES = 64 << 20


def url_key(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    authority = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":[0-9]*$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    return F.concat(
        F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))),
    )


class LoserTree:
    """Merges sorted sources: the tree's nodes hold the losers of the matches between them, and the winner is replayed along its path."""

    def __init__(self, sources: list[Iterator]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.k = len(sources)
        self.losers = [-1] * self.k
        for s in range(self.k):
            self._replay(s)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, s: int) -> None:
        at = (s + self.k) // 2
        while at:
            if self.losers[at] == -1:
                self.losers[at] = s
                return
            if self._beats(self.losers[at], s):
                self.losers[at], s = s, self.losers[at]
            at //= 2
        self.losers[0] = s

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.sources[winner], None)
            self._replay(winner)


_MERGED = pa.schema([("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("local_no", pa.int64()), ("capture_no", pa.int64()), ("revisit", pa.bool_())])
_LOWEST = -(1 << 63)


_SPILLED = pa.schema([("urlkey", pa.string()), ("at", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("content", pa.string()), ("n_bytes", pa.int64()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("digest", pa.string())])


def _write_run(rows: Iterator[tuple], uri: str) -> str:
    fs, path = common.file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as sink, pa.ipc.new_stream(sink, _SPILLED) as out:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 5000:
                out.write_batch(pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), _SPILLED, strict=True)], schema=_SPILLED))
                held = []
        if held:
            out.write_batch(pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), _SPILLED, strict=True)], schema=_SPILLED))
    return uri


def _read_run(uri: str) -> Iterator[tuple]:
    fs, path = common.file_system(uri)
    with fs.open_input_stream(path) as source:
        for batch in pa.ipc.open_stream(source):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
    fs.delete_file(path)


def merged_rows(batches: Iterator[pa.RecordBatch], spill_uri: str, held_bytes: int) -> Iterator[tuple]:
    """The rows of a range in order; ascending runs are found as they come."""
    runs: list[list[tuple]] = [[]]
    spilled, size = [], 0
    for batch in batches:
        for key, ts, page, url, digest, n_bytes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = (key, ts or "", _LOWEST if page is None else page, url, digest or "", n_bytes, ts, page, digest)
            if runs[-1] and row[:5] < runs[-1][-1][:5]:
                runs.append([])
            runs[-1].append(row)
            size += len(key) + len(url) + 400
            if size > held_bytes:
                spilled.append(_write_run(iter(LoserTree([iter(r) for r in runs])), f"{spill_uri}/{uuid.uuid4().hex}.arrow"))
                runs, size = [[]], 0
    yield from LoserTree([*map(_read_run, spilled), *(iter(r) for r in runs)])


def _merge(spill_uri: str, held_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, no, now, before, nth = [], 0, None, None, 0
        for key, _, _, url, _, size, ts, page, digest in merged_rows(batches, spill_uri, held_bytes):
            if key != now:
                now, before, nth = key, None, 0
            out.append((key, ts, page, url, digest, size, no, nth, digest is not None and digest == before))
            before, no, nth = digest, no + 1, nth + 1
            if len(out) == 20_000:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _MERGED, strict=True)], schema=_MERGED)
                out = []
        if out:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _MERGED, strict=True)], schema=_MERGED)

    return run


def capture_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(global_no, urlkey, capture_no, timestamp, page_id, url, digest, n_bytes, revisit), numbers from 0; revisit: the digest is that of the key's capture before."""
    page = common.whole(pages, id_col)
    when = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.when(page.between(_FIRST, _LAST), page) * 60 + EPOCH)
    captures = common.tuned(pages).filter(F.col(url_col).isNotNull()).select(
        url_key(F.col(url_col)).alias("urlkey"), F.date_format(when, "yyyyMMddHHmmss").alias("timestamp"), page.alias("page_id"), F.col(url_col).alias("url"),
        F.md5(F.col(html_col).cast("binary")).alias("digest"), F.coalesce(F.octet_length(html_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    order = ["urlkey", "timestamp", "page_id", "url", "digest"]
    runs = common.materialize(captures.sortWithinPartitions(*order), "runs")
    merged = runs.repartitionByRange(*order).mapInArrow(common.lean(_merge(common.shared_path(pages.sparkSession, "captures"), held_bytes)), "urlkey string, timestamp string, page_id long, url string, digest string, n_bytes long, local_no long, capture_no long, revisit boolean")
    merged = common.materialize(merged.withColumn("range", F.spark_partition_id()), "merged")
    starts = common.materialize(_starts(merged), "starts")
    numbered = common.join_checked(merged, starts, ["range"], "inner", 400)
    goes_on = (F.col("urlkey") == F.col("first_key")) & F.col("earlier").isNotNull()
    return numbered.select(
        (F.col("start") + F.col("local_no")).alias("global_no"), "urlkey", (F.col("capture_no") + F.when(goes_on, F.col("earlier")).otherwise(0)).alias("capture_no"), "timestamp", "page_id", "url", "digest", "n_bytes",
        F.when(goes_on & (F.col("local_no") == 0), F.coalesce(F.col("digest") == F.col("digest_before"), F.lit(False))).otherwise(F.col("revisit")).alias("revisit"),
    )


def _starts(merged: DataFrame) -> DataFrame:
    """(range, start, first_key, earlier, digest_before): how many captures lie before each range, and what earlier ranges hold of its first key."""
    at = F.col("local_no")
    ends = merged.groupBy("range").agg(
        F.count("*").alias("n"), F.min_by("urlkey", at).alias("first_key"), F.max_by("urlkey", at).alias("last_key"), (F.max_by("capture_no", at) + 1).alias("tail"), F.max_by(F.struct("digest"), at).alias("last_digest"),
    )
    ends = ends.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before, here = ends.alias("p"), ends.alias("r")
    begun = before.join(here, (F.col("p.last_key") == F.col("r.first_key")) & (F.col("p.range") < F.col("r.range")))
    begun = begun.groupBy(F.col("r.range").alias("range")).agg(F.sum("p.tail").alias("earlier"), F.max_by("p.last_digest", "p.range").alias("last"))
    return ends.join(begun, "range", "left").select("range", "start", "first_key", "earlier", F.col("last.digest").alias("digest_before"))


def op6_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of all pages."""
    return capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = r"""
WITH bare AS (SELECT *, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS b FROM pages WHERE url IS NOT NULL),
parts AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(b, '^([^/?]*)', 1), '^[^@]*@', ''), ':[0-9]*$', ''), '^www[0-9]*\.', '') AS host, regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path, regexp_extract(b, '\?(.*)$', 1) AS query FROM bare),
keyed AS (SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS urlkey, strftime(make_timestamp((page_id * 60 + 1704067200) * 1000000), '%Y%m%d%H%M%S') AS timestamp, page_id, url, md5(html) AS digest, coalesce(strlen(html), 0) AS n_bytes FROM parts)
SELECT row_number() OVER w - 1 AS global_no, urlkey, row_number() OVER h - 1 AS capture_no, timestamp, page_id, url, digest, n_bytes, coalesce(digest = lag(digest) OVER h, false) AS revisit
FROM keyed WINDOW w AS (ORDER BY urlkey NULLS FIRST, timestamp NULLS FIRST, page_id NULLS FIRST, url NULLS FIRST, digest NULLS FIRST), h AS (PARTITION BY urlkey ORDER BY timestamp NULLS FIRST, page_id NULLS FIRST, url NULLS FIRST, digest NULLS FIRST)
"""
