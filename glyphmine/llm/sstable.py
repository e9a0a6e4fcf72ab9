"""Token ids in sorted-string-table shards.

A shard holds the documents of a range of identifiers, sorted. Keys are the identifier in 8 order-preserving bytes; values are a
flag and the text's token ids as 16-bit integers of a public vocabulary. Records lie in blocks whose keys are stored as
differences from their predecessor, with restart points to search by; after the blocks come the sparse index (the last key of each
block), a Bloom filter over the keys and a fixed footer. A lookup reads the footer, asks the filter, searches the index and then one block's restart
points by bisection.

The table of a shard is streamed as rows (shard, seq, kind, first_id, last_id, n_records, offset, payload): its payloads in the order of offset are the
file, and no task holds more than a block and the keys of a shard.

Defined results: a null text is kept apart from an empty one by the flag; rows with null id have no key and are left out; rows that share an
id are all kept, in the order of their texts, and a lookup returns all; an empty table gives no shards; columns other than id and text
are ignored whatever their names. Ids must be whole numbers; other text raises an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text, vocabulary

SHARD_DOCS, BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 20_000, 64 << 10, 16, 10, 7
_FOOTER = struct.Struct("<QQQQQQQ8s")
_MAGIC = b"GLYPHSST"
_INDEX = struct.Struct(">8sQI")


def key_of(id_: int) -> bytes:
    return (id_ + (1 << 63)).to_bytes(8)


def id_of(key: bytes) -> int:
    return int.from_bytes(key) - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _spots(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers of each key, by double hashing."""
    a = text.mix(keys)
    b = text.mix(keys ^ np.uint64(0x51_7C_C1_B7_27_22_0A_95)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Streams one table: add() in key order, then finish(); both yield (kind, first id, last id, records, offset, payload)."""

    def __init__(self, block_bytes: int = BLOCK_BYTES, restart: int = RESTART):
        self.block_bytes, self.restart = block_bytes, restart
        self.offset, self.index, self.keys = 0, [], array("Q")
        self._begin()

    def _begin(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.count, self.restarts, self.first, self.last = 0, 0, [], None, b""

    def add(self, id_: int, value: bytes) -> Iterator[tuple]:
        key = key_of(id_)
        shared = 0
        if self.count % self.restart:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        entry = b"".join((_varint(shared), _varint(8 - shared), _varint(len(value)), key[shared:], value))
        self.parts.append(entry)
        self.size += len(entry)
        self.count += 1
        self.first = self.first if self.first is not None else id_
        self.last = key
        self.keys.append(id_ & (1 << 64) - 1)
        if self.size >= self.block_bytes:
            yield self._block()

    def _emit(self, kind: str, first: int | None, last: int | None, n: int, payload: bytes) -> tuple:
        row = (kind, first, last, n, self.offset, payload)
        self.offset += len(payload)
        return row

    def _block(self) -> tuple:
        body = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        payload = body + struct.pack("<I", zlib.crc32(body))
        self.index.append(_INDEX.pack(self.last, self.offset, len(payload)))
        row = self._emit("block", self.first, id_of(self.last), self.count, payload)
        self._begin()
        return row

    def finish(self) -> Iterator[tuple]:
        if self.count:
            yield self._block()
        index = b"".join(self.index)
        keys = np.frombuffer(self.keys, np.uint64)
        bits = max(64, len(keys) * BLOOM_BITS)
        filter_ = np.zeros(-(-bits // 8), np.uint8)
        if len(keys):
            spots = _spots(keys, bits, BLOOM_HASHES).ravel()
            np.bitwise_or.at(filter_, (spots >> np.uint64(3)).astype(np.int64), (1 << (spots & np.uint64(7))).astype(np.uint8))
        at_index = self.offset
        yield self._emit("index", None, None, len(self.index), index)
        at_filter = self.offset
        yield self._emit("filter", None, None, len(keys), filter_.tobytes())
        yield self._emit("footer", None, None, len(keys), _FOOTER.pack(at_index, len(index), at_filter, bits, BLOOM_HASHES, len(keys), len(self.index), _MAGIC))


class Table:
    """Lookup in a finished table, given as bytes or a memory map."""

    def __init__(self, data: bytes):
        self.data = data
        at_index, index, at_filter, self.bits, self.hashes, self.n_records, n_blocks, magic = _FOOTER.unpack(data[-_FOOTER.size :])
        if magic != _MAGIC:
            raise ValueError("not a table of this kind")
        self.blocks = [_INDEX.unpack_from(data, at_index + k * _INDEX.size) for k in range(n_blocks)]
        self.last = [b[0] for b in self.blocks]
        self.filter = np.frombuffer(data, np.uint8, -(-self.bits // 8), at_filter)

    def may_hold(self, id_: int) -> bool:
        spots = _spots(np.array([id_ & (1 << 64) - 1], np.uint64), self.bits, self.hashes)[0]
        return bool((self.filter[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8) & 1).all())

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, offset, size = self.blocks[k]
        body, crc = self.data[offset : offset + size - 4], self.data[offset + size - 4 : offset + size]
        if zlib.crc32(body) != struct.unpack("<I", crc)[0]:
            raise ValueError(f"block {k} is damaged")
        (n,) = struct.unpack("<I", body[-4:])
        return body[: -4 - 4 * n], list(struct.unpack(f"<{n}I", body[-4 - 4 * n : -4]))

    @staticmethod
    def _entries(body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            fresh, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + fresh]
            at += fresh
            yield key, body[at : at + size]
            at += size

    def get(self, id_: int) -> list[bytes]:
        """Values of an identifier, none if it isn't there."""
        if not self.may_hold(id_):
            return []
        key, found = key_of(id_), []
        for k in range(bisect_left(self.last, key), len(self.blocks)):
            body, restarts = self._block(k)
            at = bisect_left(restarts, key, key=lambda r: next(self._entries(body, r))[0])
            for held, value in self._entries(body, restarts[max(0, at - 1)]):
                if held == key:
                    found.append(value)
                elif held > key:
                    return found
        return found

    def scan(self) -> Iterator[tuple[int, bytes]]:
        for k in range(len(self.blocks)):
            for key, value in self._entries(self._block(k)[0], 0):
                yield id_of(key), value


@cache
def _encoder(path: str):
    return vocabulary.byte_bpe(path)


def encode_value(body: str | None, path: str = vocabulary.BYTE_BPE) -> bytes:
    return b"\0" if body is None else b"\1" + array("H", _encoder(path).encode_ordinary(body)).tobytes()


def decode_value(value: bytes, path: str = vocabulary.BYTE_BPE) -> str | None:
    return None if value[0] == 0 else _encoder(path).decode(np.frombuffer(value[1:], "<u2").tolist(), errors="strict")


_ROWS = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_records", pa.int64()), ("offset", pa.int64()), ("payload", pa.binary())])


def _build(path: str, block_bytes: int, restart: int, shard_docs: int):
    """Shards of a range of identifiers, whose rows (id, text) come sorted: a new one begins after shard_docs documents, but not within an identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        writer, last, held, seq, out, size = None, None, 0, 0, [], 0

        def put(rows: Iterator[tuple]) -> None:
            nonlocal seq, size
            for row in rows:
                out.append((shard, seq, *row))
                seq += 1
                size += len(row[-1])

        for batch in text.slices(batches):
            for id_, body in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if writer and held >= shard_docs and id_ != last:
                    put(writer.finish())
                    writer, shard, held, seq = None, shard + 1, 0, 0
                writer = writer or Writer(block_bytes, restart)
                put(writer.add(id_, encode_value(body, path)))
                last, held = id_, held + 1
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)
                    out, size = [], 0
        if writer:
            put(writer.finish())
        if out:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return run


def tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, tokenizer: str = vocabulary.BYTE_BPE, block_bytes: int = BLOCK_BYTES, restart: int = RESTART) -> DataFrame:
    """Rows (shard, seq, kind, first_id, last_id, n_records, offset, payload) of all shards.

    Spark cuts the identifiers into ranges, and each range into shards of shard_docs documents, the last one of what is left; more only where
    one identifier has more. Shards are numbered in the order of their identifiers: the range in the upper 32 bits, the shard in it in the lower ones.
    """
    source = common.tuned(docs).select(common.whole(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    schema = "shard long, seq long, kind string, first_id long, last_id long, n_records long, offset long, payload binary"
    # texts are shuffled, as the ranges are found by a pass over the rows before it: it would tokenise them a second time
    return source.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(common.lean(_build(tokenizer, block_bytes, restart, shard_docs)), schema)


def write_tables(rows: DataFrame, uri: str) -> DataFrame:
    """Write each shard of tables() as <uri>/shard-<number>.sst; a manifest (shard, path, n_bytes). A repeated task writes the same bytes again, by rename."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.file_system(uri)
        fs.create_dir(root, recursive=True)
        now, sink, done = None, None, []

        def close() -> None:
            if sink is not None:
                size = sink.tell()
                sink.close()
                fs.move(f"{root}/.shard-{now:014x}.{held}", f"{root}/shard-{now:014x}.sst")
                done.append((now, f"{uri}/shard-{now:014x}.sst", size))

        held = uuid.uuid4().hex
        for batch in batches:
            for shard, payload in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, sink = shard, fs.open_output_stream(f"{root}/.shard-{shard:014x}.{held}")
                sink.write(payload)
        close()
        if done:
            yield pa.record_batch([pa.array(list(c), kind) for c, kind in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["shard", "path", "n_bytes"])

    ordered = rows.select("shard", "payload", "seq").repartition("shard").sortWithinPartitions("shard", "seq").select("shard", "payload")
    return common.materialize(ordered.mapInArrow(common.lean(run), "shard long, path string, n_bytes long"), "manifest")


def op5_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of all documents."""
    return tables(spark.read.parquet(f"{sf_dir}/documents.parquet"))
