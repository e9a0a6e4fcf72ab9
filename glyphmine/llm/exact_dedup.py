"""Exact deduplication with Patricia tries.

Texts are partitioned by byte length and content hash. Only texts whose (length, hash) occurs more than once
can have a copy, so only they travel. Each map task folds its own copies in a trie first, so a text with
thousands of copies crosses the shuffle once for each map task; a second trie for each reduce partition settles the owners by
comparing full byte strings. A terminal holds the smallest identifier alone, whatever the number of copies; the rows find their owner
by length and hash, and by the text where different texts share both, so hash collisions never merge different texts.

Defined results: a null text is no content and owns itself; the empty text is content like any other; the owner
is the smallest non-null id of a content, and null only if all its ids are null; every input row yields one
row, repeated rows included; columns other than id and text are ignored whatever their names. Ids must be whole numbers; other
text raises an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of labels and nodes that one trie holds before its largest subtree is spilled.
TRIE_BYTES = 128 << 20
_NODE_BYTES = 250
_LABEL, _OWNER, _TERMINAL, _CHILDREN = range(4)
_SPILL = pa.schema([("key", pa.large_binary()), ("owner", pa.int64())])


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class PatriciaTrie:
    """Compressed radix trie from byte strings to the smallest identifier that holds each."""

    def __init__(self, budget: int = TRIE_BYTES, spill_uri: str | None = None):
        self.root: list = [b"", None, False, {}]
        self.used, self.budget, self.spill_uri = 0, budget, spill_uri
        self.runs: list[tuple[bytes, str]] = []

    def insert(self, key: bytes, owner: int | None) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[_CHILDREN].get(key[at])
            if child is None:
                leaf = [key[at:], None, False, {}]
                node[_CHILDREN][key[at]] = leaf
                self.used += len(key) - at + _NODE_BYTES
                node, at = leaf, len(key)
                break
            label = child[_LABEL]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = _common(label, key, at)
            upper = [label[:cut], None, False, {label[cut]: child}]
            child[_LABEL] = label[cut:]
            node[_CHILDREN][key[at]] = upper
            self.used += _NODE_BYTES
            node, at = upper, at + cut
        node[_TERMINAL], node[_OWNER] = True, _least(node[_OWNER], owner)
        if self.used > self.budget and self.spill_uri:
            self._spill()

    @staticmethod
    def _walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        """(key, node) of all terminals under node, in key order; prefix includes the node's own label."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node[_TERMINAL]:
                yield prefix, node
            for first in sorted(node[_CHILDREN], reverse=True):
                child = node[_CHILDREN][first]
                stack.append((child, prefix + child[_LABEL]))

    @staticmethod
    def _size(node: list) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x[_LABEL]) + _NODE_BYTES
            stack.extend(x[_CHILDREN].values())
        return total

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while not node[_TERMINAL] and len(node[_CHILDREN]) == 1:
            (node,) = node[_CHILDREN].values()
            prefix += node[_LABEL]
        if not node[_CHILDREN]:
            return
        first, subtree = max(node[_CHILDREN].items(), key=lambda kv: self._size(kv[1]))
        self.used -= self._size(subtree)
        uri = f"{self.spill_uri}/{uuid.uuid4().hex}.arrow"
        fs, path = common.file_system(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        above = prefix + bytes([first])
        with fs.open_output_stream(path) as sink, pa.ipc.new_stream(sink, _SPILL) as out:
            keys, owners, size = [], [], 0
            for key, terminal in self._walk(subtree, prefix + subtree[_LABEL]):
                keys.append(key)
                owners.append(terminal[_OWNER])
                size += len(key)
                if size > 4 << 20:
                    out.write_batch(pa.record_batch([keys, owners], schema=_SPILL))
                    keys, owners, size = [], [], 0
            if keys:
                out.write_batch(pa.record_batch([keys, owners], schema=_SPILL))
        del node[_CHILDREN][first]
        self.runs.append((above, uri))

    def _take(self, prefix: bytes) -> list[tuple[bytes, int | None]]:
        """Remove and return what is held under prefix."""
        node, at, path = self.root, 0, b""
        while at < len(prefix):
            child = node[_CHILDREN].get(prefix[at])
            if child is None:
                return []
            label = child[_LABEL]
            if len(label) >= len(prefix) - at:
                if not label.startswith(prefix[at:]):
                    return []
                found = [(k, t[_OWNER]) for k, t in self._walk(child, path + label)]
                del node[_CHILDREN][prefix[at]]
                return found
            if not prefix.startswith(label, at):
                return []
            node, at, path = child, at + len(label), path + label
        return []

    def items(self) -> Iterator[tuple[bytes, int | None]]:
        """(key, smallest identifier); spilled subtrees are read back one at a time."""
        tops: list[bytes] = []
        for prefix in sorted({p for p, _ in self.runs}):
            if not tops or not prefix.startswith(tops[-1]):
                tops.append(prefix)
        held = {top: self._take(top) for top in tops}
        for key, node in self._walk(self.root, b""):
            yield key, node[_OWNER]
        self.root = [b"", None, False, {}]
        for top in tops:
            below = PatriciaTrie(self.budget, self.spill_uri)
            for key, owner in held.pop(top):
                below.insert(key[len(top) :], owner)
            for prefix, uri in self.runs:
                if not prefix.startswith(top):
                    continue
                fs, path = common.file_system(uri)
                with fs.open_input_stream(path) as source:
                    for batch in pa.ipc.open_stream(source):
                        for key, owner in zip(batch["key"], batch["owner"].to_pylist(), strict=True):
                            below.insert(key.as_py()[len(top) :], owner)
                fs.delete_file(path)
            for key, owner in below.items():
                yield top + key, owner


_FOLDED = pa.schema([("len", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("id", pa.int64())])


def _fold(spill_uri: str, budget: int, schema: pa.Schema):
    """A map function over (len, hash, text, id): folds equal texts; the schema says whether it hands on the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget, spill_uri)
        for batch in batches:
            for n, h, text, id_ in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], batch[3].to_pylist(), strict=True):
                trie.insert(n.to_bytes(8) + h.to_bytes(8, signed=True) + text.as_py(), id_)
        out, size = [], 0
        for key, owner in trie.items():
            full = {"len": int.from_bytes(key[:8]), "hash": int.from_bytes(key[8:16], signed=True), "text": key[16:], "id": owner}
            out.append([full[c] for c in schema.names])
            size += len(key)
            if size > 8 << 20:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return common.tuned(docs).select(F.octet_length(text).cast("long").alias("len"), F.xxhash64(text).alias("hash"), common.whole(docs, id_col).alias("id"), text.alias("text"))


def _repeated(keyed: DataFrame) -> DataFrame:
    """The (len, hash) that more than one row has."""
    counts = keyed.filter("text is not null").groupBy("len", "hash").agg(F.count("*").alias("n"))
    return common.materialize(counts.filter("n > 1").select("len", "hash", F.lit(True).alias("repeated")), "repeated")


def _settle(candidates: DataFrame, trie_bytes: int) -> DataFrame:
    """(len, hash, owner), a row for each distinct text of rows (len, hash, id, text) whose key is repeated; a written table."""
    spill = common.shared_path(candidates.sparkSession, "trie")
    rows = candidates.select("len", "hash", F.col("text").cast("binary").alias("text"), "id")
    partial = rows.mapInArrow(common.lean(_fold(spill, trie_bytes, _FOLDED)), "len long, hash long, text binary, id long")
    owned = partial.repartition("len", "hash").mapInArrow(common.lean(_fold(spill, trie_bytes, pa.schema([_FOLDED.field(c) for c in ("len", "hash", "id")]))), "len long, hash long, id long")
    return common.materialize(owned.withColumnRenamed("id", "owner"), "owners")


def _owners(candidates: DataFrame, trie_bytes: int) -> DataFrame:
    """(id, owner) of every candidate row."""
    settled = _settle(candidates, trie_bytes)
    several = common.materialize(settled.groupBy("len", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("len", "hash"), "several")
    if several.isEmpty():
        return common.join_checked(candidates.select("len", "hash", "id"), settled, ["len", "hash"], "inner", 24).select("id", "owner")
    alone = settled.join(several, ["len", "hash"], "left_anti")
    # different texts of one length and hash: nothing but the text tells them apart
    apart = candidates.join(several, ["len", "hash"], "left_semi")
    by_text = apart.join(apart.groupBy("len", "hash", "text").agg(F.min("id").alias("owner")), ["len", "hash", "text"])
    return candidates.select("len", "hash", "id").join(alone, ["len", "hash"]).select("id", "owner").unionByName(by_text.select("id", "owner"))


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, owner_id) for every row: the smallest id whose text is byte for byte the same."""
    keyed = _keyed(docs, id_col, text_col)
    tagged = common.join_checked(keyed, _repeated(keyed), ["len", "hash"], "left", 17)
    alone = tagged.filter("repeated is null").select(F.col("id").alias("doc_id"), F.col("id").alias("owner_id"))
    owned = _owners(tagged.filter("repeated").select("len", "hash", "id", "text"), trie_bytes)
    return alone.unionByName(owned.select(F.col("id").alias("doc_id"), F.col("owner").alias("owner_id")))


def keep_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """docs with one row for each distinct text: that of the owner. Rows without text stay.

    Of repeated rows with the owner's id and text one stays, the first in the order of the other columns' JSON.
    """
    names = docs.columns
    text = F.col(text_col).cast("string")
    whole = common.tuned(docs).select(F.octet_length(text).cast("long").alias("len"), F.xxhash64(text).alias("hash"), common.whole(docs, id_col).alias("id"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    repeated = _repeated(whole.select("len", "hash", "id", "text"))
    tagged = common.join_checked(whole, repeated, ["len", "hash"], "left", 17)
    alone = tagged.filter("repeated is null").select("row.*")
    candidates = tagged.filter("repeated").drop("repeated")
    owners = _settle(candidates.select("len", "hash", "id", "text"), trie_bytes).withColumnRenamed("owner", "owner_id")
    owner = F.broadcast(owners) if common.small_enough(owners, 24) else owners
    won = candidates.alias("c").join(owner.alias("o"), (F.col("c.len") == F.col("o.len")) & (F.col("c.hash") == F.col("o.hash")) & F.col("c.id").eqNullSafe(F.col("o.owner_id")), "left_semi")
    first = Window.partitionBy("len", "hash", "id", "text").orderBy(F.to_json("row"))
    return alone.unionByName(won.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of all documents."""
    return exact_owners(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = "SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS owner_id FROM documents"
