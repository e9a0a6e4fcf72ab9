"""Scans of local folders against Spark's reader of binary files, with many small files and odd names."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from glyphmine.sources import snapshots
from glyphmine.sources.snapshots import SourceSpec


def test_many_small_files_take_few_tasks(spark, tmp_path):
    for k in range(1500):
        (tmp_path / f"p{k}.cs").write_text(f"class T{k} {{ }}")
    found = snapshots.scan(spark, SourceSpec("game", str(tmp_path)))
    assert found.rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism)
    assert {(r.relative_path, r.size, bytes(r.content).decode()) for r in found.select("relative_path", "size", "content").collect()} == {(f"p{k}.cs", len(f"class T{k} {{ }}"), f"class T{k} {{ }}") for k in range(1500)}
    one = snapshots.fingerprint(spark, str(tmp_path)).first()
    assert (one.file_count, one.csharp_file_count, one.total_size) == (1500, 1500, sum(len(f"class T{k} {{ }}") for k in range(1500)))


def test_same_files_as_sparks_reader(spark, tmp_path):
    root = tmp_path / "a b+c%20"
    names = ["x.cs", "X.CS", "no.csx", "é ü+%41.cs", "_left.cs", "_k=v.cs", ".hid.cs", "sub/y.cs", "sub/deep/er/z.cs", "sub/.git/g.cs", "_skip/s.cs", "a.b.cs", "cs", "sub/app.csproj", "lib.DLL", "empty.cs", "back\\slash.cs", "line\nbreak.cs"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.cs" else name.encode())
    (root / "none").mkdir()
    os.symlink(root / "x.cs", root / "link.cs")
    assert snapshots.local_folder(spark, str(root)) == str(root) and snapshots.local_folder(spark, f"file://{root}") == str(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    want = raw.filter(F.element_at(F.split("path", "/"), -1).endswith(".cs")).select("length", "content", F.sha2("content", 256)).collect()
    got = snapshots.scan(spark, SourceSpec("game", str(root))).select("size", "content", "sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)
    paths = {r.relative_path for r in snapshots.scan(spark, SourceSpec("game", str(root))).collect()}
    assert {"x.cs", "é ü+%41.cs", "_k=v.cs", "sub/deep/er/z.cs", "link.cs"} <= paths and not {"X.CS", "_left.cs", "sub/.git/g.cs", "_skip/s.cs"} & paths
    mine, all_ = snapshots.fingerprint(spark, str(root)).first(), raw.agg(F.count("*"), F.sum("length"), F.date_format(F.max("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()
    assert (mine.file_count, mine.total_size, mine.latest_mtime) == tuple(all_) and (mine.project_files, mine.assembly_files) == (1, 1)
