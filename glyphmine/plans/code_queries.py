"""Registered queries over C# text: every part of the star schema becomes a source file, which is parsed, indexed and resolved by the engine.

The twins never see the text: they say from the rows what its declarations, calls and uses must be.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CodeIndex
from ..operators import symbol, verbs
from ..operators.resolve import Rules, type_names
from ..sources import snapshots
from ..sources.snapshots import SourceSpec, fingerprinted
from ..stage import file_system, materialize, shared_path
from . import build
from .queries import query

#: @K is the number of a type, @P that of its base, @N and @M their namespaces, @S a size, @V the number of its method and @W of its base's, @B the base,
#: @U a using; @C and @O are a modifier or nothing; ` stands for a backslash.
TEMPLATE = '''@U
namespace N@N
{
    @Cpublic class T@K : @B, IThing
    {
        private int f@S;
        public N@M.T@P link;
        public static List<N@M.T@P> all;
        public string Name { get; set; }
        internal static readonly double Half = 0.5, Third = 0.3;
        static T@K() { }
        public T@K() { f@S = @S; }
        public virtual int Do@V(int a, Map<int,string> b) { return f@S; }
        protected abstract N@M.T@P[] More(params string[] rest);
        public void Run(N@M.T@P other)
        {
            f@S++;
            f@S += 3;
            other.Do@W(1, "lit`t@K");
            Do@V(f@S, Name);
            Debug.Log(@"c:`p@K ""q""");
            mystery.Go();
            var x = new N@M.T@P();
            object y = (N@M.T@P)other;
            N@M.T@P z = y as N@M.T@P;
            link.Name = "";
            System.Type t = typeof(N@M.T@P);
            foreach (N@M.T@P e in all) { e.Run(null); }
            try { } catch (Oops o) { }
            base.Run(z);
            this.link.link.f0 = x.Twice(2).Count;
            if (all[0] == (link ?? z)) { checked { z.link--; } }
        }
        public @ON@M.T@P Twice(int n) { return n > 1 ? Twice(n - 1) : null; }
        public enum Mode { On, Off }
    }
}
'''
#: Every tenth type is declared again in a later file.
AGAIN = "namespace N@N { public class T@K { public int extra@K; } }"
#: Every hundredth part gives a file that breaks off, or holds no source.
HALF, NOTHING = "namespace Half@K { public class Half { public void Open( { ", "%%% no source {{{ @K"


def _filled(template: str) -> str:
    """The template as SQL over rows (k, s)."""
    text = "'" + template.replace("'", "''").replace("\n", "~") + "'"
    base = "CASE WHEN k = 0 THEN 'Root' ELSE 'N' || CAST(k DIV 3 % 5 AS STRING) || '.T' || CAST(k DIV 3 AS STRING) END"
    values = {
        "@U": "CASE WHEN k % 2 = 0 THEN 'using UnityEngine;' ELSE 'using N1;' END", "@O": "CASE WHEN k % 4 = 1 THEN 'override ' ELSE '' END", "@C": "CASE WHEN k % 7 = 0 THEN 'abstract ' ELSE '' END", "@B": base, "@K": "CAST(k AS STRING)", "@P": "CAST(k DIV 3 AS STRING)", "@N": "CAST(k % 5 AS STRING)",
        "@M": "CAST(k DIV 3 % 5 AS STRING)", "@S": "CAST(s AS STRING)", "@V": "CAST(k % 3 AS STRING)", "@W": "CAST(k DIV 3 % 3 AS STRING)", "`": "chr(92)", "~": "chr(10)",
    }
    for mark, value in values.items():
        text = f"replace({text}, '{mark}', {value})"
    return text


#: Of each kind of file its path, its template and which parts have one.
_KINDS = (("'p' || CAST(k AS STRING) || '.cs'", TEMPLATE, "true"), ("'z/again' || CAST(k AS STRING) || '.cs'", AGAIN, "k % 10 = 3"), ("'z/half' || CAST(k AS STRING) || '.cs'", HALF, "k % 100 = 4"), ("'z/nothing' || CAST(k AS STRING) || '.cs'", NOTHING, "k % 100 = 5"))


#: Parts whose files one task renders and parses. A row of the table is a few bytes and its files some thousand, so Spark's own splits would give all to one task.
PARTS_AT_ONCE = 2000


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, relative_path, filename, extension, size, sha256, line_count, content) of the rendered files."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    part = part.repartition(max(spark.sparkContext.defaultParallelism, -(-part.count() // PARTS_AT_ONCE)), "k")
    each = F.array_compact(F.array(*(F.when(F.expr(which), F.struct(F.expr(path).alias("path"), F.expr(_filled(text)).alias("text"))) for path, text, which in _KINDS)))
    rows = part.select(F.explode(each).alias("x")).select("x.*")
    content = F.col("text").cast("binary")
    return fingerprinted(rows.select(F.lit("game").alias("source_id"), F.col("path").alias("relative_path"), F.octet_length("text").cast("long").alias("size"), content.alias("content")))


def write_sources(files: DataFrame, folder: str) -> int:
    """Write rows (relative_path, content) as files below a folder, each task its own; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                above = f"{root}/{path}".rpartition("/")[0]
                if above not in made:
                    fs.create_dir(above, recursive=True)
                    made.add(above)
                with fs.open_output_stream(f"{root}/{path}") as out:
                    out.write(content)
            yield pa.record_batch([batch[0]], names=["path"])

    return materialize(files.select("relative_path", "content").mapInArrow(run, "path string"), "sources").count()


_FOLDERS: dict[tuple[str, str], str] = {}


def source_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder that holds the rendered files, written once for a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FOLDERS:
        folder = shared_path(spark, "snapshot")
        write_sources(source_files(spark, sf_dir), folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


_BUILT: dict[tuple[str, str], tuple[CodeIndex, DataFrame]] = {}


def built(spark: SparkSession, sf_dir: str) -> tuple[CodeIndex, DataFrame]:
    """(index, parsed files): the files' index, built once for a session; its tables lie in the shared folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        specs = [SourceSpec("game", "", "game", "1", "game-1")]
        _BUILT[key] = build.index_files(spark, specs, source_files(spark, sf_dir), Rules(primary="game"))
    return _BUILT[key]


def _of(alias: str = "relative_path") -> str:
    return f"'p' || k || '.cs' AS {alias}"


_ROWS = "r AS (SELECT p_partkey AS k, p_size AS s, p_partkey // 3 AS p, 'N' || (p_partkey % 5) || '.T' || p_partkey AS me, 'N' || (p_partkey // 3 % 5) || '.T' || (p_partkey // 3) AS up FROM part)"


def _union(*rows: str) -> str:
    return f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT {r}" for r in rows)


def _parsed(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = built(spark, d)[1].filter(F.col("relative_path").startswith("p"))
    return rows.select("relative_path", F.explode(name).alias("x")).select("relative_path", "x.*")


@query("cs_files", _union(
    "'p' || k || '.cs' AS relative_path, 'OK' AS parse_status, 38 AS line_count FROM r", "'z/again' || k || '.cs', 'OK', 1 FROM r WHERE k % 10 = 3", "'z/half' || k || '.cs', 'PARTIAL', 1 FROM r WHERE k % 100 = 4", "'z/nothing' || k || '.cs', 'FAILED', 1 FROM r WHERE k % 100 = 5",
), plain=True)
def _(spark, d):
    return built(spark, d)[0].files.select("relative_path", "parse_status", "line_count")


@query("cs_parse_statistics", "SELECT 'game' AS source_id, count(*) + count(*) FILTER (p_partkey % 10 = 3) AS n_ok, count(*) FILTER (p_partkey % 100 = 4) AS n_partial, count(*) FILTER (p_partkey % 100 = 5) AS n_failed, count(*) * 2 + count(*) FILTER (p_partkey % 100 = 4) AS n_types, count(*) FILTER (p_partkey % 10 = 3) AS n_duplicate_types FROM part", plain=True)
def _(spark, d):
    return build.parse_statistics(built(spark, d)[1])


@query("cs_types", _union(
    f"{_of()}, me AS full_name, 'class' AS kind, 'public' AS visibility, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS is_abstract, 4 AS start_line, 36 AS end_line FROM r",
    "'p' || k || '.cs', me || '.Mode', 'enum', 'public', 0, 35, 35 FROM r",
), plain=True)
def _(spark, d):
    return _parsed(spark, d, "types").select("relative_path", "full_name", "kind", "visibility", "is_abstract", "start_line", "end_line")


@query("cs_methods", _union(
    f"{_of()}, '.cctor()' AS signature, CAST(NULL AS VARCHAR) AS return_type, 'internal' AS visibility, 1 AS is_static, 0 AS is_virtual, 0 AS is_abstract, 11 AS start_line, 11 AS end_line FROM r", "'p' || k || '.cs', '.ctor()', NULL, 'public', 0, 0, 0, 12, 12 FROM r",
    "'p' || k || '.cs', 'Do' || (k % 3) || '(int,Map<int,string>)', 'int', 'public', 0, 1, 0, 13, 13 FROM r", "'p' || k || '.cs', 'More(string[])', up || '[]', 'protected', 0, 0, 1, 14, 14 FROM r",
    "'p' || k || '.cs', 'Run(' || up || ')', 'void', 'public', 0, 0, 0, 15, 33 FROM r", "'p' || k || '.cs', 'Twice(int)', up, 'public', 0, 0, 0, 34, 34 FROM r",
), plain=True)
def _(spark, d):
    return _parsed(spark, d, "methods").select("relative_path", "signature", "return_type", "visibility", "is_static", "is_virtual", "is_abstract", "start_line", "end_line")


@query("cs_fields", _union(
    f"{_of()}, 'f' || s AS name, 'int' AS field_type, 'private' AS visibility, 0 AS is_static, 0 AS is_readonly, 6 AS start_line FROM r", "'p' || k || '.cs', 'link', up, 'public', 0, 0, 7 FROM r", "'p' || k || '.cs', 'all', 'List<' || up || '>', 'public', 1, 0, 8 FROM r",
    "'p' || k || '.cs', 'Half', 'double', 'internal', 1, 1, 10 FROM r", "'p' || k || '.cs', 'Third', 'double', 'internal', 1, 1, 10 FROM r",
), plain=True)
def _(spark, d):
    return _parsed(spark, d, "fields").select("relative_path", "name", "field_type", "visibility", "is_static", "is_readonly", "start_line")


@query("cs_properties", _union(f"{_of()}, 'Name' AS name, 'string' AS property_type, 1 AS has_getter, 1 AS has_setter, 9 AS start_line FROM r"), plain=True)
def _(spark, d):
    return _parsed(spark, d, "properties").select("relative_path", "name", "property_type", "has_getter", "has_setter", "start_line")


@query("cs_strings", _union(
    f"{_of()}, 'lit' || chr(9) || k AS value, CASE WHEN true THEN 'localization_like' END AS classification, 19 AS start_line, 'Run' AS method FROM r",
    "'p' || k || '.cs', 'c:' || chr(92) || 'p' || k || ' \"q\"', 'path_like', 21, 'Run' FROM r", "'p' || k || '.cs', '', 'other', 26, 'Run' FROM r",
), plain=True)
def _(spark, d):
    idx = built(spark, d)[0]
    files, methods = idx.files.select(F.col("id").alias("file_id"), "relative_path"), idx.methods.select(F.col("id").alias("method_id"), F.col("name").alias("method"))
    return idx.strings.join(files, "file_id").join(methods, "method_id", "left").select("relative_path", "value", "classification", "start_line", "method")


@query("cs_inheritance", _union(
    "me AS full_name, CASE WHEN k = 0 THEN 'Root' ELSE up END AS target_name, 'base' AS relation, CASE WHEN k > 0 THEN up END AS target FROM r", "me, 'IThing', 'interface', NULL FROM r",
), plain=True)
def _(spark, d):
    idx = built(spark, d)[0]
    names = type_names(idx).select("type_id", "full_name")
    return idx.inheritance.join(names, "type_id").join(names.select(F.col("type_id").alias("target_type_id"), F.col("full_name").alias("target")), "target_type_id", "left").select("full_name", "target_name", "relation", "target")


@query("cs_index_types", _union(
    "me AS full_name, 'N' || (k % 5) AS namespace, 'T' || k AS name, CAST(NULL AS VARCHAR) AS parent, 'p' || k || '.cs' AS relative_path FROM r", "me || '.Mode', 'N' || (k % 5), 'Mode', me, 'p' || k || '.cs' FROM r",
    "'Half' || k || '.Half', 'Half' || k, 'Half', NULL, 'z/half' || k || '.cs' FROM r WHERE k % 100 = 4",
), plain=True)
def _(spark, d):
    idx = built(spark, d)[0]
    parents = idx.types.select(F.col("id").alias("parent_type_id"), F.col("full_name").alias("parent"))
    files = idx.files.select(F.col("id").alias("file_id"), "relative_path")
    return idx.types.join(parents, "parent_type_id", "left").join(files, "file_id").select("full_name", "namespace", "name", "parent", "relative_path")


@query("cs_members_of_parts", "SELECT 'N' || (p_partkey % 5) || '.T' || p_partkey AS full_name, 'extra' || p_partkey AS name, 'z/again' || p_partkey || '.cs' AS relative_path FROM part WHERE p_partkey % 10 = 3", plain=True)
def _(spark, d):
    idx = built(spark, d)[0]
    files = idx.files.select(F.col("id").alias("file_id"), "relative_path")
    return idx.fields.filter("name like 'extra%'").join(type_names(idx).select("type_id", "full_name"), "type_id").join(files, "file_id").select("full_name", "name", "relative_path")


#: Types whose chain of bases holds no second signature of Run: those of parts 0 to 2, whose other is T0.
_ONE = "p < 3"


def _call(line: int, name: str, owner: str, signature: str, status: str = "'resolved'", where: str = "") -> str:
    return f"'p' || k || '.cs' AS relative_path, me AS caller, {line} AS line, {name} AS callee_name, {owner} AS owner, {signature} AS callee_signature_hint, {status} AS resolution_status FROM r {where}"


_OUTSIDE = "CASE WHEN k % 2 = 0 THEN 'external' ELSE 'unresolved' END"


@query("cs_calls", _union(
    _call(19, "'Do' || (p % 3)", "up", "'Do' || (p % 3) || '(int,Map<int,string>)'"),
    _call(20, "'Do' || (k % 3)", "me", "'Do' || (k % 3) || '(int,Map<int,string>)'"),
    _call(21, "'Log'", "NULL", "'(?)'", _OUTSIDE), _call(22, "'Go'", "NULL", "'()'", _OUTSIDE),
    _call(23, "'.ctor'", "up", "'.ctor()'"),
    _call(28, "'Run'", f"CASE WHEN {_ONE} THEN up END", f"CASE WHEN {_ONE} THEN 'Run(N0.T0)' ELSE '(?)' END", f"CASE WHEN {_ONE} THEN 'resolved' ELSE 'ambiguous' END"),
    _call(30, "'Run'", f"CASE WHEN {_ONE} THEN up END", f"CASE WHEN {_ONE} THEN 'Run(N0.T0)' ELSE '(?)' END", f"CASE WHEN {_ONE} THEN 'resolved' ELSE 'ambiguous' END", "WHERE k > 0"),
    _call(30, "'Run'", "NULL", "'(?)'", "'unresolved'", "WHERE k = 0"),
    _call(31, "'Twice'", "up", "'Twice(int)'"), _call(34, "'Twice'", "me", "'Twice(int)'"),
), plain=True)
def _(spark, d):
    idx = built(spark, d)[0]
    files, names = idx.files.select(F.col("id").alias("file_id"), "relative_path"), type_names(idx).select("type_id", "full_name")
    at = idx.methods.select("id", "type_id").join(names, "type_id")
    calls = idx.method_calls.join(files, "file_id").join(at.select(F.col("id").alias("caller_method_id"), F.col("full_name").alias("caller")), "caller_method_id", "left").join(at.select(F.col("id").alias("callee_method_id"), F.col("full_name").alias("owner")), "callee_method_id", "left")
    return calls.select("relative_path", "caller", "line", "callee_name", "owner", "callee_signature_hint", "resolution_status")


def _use(line: int, name: str, kind: str, owner: str = "me", target: str = "field", status: str = "resolved") -> str:
    key = f"'{target}:game:' || {owner} || '.' || {name}" if status == "resolved" else f"'?' || {name}"
    return f"'p' || k || '.cs' AS relative_path, {line} AS start_line, {name} AS target_name, '{kind}' AS reference_kind, {key} AS target_logical_key FROM r"


@query("cs_member_uses", _union(
    _use(12, "'f' || s", "write"), _use(13, "'f' || s", "read"), _use(17, "'f' || s", "read_write"), _use(18, "'f' || s", "read_write"), _use(20, "'f' || s", "read"), _use(20, "'Name'", "read", target="property"),
    _use(26, "'link'", "read"), _use(26, "'Name'", "write", "up", "property"), _use(28, "'all'", "read"), _use(31, "'link'", "read"), _use(31, "'link'", "read", "up"),
    _use(32, "'all'", "read"), _use(32, "'link'", "read"), _use(32, "'link'", "read_write", "up"),
), plain=True)
def _(spark, d):
    idx = built(spark, d)[0]
    files = idx.files.select(F.col("id").alias("from_file_id"), "relative_path")
    uses = idx.symbol_references.filter("resolution_status = 'resolved' and not (start_line = 31 and target_name like 'f%')")
    return uses.join(files, "from_file_id").select("relative_path", "start_line", "target_name", "reference_kind", "target_logical_key")


def _type(line: int, kind: str, name: str = "up", status: str = "'resolved'", where: str = "") -> str:
    return f"'p' || k || '.cs' AS relative_path, {line} AS line, '{kind}' AS reference_kind, {name} AS target_name, {status} AS resolution_status FROM r {where}"


@query("cs_type_uses", _union(
    _type(4, "inherit", where="WHERE k > 0"), _type(4, "inherit", "'Root'", "'unresolved'", "WHERE k = 0"), _type(4, "interface", "'IThing'", "'unresolved'"), _type(7, "field_type"), _type(8, "field_type", "'List'", "'unresolved'"), _type(8, "generic_argument"),
    _type(13, "parameter_type", "'Map'", "'unresolved'"), _type(14, "return_type"), _type(15, "parameter_type"), _type(23, "instantiate"), _type(24, "cast"), _type(25, "type_use"), _type(25, "as"),
    _type(27, "type_use", "'System.Type'", "'external'"), _type(27, "typeof"), _type(28, "type_use"), _type(29, "type_use", "'Oops'", "'unresolved'"), _type(34, "return_type"),
), plain=True)
def _(spark, d):
    idx = built(spark, d)[0]
    files = idx.files.select(F.col("id").alias("from_file_id"), "relative_path")
    return idx.type_references.join(files, "from_file_id").select("relative_path", "line", "reference_kind", "target_name", "resolution_status")


_SPECS = {
    "N0.T0": "type", "game::T1": "type", "other::T1": "not_found", "N1.T1.Mode": "type", "Mode": "ambiguous", "N1.T1.Do1": "method", "N1.T1.Twice(int)": "method", "N1.T1.Twice(string)": "method", "T1.link": "field", "T1.Name": "property", "T1.Nope": "not_found",
}


@query("cs_lookup", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}')" for s, k in _SPECS.items()) + ") v(spec, kind)", plain=True)
def _(spark, d):
    idx = built(spark, d)[0]
    return spark.createDataFrame([(s, symbol.lookup(idx, s)["kind"]) for s in _SPECS], "spec string, kind string")


_FOUND = "'p' || k || '.cs:' || {0} AS location, '{1}' AS kind, 'resolved' AS status, 'game' AS from_source FROM r WHERE p = 0"


@query("cs_refs", _union(*(_FOUND.format(line, kind) + (" AND k > 0" if kind == "inherit" else "") for line, kind in (
    (4, "inherit"), (7, "field_type"), (8, "generic_argument"), (14, "return_type"), (15, "parameter_type"), (23, "instantiate"), (24, "cast"), (25, "type_use"), (25, "as"), (27, "typeof"), (28, "type_use"), (34, "return_type"),
))), plain=True)
def _(spark, d):
    return verbs.refs(built(spark, d)[0], "game::N0.T0")["references"]


@query("cs_derived", f"WITH RECURSIVE {_ROWS}, e AS (SELECT p AS src, k AS dst, row_number() OVER (PARTITION BY p ORDER BY me) AS nth FROM r WHERE k > 0), walk(node, depth, way) AS (SELECT CAST(1 AS BIGINT), 0, CAST([] AS BIGINT[]) UNION ALL SELECT dst, depth + 1, list_append(way, nth) FROM walk JOIN e ON src = node) SELECT depth, pos, 'game' AS source_id, me AS full_name FROM (SELECT *, row_number() OVER (ORDER BY depth, way) - 1 AS pos FROM walk) JOIN r ON k = node WHERE depth > 0", plain=True)
def _(spark, d):
    return verbs.derived(built(spark, d)[0], "N1.T1", recursive=True)["derived"]


@query("cs_overrides", f"WITH {_ROWS} SELECT me AS full_name, 'Twice(int)' AS signature FROM r WHERE k % 4 = 1", plain=True)
def _(spark, d):
    return verbs.overrides(built(spark, d)[0], "N0.T0.Twice")["overrides"]


_DUCKDB_TEXTS = "t AS (" + " UNION ALL ".join(f"SELECT {path} AS path, {_filled(text)} AS text FROM (SELECT p_partkey AS k, p_size AS s FROM part) WHERE {which}" for path, text, which in _KINDS).replace(" DIV ", " // ") + ")"


@query("cs_scan", f"WITH {_DUCKDB_TEXTS} SELECT 'game' AS source_id, path AS relative_path, string_split(path, '/')[-1] AS filename, '.cs' AS extension, strlen(text) AS size, sha256(text) AS sha256, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM t", plain=True)
def _(spark, d):
    return snapshots.scan(spark, SourceSpec("game", source_folder(spark, d))).drop("content")


@query("cs_fingerprint", f"WITH {_DUCKDB_TEXTS} SELECT count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS total_size, count(*) AS csharp_file_count, 0 AS project_files, 0 AS assembly_files FROM t", plain=True)
def _(spark, d):
    return snapshots.fingerprint(spark, source_folder(spark, d)).drop("latest_mtime")
